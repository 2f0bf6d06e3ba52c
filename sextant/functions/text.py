"""Scalar functions over text and paths, as columns: all stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Paths ---------------------------------------------------------------------


def slashed(path: Column | str) -> Column:
    return F.translate(col(path), "\\", "/")


def file_name(path: Column | str) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def directory(path: Column | str) -> Column:
    """Everything before the last slash, "" where there is none."""
    return F.regexp_extract(slashed(path), r"^(.*)/[^/]*$", 1)


def relative_path(path: Column | str, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(slashed(path).startswith(root), F.substring(slashed(path), F.lit(len(root) + 1), F.length(path))).otherwise(slashed(path))


def match_file(path: Column | str, wanted: Column | str) -> Column:
    """Does a path answer to what was asked for: same name, same path, a tail of the path, or a longer path with that name."""
    p = F.lower(slashed(path))
    w = F.lower(slashed(F.lit(wanted) if isinstance(wanted, str) else wanted))
    name = F.substring_index(p, "/", -1)
    return (name == w) | (p == w) | p.endswith(F.concat(F.lit("/"), w)) | w.endswith(F.concat(F.lit("/"), name))


# Patterns ------------------------------------------------------------------


def safe_pattern(pattern: str, ignore_case: bool = True) -> str:
    """A regular expression, or the text itself, quoted, where it isn't one."""
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    return ("(?i)" if ignore_case else "") + pattern


def word_pattern(term: str, ignore_case: bool = False, portable: bool = True) -> str:
    """A literal word. portable: with classes that all engines read alike; else with Unicode word borders."""
    quoted, flag = re.sub(r"([^\w\s])", r"\\\1", term), "(?i)" if ignore_case else ""
    if portable:
        return rf"{flag}(^|[^\p{{L}}\p{{N}}_]){quoted}([^\p{{L}}\p{{N}}_]|$)"
    return rf"(?U){flag}\b{quoted}\b"


def has_word(text: Column | str, term: str, ignore_case: bool = False) -> Column:
    return col(text).rlike(word_pattern(term, ignore_case))


def glob_pattern(glob: str) -> str:
    """Anchored pattern of a glob: **/ any folders, ** anything, * within a segment, ? one character of it."""
    out, i = "", 0
    while i < len(glob):
        for mark, regex in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if glob.startswith(mark, i):
                out, i = out + regex, i + len(mark)
                break
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def name_pattern(glob: str) -> str:
    """As glob_pattern, for file names: * and ? stand for any characters, case aside."""
    return "(?i)^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def icontains(text: Column | str, part: Column | str) -> Column:
    return F.contains(F.lower(col(text)), F.lower(F.lit(part) if isinstance(part, str) else part))


# Lines ---------------------------------------------------------------------


def lines(text: Column | str) -> Column:
    return F.split(col(text), "\n")


def strip(x: Column) -> Column:
    """Without white space of any kind on either side."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def first_line_where(text: Column | str, test) -> Column:
    """The first line that passes a test, trimmed; null where none does."""
    return strip(F.get(F.filter(lines(text), test), F.lit(0)))


def match_line(text: Column | str, pattern: str) -> Column:
    return first_line_where(text, lambda x: x.rlike(pattern))


def match_lines(text: Column | str, pattern: str, most: int = 3) -> Column:
    hits = F.transform(F.filter(lines(text), lambda x: x.rlike(pattern)), lambda x: F.trim(x))
    return F.array_join(F.slice(hits, 1, most), " | ")


def preview_line(text: Column | str) -> Column:
    """The first line of code: not blank, no comment, no attribute, no bracket alone."""
    return first_line_where(text, lambda x: ~F.trim(x).rlike(r"^$|^(//|#|/\*|\*|\[<|@)|^[\[\]{}();]+$"))


def first_snippet(text: Column | str, most: int = 120) -> Column:
    line = F.coalesce(first_line_where(text, lambda x: F.trim(x) != ""), F.lit(""))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


# Lines that are no prose: headings, bullets, tables, fences, images, and lines that are only a link.
NO_PROSE = r"^(#|-|\||```|!\[)|^\[.+\]\(.+\)$"


def summary_line(text: Column | str, most: int = 120) -> Column:
    """The first line of prose over ten characters (under forty with an asterisk in front is none); else the whole text on one line
    without its first heading marks; "(no summary)" for none."""

    def prose(line: Column) -> Column:
        x = strip(line)
        return (F.length(x) > 10) & ~x.rlike(NO_PROSE) & ~(x.startswith("*") & (F.length(x) < 40))

    flat = strip(F.regexp_replace(strip(F.translate(col(text), "\n\r", "  ")), r"^#+\s*", ""))
    s = F.coalesce(first_line_where(text, prose), F.when(flat != "", flat), F.lit("(no summary)"))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(col(text), "[ \n\t]"), lambda w: w != ""))


# Tokens --------------------------------------------------------------------


def token_set(text: Column | str) -> Column:
    """Distinct runs of three or more ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z0-9]{3,})"), F.lit(1)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    shared, whole = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0), shared / whole).otherwise(0.0)


def status_text(text: Column | str) -> Column:
    """Text for comparing status notes: numbers as #, no punctuation, single spaces."""
    x = F.regexp_replace(F.lower(col(text)), r"\b\d+\b", "#")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s#]", " "), r"\s+", " "))


def clamp01(x: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def rounded(x: Column | str, places: int = 3) -> Column:
    """Rounded half to even."""
    return F.bround(col(x), places)


def contains_any(text: Column | str, terms: list[str] | tuple[str, ...]) -> Column:
    """Does the text hold one of some terms, case aside?"""
    low, found = F.lower(F.coalesce(col(text), F.lit(""))), F.lit(False)
    for t in terms:
        found = found | low.contains(t)
    return found


def hits(text: Column | str, terms: list[str] | tuple[str, ...]) -> Column:
    """Those of some terms that the text holds, in their order."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(t), t) for t in terms]))


def artifact_ids(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(r"(?i)\ba-[a-z0-9]{8}\b"))


def has_date(text: Column | str) -> Column:
    return col(text).rlike(r"\b20\d{2}[-/]\d{2}[-/]\d{2}\b")


# Knowledge and entities ----------------------------------------------------

# Phrases of knowledge and of hedging, by weight; what code files are called.
PRESCRIPTIVE = (" should ", " must ", " always ", " never ", " when ", " ensure ", " requires ", " depends on ", " means that ")
CAUSAL = (" because ", " therefore ", " so that ", " in order to ", " consequence ", " implies ", " leads to ")
DECLARATIVE = (" is a ", " are ", " defines ", " represents ", " consists of ", " handles ", " processes ")
HEDGING = (" maybe ", " perhaps ", " i wonder ", " not sure ", " might ", " could be ", " i think ", "?")
CODE_FILE = r"\b\w+\.(fs|cs|js|ts|py|md)\b"

# Patterns of entities, in the order in which they are looked for.
ENTITY_FILE = r"`([A-Za-z]\w+\.(?:fs|cs|fsx|js|ts|py|go|rs|yaml|json|md|toml))`"
ENTITY_BARE = r"\b([A-Z][A-Za-z]+\.(?:fs|cs|js|ts|py))\b"
ENTITY_MODULE = r"\b((?:[A-Z][A-Za-z]+\.){1,4}[A-Z][A-Za-z]+)\b"
ENTITY_NAME = r"`([A-Z][A-Za-z]{2,}(?:\.[A-Z][A-Za-z]+)*)`"
ENTITY_PATH = r"`((?:\.agents|src|tests|architecture)/[^\s`]+)`"
ENTITY_SUFFIX = r"(?i)\.(fs|cs|fsx|js|ts|py|go|rs|yaml|json|md|toml)$"

#: Leading namespaces that don't tell entities apart; a project adds its own.
NAMESPACES = ("System.", "Microsoft.")


def knowledge_signal(text: Column | str, names: Column | None = None) -> Column:
    """An integer: prescriptive, causal and declarative phrases and code files for, hedging and shortness against.

    names: how many of the index's headings the text holds, a column, if known.
    """
    low, score = F.lower(col(text)), F.lit(0)
    for weight, phrases in ((2, PRESCRIPTIVE), (2, CAUSAL), (1, DECLARATIVE), (-2, HEDGING)):
        for phrase in phrases:
            score = score + F.when(low.contains(phrase), weight).otherwise(0)
    score = score + 2 * F.regexp_count(col(text), F.lit(CODE_FILE)) - F.when(F.length(col(text)) < 50, 2).otherwise(0)
    return score if names is None else score + names


def normalize_entity(e: Column | str, namespaces: tuple[str, ...] = NAMESPACES) -> Column:
    x = col(e)
    for n in namespaces:
        x = F.regexp_replace(x, "(?i)^" + re.escape(n), "")
    return F.lower(F.regexp_replace(x, ENTITY_SUFFIX, ""))


def entity_refs(text: Column | str, namespaces: tuple[str, ...] = NAMESPACES) -> Column:
    """Distinct normalised entities that a text names: files, modules, types in back-ticks and paths."""

    def found(pattern: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1)))

    modules = F.filter(found(ENTITY_MODULE), lambda m: ~m.rlike(r"\.(fs|cs|js|md)$"))
    names = F.filter(found(ENTITY_NAME), lambda m: ~m.rlike(r"\.\w{1,4}$"))
    paths = F.transform(found(ENTITY_PATH), lambda m: F.substring_index(m, "/", -1))
    every = F.concat(found(ENTITY_FILE), found(ENTITY_BARE), modules, names, paths)
    every = F.transform(F.array_distinct(every), lambda e: normalize_entity(e, namespaces))
    return F.array_distinct(F.filter(every, lambda e: F.length(e) >= 3))


def entity_importance(e: Column | str, indexed: Column | None = None) -> Column:
    """Length, dots and being an indexed file make an entity important."""
    x = col(e)
    shape = F.when(x.contains("."), 2).when(F.length(x) > 12, 1).otherwise(0)
    return F.least(F.lit(5), F.floor(F.length(x) / 3).cast("int")) + F.when(F.coalesce(indexed, F.lit(False)) if indexed is not None else F.lit(False), 3).otherwise(0) + shape


# Terms of status sections, their points, and claims of authority.
STATUS_HEADING = ("status", "progress", "current", "wave", "gate", "baseline", "platform note", "context snapshot")
STATUS_TEXT = ("current status", "current gate", "active wave", "delivered", "tests baseline", "current platform note", "currently")
STATUS_WORDS = ("tests", "passing", "baseline", "wave", "gate")
AUTHORITY = ("current authority", "latest authority", "next authority", "current gate", "active wave", "current status", "latest status", "next gate", "current recommendation")
NO_AUTHORITY = ("not current", "not the current", "not latest", "not the latest", "not next", "not the next")


def status_score(heading: Column | str, content: Column | str) -> Column:
    text = F.concat_ws("\n", col(heading), col(content))
    points = [(2, contains_any(heading, STATUS_HEADING)), (2, contains_any(text, STATUS_TEXT)), (1, contains_any(text, STATUS_WORDS))]
    return sum((F.when(c, n).otherwise(0) for n, c in points), F.lit(0))


def claims_authority(text: Column | str) -> Column:
    return contains_any(text, AUTHORITY) & ~contains_any(text, NO_AUTHORITY)


def mentions_entity(text: Column | str, entity: Column | str) -> Column:
    """Does a text hold an entity as it is, with spaces for dots, or with its separators closed up?"""
    low, e = F.lower(col(text)), col(entity)
    compact = F.regexp_replace(e, r"[.\-_]", "")
    return F.contains(low, e) | F.contains(low, F.replace(e, F.lit("."), F.lit(" "))) | ((compact != e) & F.contains(F.replace(low, F.lit(" "), F.lit("")), compact))


def normalize_action(action: Column | str) -> Column:
    a = col(action)
    return F.when(a == "replace_with_pointer", "link").when(a == "compact", "reduce").when(a == "move_to_archive", "archive").when(a == "needs_owner", "needs_human_review").otherwise(a)


def determine_action(proposed: Column | str, confidence: Column | str, risk: Column | str) -> Column:
    return F.when((col(confidence) < 0.70) | (col(risk) == "high"), "needs_human_review").otherwise(col(proposed))


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
