"""PII (native): surrogate generation.

Entities (e-mail addresses, IPv4 and IPv6 addresses, telephone, card and social security numbers, IBANs, secrets after a key word, with a
known prefix or as long hexadecimal strings, and names after a title) are found by one pattern and replaced by keyed surrogates of the same type and
format. A person who has a title once in a text is found there without it too: the full name, the surname, a given name. Built-in
functions only.

Characters are replaced within their kind (digit, letter, hexadecimal digit, octet), case and punctuation stay. Each
is shifted by a keyed hash of those before it, once from either end: for a format this is a permutation, so different
entities never get one surrogate, and no table is needed (a surrogate may by chance be a value that stands elsewhere, which then has another
surrogate itself). The key of the hash holds the type, and what is permuted is the canonical
value (lower-cased, separators aside), so that an entity keeps its surrogate in every document and spelling. An e-mail address with letters
beyond ASCII is permuted as the hexadecimal digits of its bytes.
What gives the type away stays: top-level domain, country prefix, a card's first digit, a valid Luhn digit, an IBAN's country, a secret's prefix.

The key is a parameter: `key_of` reads it from the session (spark.sextant.pii.secret); unset, the session draws one that nobody knows,
so that its runs agree, those of other sessions don't, and nothing can be undone from the code.

Names are replaced word by word: a given name gets one of the person's gender (from the title) and script, a surname a surname, from
lists, by a keyed hash (scripts without a list get Latin ones); particles (van, de) stay. Words that draw the same are told apart: the distinct
words are ranked within what they drew (the collision check), and a rank above 0 adds syllables that spell it; a listed name that is some
real person's too has no rank 0. So equal surnames stay equal and others differ, whether alone or
after a given name, in every text. Names travel as a table with a row for each distinct word and person.

Scale: texts aren't shuffled; e-mails, numbers and secrets need no exchange at all. Only when there are names, their distinct
values are shuffled (ranks are counted in SPREAD ranges of a hash, so that no drawn name is one task's), and the texts that have them look their surrogates up (broadcast up to SMALL rows, else a join).

Defined cases: a null text stays null and has no entities; an empty text stays empty; null doc_id and repeated rows pass as
they are; equal entities get equal surrogates everywhere; an empty table gives no rows; further columns pass through,
columns named like `OUT` are replaced.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import cut, read_table

OUT = ("entities",)
SMALL = 50_000
#: Ranges of a hash in which the words that drew the same name are ranked.
SPREAD = 64
KEY = "spark.sextant.pii.secret"

# Titles by gender, and the surrogate lists by script and gender.
TITLES_F = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mlle|Госпожа|Г-жа|Κυρία|Κα"
TITLES_M = "Mr|Herr|Señor|Sr|Monsieur|M|Господин|Г-н|Κύριος|Κος"
TITLES_N = "Dr|Prof"
FIRST = {
    ("latin", "f"): "Alma Berta Carla Dora Edith Flora Greta Hanna Irma Julia Klara Lena Maria Nora Olga Paula Rosa Sara Thea Vera",
    ("latin", "m"): "Adam Bruno Carlo David Emil Franz Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Peter Robin Simon Theo Victor",
    ("latin", "n"): "Alex Chris Dominique Eden Frankie Gabriel Jamie Kim Lou Morgan Noor Quinn Robin Sasha Toni Andrea Camille Jules Rene Sam",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Полина Раиса София Татьяна",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей",
    ("cyrillic", "n"): "Саша Женя Валя Слава Паша",
    ("greek", "f"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Νίκη Σοφία Φωτεινή",
    ("greek", "m"): "Αλέξης Βασίλης Γιάννης Δημήτρης Κώστας Νίκος Πέτρος Στέλιος",
    ("greek", "n"): "Φώτη Χάρη Άρη Σταύρη",
}
LAST = {
    "latin": "Abel Brandt Castell Dorn Ebert Falk Garner Hollis Ibarra Jansen Keller Lindt Moreau Norden Orlow Prado Quist Roth Sander Tellier Urban Vidal Weston Ximenes Yates Zeller",
    "cyrillic": "Белов Волков Громов Данилов Ершов Жуков Зимин Козлов Лебедев Морозов Новиков Орлов Павлов Соколов Титов",
    "greek": "Αγγέλου Βλάχος Γεωργίου Δήμου Ζέρβας Κόλλιας Λάμπρου Μακρής Νικολάου Παππάς Ρήγας Σταθόπουλος",
}
#: Scripts that have lists of their own, and how their words are told.
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
SYLLABLES = {"latin": "ba ce di fo gu ha je ki lo mu na pe ri so tu va".split(), "cyrillic": "ба ве ги до ду жа зе ки ло му на пе ри со ту фа".split(), "greek": "βα γε δι ζο θυ κα λε μι νο ξυ πα ρε σι το φυ χα".split()}

#: Particles of surnames, directly after a title; MIDDLE also after a given name, where the others may be articles.
MIDDLE = "van der|van den|van de|von der|van|von|bin|ibn|della|dos"
PARTICLES = MIDDLE + "|de la|de|del|di|da|du|des|la|le|zu|den|ter|ten"
#: A word of a name: letters after a capital (McDonald, SMITH), with apostrophes (O'Brien, not Smith's), hyphens between such.
_LETTERS = r"\p{Lu}\p{M}*(?:['’]\p{L})?[\p{L}\p{M}]+(?:['’]\p{Lu}[\p{L}\p{M}]+)*"
_WORD = rf"{_LETTERS}(?:-{_LETTERS})*"
_INITIALS = r"(?:(?:\p{Lu}\.)+ ){0,4}"
NAME = rf"(?:(?:{PARTICLES}) )?{_INITIALS}{_WORD}(?: {_INITIALS}(?:(?:{MIDDLE}) )?{_WORD}){{0,2}}"
TITLE = rf"(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\.? "

_NUM = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"
_LOCAL = r"[\p{L}\p{N}._%+\-]"
_HEX = "[0-9a-fA-F]"
_TITLED = "(?=[" + "".join(sorted({t[0] for t in f"{TITLES_F}|{TITLES_M}|{TITLES_N}".split("|")})) + "])"
#: Each begins with what is told by a character or two: most places of a text are left there, before any look behind. An e-mail address that isn't
#: found where a run of its characters begins (or the last entity ended) isn't found further on in the run either.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[\p{{L}}\p{{N}}\-]+(?:\.[\p{{L}}\p{{N}}\-]+)*\.\p{{L}}{{2,}}",
    "ipv6": rf"(?={_HEX}{{1,4}}:)" + r"(?<![\p{L}\p{N}:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:(?:[0-9a-fA-F]{1,4}:){2,6}|fe80:):(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,4})?)(?![\p{L}\p{N}:])",
    "ip": "(?=[0-9])" + _NUM + r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)" + _END,
    "secret": r"(?<=[=:\s\"'])(?<=[=:]\s{0,2}[\"']?)(?i:(?<=(?:token|key|secret|passwd|password|pwd)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_\-+/=]{8,})|(?=[0-9a-fA-Fgxs])" + _NUM + r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[baprs]-[A-Za-z0-9\-]{10,}|sk-[A-Za-z0-9_\-]{20,}|[0-9a-fA-F]{32,})" + _END,
    "iban": r"(?=[A-Z]{2}\d{2})" + _NUM + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": r"(?=\d)" + _NUM + r"\d(?:[ \-]?\d){12,18}" + _END,
    "ssn": r"(?=\d{3}-)" + _NUM + r"\d{3}-\d{2}-\d{4}" + _END,
    "phone": r"(?=[+(\d])(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}|\d{3}[.\-]\d{3,4}[.\-]\d{4})" + _END + r"|(?=\+)(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}" + _END,
    "name": rf"{_TITLED}{_NUM}{TITLE}{NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these hold no entity: a cheap first look, which covers each alternative of ANY. Each is a pass of its own, since an alternation is
#: tried at every place. What must be in a text for a pattern comes with it; nothing: the pattern alone.
HINTS = (
    (("@",), "@"), ((), r"[0-9][.\- ]?[0-9]"), ((":",), "[0-9a-fA-F]:[0-9a-fA-F:]"), (("AKIA", "ASIA"), "AKIA|ASIA"), (("gh",), "gh[pousr]_"), (("xox",), "xox[baprs]-"), (("sk-",), r"sk-[A-Za-z0-9_\-]{20}"),
    (("=", ":"), r"[=:](?<=(?i:token|key|secret|passwd|password|pwd)\s{0,2}[=:])"), ((), rf"{_HEX}{{32}}"), ((), rf"{_TITLED}{_NUM}{TITLE}(?:\p{{Lu}}|(?:{PARTICLES}) )"),
)
HINT = "|".join(p for _, p in HINTS)


def may_hold(text: Column) -> Column:
    """HINT, pattern by pattern."""
    out = F.lit(False)
    for needs, p in HINTS:
        held = F.lit(False)
        for x in needs:
            held = held | text.contains(x)
        out = out | (held if needs == (p,) else held & text.rlike(p) if needs else text.rlike(p))
    return out


def once(f: Callable[..., Column], **values: Column) -> Column:
    """f of values that are computed once: a column that f's lambdas name is computed for each of their elements."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, lambda x: f(**{k: x[k] for k in values})), F.lit(0))


def kind(e: Column) -> Column:
    """The type of an entity that ANY has found."""
    digits = F.length(F.regexp_replace(e, r"\D", ""))
    return (
        F.when(e.rlike(rf"^{TITLE}{NAME}$"), "name")
        .when(e.contains("@"), "email")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(e.rlike(r"^[0-9a-fA-F:]*:[0-9a-fA-F:]*$"), "ipv6")
        .when(e.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3}"), "iban")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[+(]|^\d{3}[.\-]\d{3,4}[.\-]\d{4}$"), "phone")
        .when(e.rlike(r"^\d(?:[ \-]?\d){12,18}$") & digits.between(13, 19), "card")
        .otherwise("secret")
    )


def _is(c: Column, a: str, b: str) -> Column:
    return c.between(a, b) & (F.length(c) == 1)


def permuted(value: Column, key: Column, letters: Column) -> Column:
    """A string of digits and lower-case letters, each shifted by a hash of the key and of all before it; then the same from the back.

    For a given length and pattern of kinds this is a permutation. letters: how many letters there are (6: a to f).
    """

    def one_way(x: Column, way: str, key: Column, letters: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            h = F.shiftrightunsigned(F.xxhash64(key, F.lit(way), acc["seen"]), 24)
            digit = F.char((F.ascii(c) - 48 + h) % 10 + 48)
            letter = F.char((F.ascii(c) - 97 + h) % letters + 97)
            out = F.when(_is(c, "0", "9"), digit).when(_is(c, "a", "z") & (F.ascii(c) - 97 < letters), letter).otherwise(c)
            return F.struct(F.concat(acc["seen"], c).alias("seen"), F.concat(acc["out"], out).alias("out"))

        start = F.struct(F.lit("").alias("seen"), F.lit("").alias("out"))
        return F.aggregate(F.split(x, ""), start, step)["out"]

    return once(lambda value, key, letters: F.reverse(one_way(F.reverse(one_way(value, "front", key, letters)), "back", key, letters)), value=value, key=key, letters=letters)


def plain(e: Column) -> Column:
    """The canonical value: ASCII digits and letters, lower-cased."""
    return F.lower(F.regexp_replace(e, "[^A-Za-z0-9]", ""))


def filled(template: Column, value: Column) -> Column:
    """The template with its ASCII digits and letters replaced by those of value in turn, in the template's case."""

    def all_of(value: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            upper = _is(c, "A", "Z")
            slot = upper | _is(c, "a", "z") | _is(c, "0", "9")
            new = F.substring(value, acc["at"], F.lit(1))
            out = F.when(upper, F.upper(new)).when(slot, new).otherwise(c)
            return F.struct((acc["at"] + slot.cast("int")).alias("at"), F.concat(acc["out"], out).alias("out"))

        return F.aggregate(F.split(template, ""), F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step)["out"]

    return once(all_of, value=value)


def _mid(e: Column, key: Column, before: Column, after: Column, letters: Column) -> Column:
    """Permutes e, but for its first `before` and last `after` digits and letters."""

    def of(p: Column, before: Column) -> Column:
        left, right = F.substring(p, F.lit(1), before), F.when(after > 0, F.right(p, after)).otherwise("")
        mid = F.substring(p, before + 1, F.length(p) - before - after)
        return F.concat(left, permuted(mid, F.xxhash64(key, left, right, F.length(p)), letters), right)

    return filled(e, once(of, p=plain(e), before=before))


def luhn(digits: Column) -> Column:
    """The Luhn check digit of a string of digits."""

    def step(acc: Column, c: Column) -> Column:
        d = (F.ascii(c) - 48) * F.when(acc["two"], 2).otherwise(1)
        d = F.when(F.length(c) == 0, 0).otherwise(d - F.when(d > 9, 9).otherwise(0))
        return F.struct((acc["sum"] + d).alias("sum"), F.when(F.length(c) == 0, acc["two"]).otherwise(~acc["two"]).alias("two"))

    total = F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(True).alias("two")), step)["sum"]
    return (10 - total % 10) % 10


def _card(e: Column, key: Column) -> Column:
    """First digit kept; the last keeps its distance from the Luhn digit, so that valid numbers stay valid and others not."""

    def of(p: Column) -> Column:
        first, body, last = F.left(p, F.lit(1)), F.substring(p, F.lit(2), F.length(p) - 2), F.right(p, F.lit(1)).cast("int")
        new = F.concat(first, permuted(body, F.xxhash64(key, first, F.length(p)), F.lit(26)))
        off = last - luhn(F.concat(first, body)) + 10
        return once(lambda new: F.concat(new, ((luhn(new) + off) % 10).cast("string")), new=new)

    return filled(e, once(of, p=plain(e)))


def _ip(e: Column, key: Column) -> Column:
    """Each octet stays among those of as many digits: 0 to 9, 10 to 99, 100 to 255."""

    def one_way(x: Column, way: str, key: Column) -> Column:
        def step(acc: Column, o: Column) -> Column:
            low = F.when(o < 10, 0).when(o < 100, 10).otherwise(100)
            n = F.when(o < 10, 10).when(o < 100, 90).otherwise(156)
            h = F.shiftrightunsigned(F.xxhash64(key, F.lit(way), acc["seen"]), 24)
            new = ((o - low + h) % n + low).cast("int")
            return F.struct(F.concat_ws(".", acc["seen"], o.cast("string")).alias("seen"), F.concat(acc["out"], F.array(new)).alias("out"))

        start = F.struct(F.lit("").alias("seen"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, start, step)["out"]

    octets = F.transform(F.split(e, r"\."), lambda o: o.cast("int"))
    both = once(lambda octets, key: F.reverse(one_way(F.reverse(one_way(octets, "front", key)), "back", key)), octets=octets, key=key)
    return F.array_join(F.transform(both, lambda o: o.cast("string")), ".")


def _email(e: Column, key: Column) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    name, top = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), F.substring_index(domain, ".", -1)
    zero = F.lit(0)

    def part(x: Column, k: str) -> Column:
        return once(lambda x, own: of(x, own), x=x, own=F.xxhash64(key, F.lit(k)))

    def of(x: Column, own: Column) -> Column:
        coded = F.concat(F.lit("x"), permuted(F.lower(F.hex(F.encode(F.lower(x), "UTF-8"))), F.xxhash64(own, F.lit("bytes")), F.lit(6)))
        return F.when(x.rlike(r"[^\x00-\x7F]"), coded).otherwise(_mid(x, own, zero, zero, F.lit(26)))

    return F.concat(part(local, "local"), F.lit("@"), part(name, "domain"), F.lit("."), top)


def surrogate(e: Column, t: Column, secret: str) -> Column:
    """The surrogate of an entity of type t, names aside."""
    return once(_surrogate, e=e, t=t, key=F.xxhash64(F.lit(secret), t))


def _surrogate(e: Column, t: Column, key: Column) -> Column:
    mark = F.length(plain(F.regexp_extract(e, r"^(AKIA|ASIA|gh[pousr]_|xox[baprs]-|sk-)", 1)))
    zero, hexes = F.lit(0), F.when(plain(e).rlike("^[0-9a-f]*$"), 6).otherwise(26)
    country = F.length(F.regexp_replace(F.regexp_extract(e, r"^\+(\d{1,3})(?=[ .\-(])", 1), r"\D", ""))
    return (
        F.when(t == "email", _email(e, key))
        .when(t == "ip", _ip(e, key))
        .when(t == "card", _card(e, key))
        .when(t == "iban", _mid(e, key, F.lit(2), zero, F.lit(26)))
        .when(t == "phone", _mid(e, key, country, zero, F.lit(26)))
        .when(t == "ssn", _mid(e, key, zero, zero, F.lit(26)))
        .otherwise(_mid(e, key, mark, zero, hexes))
    )


def person(e: Column) -> Column:
    """The canonical value of a name: without its title, lower-cased, particles marked."""
    name = F.regexp_replace(F.regexp_replace(e, rf"^{TITLE}", ""), "’", "'")
    return F.lower(F.regexp_replace(name, rf"(?<!\S)({PARTICLES})(?= )", "·$1"))


def _pick(words: str, h: Column) -> Column:
    items = words.split()
    return F.element_at(F.array(*[F.lit(w) for w in items]), (F.pmod(h, F.lit(len(items))) + 1).cast("int"))


def _spelt(n: Column, syllables: list[str]) -> Column:
    """A number in syllables, one for each hexadecimal digit."""
    table = F.array(*[F.lit(x) for x in syllables])
    return F.array_join(F.transform(F.split(F.hex(n.cast("long")), ""), lambda c: F.get(table, F.conv(c, 16, 10).cast("int"))), "")


def words(person: Column) -> Column:
    """The words of a canonical name, each with its particle."""
    return F.regexp_extract_all(person, F.lit(rf"(?:·(?:{PARTICLES}) )?\S+"), F.lit(0))


def name_table(names: DataFrame, secret: str) -> DataFrame:
    """(person, mention, rank, surrogate) of names (e, with titles): how each distinct person may be mentioned; less rank first.

    Mentions are the full name (0), the surname (1) and given names (2). No two words of a kind have one surrogate.
    """
    gender = F.when(F.col("e").rlike(rf"^(?:{TITLES_F})\.? "), "f").when(F.col("e").rlike(rf"^(?:{TITLES_M})\.? "), "m").otherwise("n")
    # A title with a gender outweighs one without; of two, the lesser letter.
    persons = names.groupBy(person(F.col("e")).alias("person")).agg(F.min(gender).alias("gender"))
    parts = persons.select("person", "gender", F.size(words(F.col("person"))).alias("n"), F.posexplode(words(F.col("person"))).alias("at", "part"))
    parts = parts.withColumn("particle", F.regexp_extract("part", rf"^·((?:{PARTICLES}) )", 1)).withColumn("word", F.regexp_replace("part", rf"^·(?:{PARTICLES}) ", ""))
    parts = parts.withColumn("kind", F.when(F.col("at") == F.col("n") - 1, "last").otherwise(F.col("gender")))
    script = F.lit("latin")
    for name, pattern in SCRIPTS.items():
        script = F.when(F.col("word").rlike(pattern), name).otherwise(script)
    distinct = parts.select("kind", "word").distinct().withColumn("script", script)
    h = F.xxhash64(F.lit(secret), F.when(F.col("kind") == "last", "last").otherwise("first"), F.col("word"))
    drawn = F.lit(None).cast("string")
    for (script, g), items in (FIRST | {(script, "last"): items for script, items in LAST.items()}).items():
        drawn = F.when((F.col("script") == script) & (F.col("kind") == g), _pick(items, h)).otherwise(drawn)
    # The collision check: words that drew the same are ranked (given names of all genders together), one of its own for each rank above 0.
    distinct = cut(distinct.withColumns({"drawn": drawn, "last": F.col("kind") == "last", "range": F.pmod(F.shiftright(h, 8), F.lit(SPREAD)).cast("int")}))
    sizes = distinct.groupBy("last", "drawn", "range").agg(F.count("*").alias("n"))  # SPREAD rows for each listed name at most
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("last", "drawn").orderBy("range")) - F.col("n")).drop("n")
    real = distinct.select("last", F.col("word").alias("_real")).distinct()
    taken = before.select("last", "drawn").distinct().join(real.withColumnRenamed("last", "_l"), (F.col("last") == F.col("_l")) & (F.lower("drawn") == F.col("_real")), "left_semi").withColumn("taken", F.lit(1))
    before = before.join(taken, ["last", "drawn"], "left").fillna(0, ["taken"])
    distinct = distinct.join(F.broadcast(before), ["last", "drawn", "range"])  # bounded by the lists
    rank = F.row_number().over(Window.partitionBy("last", "drawn", "range").orderBy(h, "word", "kind")) - 1 + F.col("before") + F.col("taken")
    distinct = distinct.withColumn("rank", rank)
    spelt = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        spelt = F.when(F.col("script") == script, _spelt(F.col("rank"), syllables)).otherwise(spelt)
    distinct = distinct.select("kind", "word", F.when(F.col("rank") > 0, F.concat("drawn", F.lit("-"), F.initcap(spelt))).otherwise(F.col("drawn")).alias("new"))
    parts = parts.join(distinct, ["kind", "word"])
    full = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("particle", "new").alias("s")))), lambda x: x["s"]), " ")
    whole = parts.groupBy("person").agg(full.alias("surrogate")).select("person", F.col("person").alias("mention"), F.lit(0).alias("rank"), "surrogate")
    one = parts.filter(~F.col("word").endswith(".")).select("person", F.col("word").alias("mention"), F.when(F.col("kind") == "last", 1).otherwise(2).alias("rank"), F.col("new").alias("surrogate"))
    return whole.unionByName(one)


def mention_pattern(mentions: Column) -> Column:
    """ANY, or one of a text's own mentions (canonical values), longer ones first."""
    longest = F.transform(F.array_sort(F.transform(mentions, lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m")))), lambda x: x["m"])

    def literal(m: Column) -> Column:
        return F.regexp_replace(F.replace(F.replace(m, F.lit("."), F.lit("[.]")), F.lit("'"), F.lit("['’]")), rf"·({PARTICLES}) ", "(?-i:$1) ")

    start = rf"{ANY}|{_NUM}(?=\p{{Lu}}|(?:{PARTICLES}) )(?iu:"
    return F.concat(F.lit(start), F.array_join(F.transform(longest, literal), "|"), F.lit(f"){_END}"))


def key_of(spark: SparkSession) -> str:
    """The session's key; where there is none, one is drawn and kept for the session."""
    if not spark.conf.get(KEY, None):
        spark.conf.set(KEY, secrets.token_hex(16))
    return spark.conf.get(KEY)


def with_surrogates(docs: DataFrame, secret: str) -> DataFrame:
    """docs with a column text: replaces the entities in it, and adds entities, an array of (type, surrogate) in order. secret: the key."""
    docs = docs.drop(*OUT)
    titled = docs.filter(F.col("text").rlike(PATTERNS["name"])).select(F.xxhash64("text").alias("_h"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERNS["name"]), F.lit(0)))).alias("e"))
    titled = cut(titled.distinct())
    named = None
    if titled.limit(1).count():
        names = cut(name_table(titled, secret))
        mine = titled.select("_h", person(F.col("e")).alias("person")).distinct()
        found = mine.join(F.broadcast(names) if names.count() <= SMALL else names, "person")
        found = found.groupBy("_h", "mention").agg(F.min_by("surrogate", F.struct("rank", "surrogate")).alias("s"))
        found = cut(found.groupBy("_h").agg(F.map_from_entries(F.collect_list(F.struct("mention", "s"))).alias("_named")))
        docs = docs.withColumn("_key", F.xxhash64("text")).join(F.broadcast(found) if found.count() <= SMALL else found, F.col("_key") == F.col("_h"), "left").drop("_key", "_h")
        named = F.col("_named")
        docs = docs.withColumn("_any", F.when(named.isNotNull(), mention_pattern(F.map_keys(named))))
    looked = may_hold(F.col("text"))
    none = F.array().cast("array<struct<type:string,surrogate:string>>")

    def by_pattern(f) -> Column:
        """f of the pattern that a text is searched with."""
        return f(F.lit(ANY)) if named is None else F.when(named.isNull(), f(F.lit(ANY))).otherwise(f(F.col("_any")))

    def replaced(e: Column) -> Column:
        return once(lambda e, t: of_kind(e, t), e=e, t=kind(e))

    def of_kind(e: Column, t: Column) -> Column:
        if named is None:
            return F.struct(t.alias("type"), surrogate(e, t, secret).alias("surrogate"))
        return once(lambda e, t, new: of_name(e, t, new), e=e, t=t, new=F.try_element_at(named, person(e)))

    def of_name(e: Column, t: Column, new: Column) -> Column:
        s = F.when(new.isNotNull(), F.concat(F.regexp_extract(e, rf"^{TITLE}", 0), new)).otherwise(surrogate(e, t, secret))
        return F.struct(F.when(new.isNotNull(), "name").otherwise(t).alias("type"), s.alias("surrogate"))

    docs = docs.withColumn("_found", F.when(looked, by_pattern(lambda p: F.regexp_extract_all("text", p, F.lit(0)))))
    docs = docs.withColumn("entities", F.when(F.size("_found") > 0, F.transform("_found", replaced)).otherwise(none))
    parts = by_pattern(lambda p: F.split("text", p, -1))
    joined = F.array_join(F.transform(parts, lambda x, i: F.concat(x, F.coalesce(F.get(F.col("entities")["surrogate"], i), F.lit("")))), "")
    return docs.withColumn("text", F.when(F.size("entities") > 0, joined).otherwise(F.col("text"))).drop("_found", "_named", "_any")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_surrogates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), F.array_join(F.col("entities")["type"], " ").alias("types"))
