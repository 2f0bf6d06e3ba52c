"""The command line: index, look, evaluate.

    python -m sextant.cli --index DIR index-code ROOT | index-docs ROOT | preflight ROOT | status | history | compare
    python -m sextant.cli --index DIR orphans | broken | catalog | modules | hotspots | gaps | hygiene | sessions | scopes
    python -m sextant.cli --index DIR stale ROOT | health ROOT     (files under ROOT tell what is newer)
    python -m sextant.cli --index DIR search code|docs TEXT | check TEXT     (embed the text with the configured server; - reads standard input)
    python -m sextant.cli --index DIR eval 'grep(docs, "word", 5)' [--json]     (- reads the expression from standard input)
    python -m sextant.cli --index DIR repl     (expressions from standard input, one a line; what they assign stays; :quit ends)
    python -m sextant.cli --index DIR fn add NAME PARAMS BODY | fn list | fn rm NAME
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from sextant.operators import bridge, code, docs, hygiene, scan
from sextant.plans import expr, index
from sextant.plans.format import render, stamped
from sextant.plans.rows import plain
from sextant.plans.storage import Catalog, read_text, write_text
from sextant.session import session
from sextant.sources.embeddings import Fault, Http
from sextant.sources.files import Config, in_scope, read_files

FACTS = ["chunks", "imports", "signatures"]


def tables(catalog: Catalog, dirs: list[str] | None = None) -> dict[str, DataFrame]:
    """The names of an expression's tables; dirs: a scope."""
    c = catalog.table("code_chunks").join(catalog.table("code_source").select("chunk_id", "content"), "chunk_id", "left")
    out = {"code": c, "imports": catalog.table("imports"), "type_refs": catalog.table("type_refs"), "docs": catalog.table("doc_source"), "sections": catalog.table("doc_sections"), "links": catalog.table("doc_links"), "frontmatters": catalog.table("frontmatters")}
    return {k: v.filter(in_scope("file_path", dirs)) if dirs and "file_path" in v.columns else v for k, v in out.items()}


def primitives() -> dict[str, object]:
    """What an expression may call, besides tables: every primitive by its name; those of one index under its prefix."""
    names = {k: getattr(scan, k) for k in ("grep", "mentions", "neighborhood", "similar", "search", "changed", "breakdown", "dense_folders")}
    names |= {f"code_{k}": getattr(code, k) for k in ("context", "impact", "imports_of", "dependents_of", "expand", "files", "modules", "refs", "callers", "walk", "hotspots", "trace")}
    names |= {f"docs_{k}": getattr(docs, k) for k in ("catalog", "context", "expand", "files", "backlinks", "links_of", "orphans", "broken", "placement", "novelty", "walk", "gaps", "cluster")}
    return names | {"drift": bridge.drift, "coverage": bridge.coverage, "hygiene": hygiene.findings}


def shown(value: object, source: str, as_json: bool) -> str:
    return render(stamped(value, source), as_json=as_json) if isinstance(value, DataFrame) else str(value)


def repl(lines: Iterable[str], names: dict[str, object], as_json: bool = False) -> Iterator[str]:
    """What each line says: a line that fails is told and changes nothing."""
    for text in map(str.strip, lines):
        if text == ":quit":
            return
        if not text or text.startswith("#"):
            continue
        try:
            value, own = expr.run(text, names)
            names = names | own
            if not own or list(own.values())[-1] is not value:
                yield shown(plain(value), "repl", as_json)
        except Exception as e:  # noqa: BLE001 - a wrong expression doesn't end the loop
            yield f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[str, int]:
    """The text to print and the exit code."""
    catalog, rest = Catalog(spark, args.index), args.rest
    reports, functions = f"{args.index}/invocations", f"{args.index}/functions.json"
    config = Config.load(read_text(spark, args.config) if args.config else None)
    provider = Http(config.embedding_url) if config.embedding_url and not args.no_embed else None
    t = tables(catalog, config.scopes.get(args.scope) if args.scope else None)
    if args.command in ("index-code", "index-docs", "preflight"):
        found = read_files(spark, rest[0])
        config = config.detect(sorted({r.d for r in found.selectExpr("substring_index(file_path, '/', 1) as d").distinct().collect()}))
        if args.command == "preflight":
            return shown(index.preflight(found, config), "preflight", args.json), 0
        made = index.build_code_index(catalog, found, config, provider, rest[1:] or None) if args.command == "index-code" else index.build_docs_index(catalog, found, config, provider)
        index.append_report(spark, reports, made)
        return made["message"], index.exit_code(made["semantic_state"], made["failed_batches"])
    if args.command in ("status", "history", "compare"):
        r = spark.read.parquet(reports)
        out = index.compare(r, FACTS) if args.command == "compare" else index.history(r, 1 if args.command == "status" else 10)
        return shown(out, args.command, args.json), 0
    if args.command == "fn":
        known = expr.Functions.from_json(read_text(spark, functions) or "[]", set(primitives()))
        if rest[0] == "list":
            return "\n".join(f"{f.name}({', '.join(f.params)}): {f.description or f.body}" for f in known.items), 0
        if rest[0] == "add":
            known.add(expr.Function(rest[1], [p for p in rest[2].split(",") if p], rest[3], " ".join(rest[4:])))
        elif not known.remove(rest[1]):
            return f"no function {rest[1]}", 1
        write_text(spark, functions, known.to_json())
        return "saved", 0
    if args.command == "eval":
        known = expr.Functions.from_json(read_text(spark, functions) or "[]", set(primitives()))
        own, warnings = known.names(primitives() | t)
        print(*warnings, sep="\n", file=sys.stderr)
        return shown(expr.evaluate(sys.stdin.read() if rest[0] == "-" else rest[0], primitives() | t | own), "eval", args.json), 0
    if args.command == "repl":
        known = expr.Functions.from_json(read_text(spark, functions) or "[]", set(primitives()))
        own, warnings = known.names(primitives() | t)
        print(*warnings, sep="\n", file=sys.stderr)
        for said in repl(sys.stdin, primitives() | t | own, args.json):
            print(said, flush=True)
        return "", 0
    if args.command in ("stale", "health"):
        late = index.stale_docs(read_files(spark, rest[0]), t["frontmatters"], t["docs"])
        return shown(late if args.command == "stale" else index.health(t["sections"], t["links"], late), args.command, args.json), 0
    if args.command in ("search", "check"):
        if provider is None:
            return "no embedding server is configured", 2
        text = sys.stdin.read() if rest[-1] == "-" else rest[-1]
        try:
            if args.command == "check":
                return shown(index.check(index.check_text(text, t["docs"], catalog.table("doc_vectors"), provider)), "check", args.json), 0
            code_ = rest[0] == "code"
            out = index.search_text(text, t["code" if code_ else "docs"], catalog.table("code_vectors" if code_ else "doc_vectors"), provider, "summary_emb" if code_ else "emb", prefix="" if code_ else "search_query: ")
            return shown(out, "search", args.json), 0
        except Fault as e:
            return str(index.embedding_fault(e)), 1
    if args.command == "scopes":
        return "\n".join(f"{k}: {', '.join(v)}" for k, v in config.scopes.items()), 0
    if args.command == "sessions":
        return shown(index.sessions(spark, f"{args.index}/sessions"), "sessions", args.json), 0
    simple = {
        "orphans": lambda: docs.orphans(t["sections"], t["links"]), "broken": lambda: docs.broken(t["links"]), "catalog": lambda: docs.catalog(t["sections"]),
        "modules": lambda: code.modules(t["code"]), "hotspots": lambda: code.hotspots(t["code"], t["imports"]), "gaps": lambda: docs.gaps(t["docs"]),
        "hygiene": lambda: hygiene.findings(t["docs"], t["frontmatters"], t["links"]),
    }
    return shown(simple[args.command](), args.command, args.json), 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--index", required=True)
    p.add_argument("--config")
    p.add_argument("--scope")
    p.add_argument("--json", action="store_true")
    p.add_argument("--no-embed", action="store_true")
    p.add_argument("command")
    p.add_argument("rest", nargs="*")
    said, status = run(session(), p.parse_args(argv))
    print(said)
    return status


if __name__ == "__main__":
    sys.exit(main())
