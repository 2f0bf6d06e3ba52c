"""Queries of the code index and of both indexes, over the stand-ins of `standins`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as X
from sextant.operators import bridge, code, codefiles, docs, scan
from sextant.plans import standins as S
from sextant.plans.queries import query
from sextant.plans.standins import CODE
from sextant.sources import files as sources


def _first_part(spark: SparkSession, sf_dir: str):
    return S.table(spark, sf_dir, "part").orderBy("p_partkey").limit(1).first()


@query(f"""WITH {CODE}, f AS (SELECT file_path FROM sups WHERE s = 1)
 SELECT f.file_path, 1 AS chunks, (SELECT string_agg(module, ', ' ORDER BY module) FROM imports i WHERE i.file_path = f.file_path) AS imports,
 (SELECT string_agg(DISTINCT regexp_extract(file_path, '[^/]*$'), ', ' ORDER BY regexp_extract(file_path, '[^/]*$')) FROM imports WHERE contains(lower(module), 's1')) AS dependents, NULL::VARCHAR AS error FROM f""")
def code_context(spark, sf_dir):
    out = code.context(S.code_chunks(spark, sf_dir).withColumn("signature", F.lit("")), S.code_imports(spark, sf_dir), "S1.py")
    return out.select("file_path", F.size("chunks").alias("chunks"), F.array_join(F.array_sort("imports"), ", ").alias("imports"), F.array_join("dependents", ", ").alias("dependents"), "error")


@query(f"""WITH {CODE} SELECT t.file_path, c.name, c.summary FROM (SELECT DISTINCT sups.file_path FROM deals JOIN parts USING (p) JOIN sups USING (s) WHERE p_type = 'ECONOMY') t
 LEFT JOIN (SELECT * FROM chunks WHERE contains(lower(summary), 'economy') OR contains(lower(name), 'economy')) c USING (file_path)""")
def code_impact(spark, sf_dir):
    c = S.code_chunks(spark, sf_dir)
    return code.impact(S.type_refs(spark, sf_dir), c, "ECONOMY").join(c.select("chunk_id", "name"), "chunk_id", "left").select("file_path", "name", "summary")


@query(f"WITH {CODE} SELECT module FROM imports WHERE file_path = (SELECT file_path FROM sups WHERE s = 1)")
def code_imports(spark, sf_dir):
    return code.imports_of(S.code_imports(spark, sf_dir), "S1.py")


@query(f"WITH {CODE} SELECT DISTINCT regexp_extract(file_path, '[^/]*$') AS file FROM imports WHERE contains(lower(module), 'promo.p1')")
def code_deps(spark, sf_dir):
    return code.dependents_of(S.code_imports(spark, sf_dir), "Promo.P1")


@query(f"""WITH {CODE} SELECT name, file_path, sha256(content) AS code, (SELECT string_agg(module, ', ' ORDER BY module) FROM imports i WHERE i.file_path = c.file_path) AS imports,
 (SELECT string_agg(DISTINCT regexp_extract(file_path, '[^/]*$'), ', ' ORDER BY regexp_extract(file_path, '[^/]*$')) FROM imports WHERE contains(lower(module), 's1')) AS dependents FROM chunks c WHERE name = 'S1'""")
def code_expand(spark, sf_dir):
    c = S.code_chunks(spark, sf_dir)
    target = c.filter("name = 'S1'").first().chunk_id
    out = code.expand(c.drop("content"), c, target, S.code_imports(spark, sf_dir))
    return out.select("name", "file_path", F.sha2("code", 256).alias("code"), F.array_join("imports", ", ").alias("imports"), F.array_join("dependents", ", ").alias("dependents"))


@query(f"""WITH {CODE}, c AS (SELECT file_path, count(*) AS chunks, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, regexp_extract(file_path, '[^/]*$') AS file FROM chunks GROUP BY 1)
 SELECT c.*, coalesce(n, 0)::BIGINT AS imports FROM c LEFT JOIN (SELECT file_path, count(*) AS n FROM imports GROUP BY 1) i USING (file_path) WHERE regexp_matches(file, '(?i)^s.*1\\.py$')""")
def code_files(spark, sf_dir):
    return code.files(S.code_chunks(spark, sf_dir), S.code_imports(spark, sf_dir), "s*1.PY")


@query(f"""WITH {CODE}, c AS (SELECT *, regexp_extract(file_path, '^[^/]+/([^/]+)/', 1) AS module_, regexp_extract(file_path, '[^/]*$') AS file FROM chunks),
 t AS (SELECT module_, name, row_number() OVER (PARTITION BY module_ ORDER BY min(ord)) AS k FROM c WHERE kind IN ('type', 'record', 'du') GROUP BY 1, 2),
 s AS (SELECT module_, summary, row_number() OVER (PARTITION BY module_ ORDER BY min(ord)) AS k FROM c WHERE summary <> '' GROUP BY 1, 2)
 SELECT module_ AS module, count(DISTINCT file_path) AS files, count(*) AS chunks, string_agg(DISTINCT file, ', ' ORDER BY file) AS file_list,
 coalesce((SELECT string_agg(name, ', ' ORDER BY k) FROM t WHERE t.module_ = c.module_ AND k <= 8), '') AS top_types, coalesce((SELECT string_agg(summary, ' | ' ORDER BY k) FROM s WHERE s.module_ = c.module_ AND k <= 3), '') AS summaries FROM c GROUP BY 1""")
def code_modules(spark, sf_dir):
    return code.modules(S.code_chunks(spark, sf_dir))


@query(rf"""WITH {CODE} SELECT name, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '(^|[^\p{{L}}\p{{N}}_])P1([^\p{{L}}\p{{N}}_]|$)'))[1] AS match_line FROM chunks
 WHERE name <> 'P1' AND regexp_matches(content, '(^|[^\p{{L}}\p{{N}}_])P1([^\p{{L}}\p{{N}}_]|$)')""")
def code_refs(spark, sf_dir):
    return code.refs(S.code_chunks(spark, sf_dir), "P1", None).select("name", "match_line")


@query(rf"""WITH {CODE}, q AS (SELECT 'Parts.' || p_type AS owner, 'P' || p AS short FROM parts ORDER BY p LIMIT 1), w AS (SELECT owner, short, '(^|[^\p{{L}}\p{{N}}_])' || replace(owner || '.' || short, '.', '\.') || '([^\p{{L}}\p{{N}}_]|$)' AS a, '(^|[^\p{{L}}\p{{N}}_])' || short || '([^\p{{L}}\p{{N}}_]|$)' AS b FROM q),
 c AS (SELECT name, CASE WHEN regexp_matches(content, a) THEN 'qualified' WHEN (module = owner OR starts_with(name, owner || '.')) AND regexp_matches(content, b) THEN 'local' END AS call_type, content, a, b FROM chunks, w WHERE name <> short)
 SELECT name, call_type, array_to_string(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, CASE WHEN call_type = 'qualified' THEN a ELSE b END))[1:3], ' | ') AS match_line FROM c WHERE call_type IS NOT NULL""")
def code_callers(spark, sf_dir):
    p = _first_part(spark, sf_dir)
    return code.callers(S.code_chunks(spark, sf_dir), f"Parts.{p.p_type}.P{p.p_partkey}", None).select("name", "call_type", "match_line")


#: Names shorter than three letters aren't gone on from.
_HITS = r"""w AS (SELECT ord, name, file_path, start_line, unnest(list_distinct(regexp_extract_all(content, '[\p{L}\p{N}_]+'))) AS word FROM chunks),
 e AS (SELECT word AS src, name AS dst, regexp_extract(file_path, '[^/]*$') AS file, start_line AS line, row_number() OVER (PARTITION BY word ORDER BY ord) AS k FROM w WHERE word <> name),
 one AS (SELECT *, src || ' → ' || dst || ' (' || file || ':' || line || ')' AS trail FROM e WHERE src = 'P100' AND k <= 3),
 two AS (SELECT 1 AS hop, src, dst, file, line, trail FROM one UNION ALL SELECT 2, e.src, e.dst, e.file, e.line, one.trail || ' → ' || e.dst || ' (' || e.file || ':' || e.line || ')' FROM one JOIN e ON e.src = one.dst AND e.k <= 3 WHERE length(one.dst) > 2)"""


@query(rf"""WITH {CODE}, {_HITS} SELECT hop, dst AS name, file, line, trim(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '(^|[^\p{{L}}\p{{N}}_])' || src || '([^\p{{L}}\p{{N}}_]|$)'))[1], ' ') AS match_line, trail FROM two JOIN chunks c ON c.name = two.dst""")
def code_walk(spark, sf_dir):
    """Up to nine parts, and those suppliers with three letters or more."""
    return code.walk(S.code_chunks(spark, sf_dir), "P100", 2, 3).select("hop", "name", "file", "line", "match_line", "trail")


#: Files by name, and the imports that hold their stems anywhere (P12's stem stands in P123 too).
_FANS = """names AS (SELECT DISTINCT regexp_extract(file_path, '[^/]*$') AS file, lower(regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '')) AS stem FROM chunks),
 said AS (SELECT regexp_extract(file_path, '[^/]*$') AS src, lower(module) AS m, count(*) AS n FROM imports GROUP BY 1, 2), ms AS (SELECT DISTINCT m FROM said),
 held AS (SELECT m, file FROM ms JOIN names ON contains(m, stem) AND length(stem) >= 3), near AS (SELECT src, file, n FROM said JOIN held USING (m) WHERE src <> file),
 ins AS (SELECT file, sum(n)::BIGINT AS fan_in FROM near GROUP BY 1), outs AS (SELECT file_path, count(*) AS fan_out FROM imports GROUP BY 1)"""


@query(f"""WITH {CODE}, {_FANS} SELECT c.file_path, count(*) AS chunks, sum(end_line - start_line + 1)::BIGINT AS loc, string_agg(DISTINCT kind, ',') AS kinds, coalesce(any_value(fan_in), 0)::BIGINT AS fan_in, coalesce(any_value(fan_out), 0)::BIGINT AS fan_out
 FROM chunks c LEFT JOIN ins ON ins.file = regexp_extract(c.file_path, '[^/]*$') LEFT JOIN outs USING (file_path) GROUP BY 1""")
def code_hotspots(spark, sf_dir):
    return code.hotspots(S.code_chunks(spark, sf_dir), S.code_imports(spark, sf_dir))


@query(f"""WITH {CODE}, {_FANS}, m AS (SELECT min(a.file) AS f FROM near a JOIN near b USING (file) WHERE a.src = 'S1.py' AND b.src = 'S2.py')
 SELECT 1 AS step, 'S1.py' AS node, 2 AS length UNION ALL SELECT 2, f, 2 FROM m UNION ALL SELECT 3, 'S2.py', 2""")
def code_trace(spark, sf_dir):
    """Two suppliers, named by a part of their files' names, import a part in common."""
    return code.trace(S.code_chunks(spark, sf_dir), S.code_imports(spark, sf_dir), "s1.P", "s2.p").select("step", "node", "length")


@query(f"""WITH {CODE} SELECT c.name, CASE WHEN name LIKE 'S%' THEN 'none' WHEN end_line > 30 THEN 'partial' WHEN end_line > 20 THEN 'path+name+line' ELSE 'chunk_id' END AS source_match FROM chunks c""")
def code_explain(spark, sf_dir):
    """Sources of suppliers are lost, those of parts have another id or another line."""
    c = S.code_chunks(spark, sf_dir)
    far, other = F.col("end_line") > 30, F.col("end_line") > 20
    source = c.filter(F.col("name").startswith("P")).withColumn("start_line", F.when(far, 7).otherwise(F.col("start_line"))).withColumn("chunk_id", F.when(other, F.concat(F.lit("x"), "chunk_id")).otherwise(F.col("chunk_id")))
    return scan.explain_match(c, source).select("name", "source_match")


@query(f"""WITH {CODE} SELECT name FROM chunks WHERE starts_with(file_path, 'lib/Brand7/')""")
def code_changed(spark, sf_dir):
    c = S.code_chunks(spark, sf_dir)
    paths = S.table(spark, sf_dir, "part").filter("p_brand = 'Brand#7'").select(S._part().alias("file_path"))
    return code.changed(c, paths).select("name")


@query(f"""WITH {CODE}, x AS (SELECT name AS chunk, lower(unnest([name, module || '.' || name, regexp_extract(file_path, '[^/]*$'), regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '')])) AS symbol FROM chunks)
 SELECT symbol, count(DISTINCT chunk) AS chunks FROM x WHERE length(symbol) >= 3 GROUP BY 1""")
def code_symbols(spark, sf_dir):
    return bridge.symbols(S.code_chunks(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("chunks"))


@query(f"""WITH {CODE}, m AS (SELECT s, 'Parts.Economy' AS t, min(p) AS pos FROM deals WHERE back = 0 GROUP BY 1 UNION ALL SELECT s, 'Lost.Thing', min(p) FROM deals WHERE back = 1 GROUP BY 1),
 t AS (SELECT s, 0 AS kind, p AS pos, 'Q' || p || '.fs' AS t FROM deals WHERE back = 1 UNION ALL SELECT s, 1, pos, t FROM m)
 SELECT 'notes/S' || s || '.md' AS file_path, 'Notes' AS heading, string_agg(t, ', ' ORDER BY kind, pos) AS missing_symbols, count(*)::INT AS count FROM t GROUP BY s""")
def drift(spark, sf_dir):
    return bridge.drift(S.notes(spark, sf_dir), S.code_chunks(spark, sf_dir)).drop("chunk_id")


@query(f"""WITH {CODE}, {_FANS}, said_of AS (SELECT DISTINCT file_path FROM deals JOIN parts USING (p) WHERE back = 0)
 SELECT c.file_path, fan_in, 1::BIGINT AS chunks, (end_line - start_line + 1)::BIGINT AS loc, kind AS kinds, name AS top_symbols FROM chunks c JOIN ins ON ins.file = regexp_extract(c.file_path, '[^/]*$') AND fan_in >= 2 WHERE c.file_path NOT IN (SELECT file_path FROM said_of)""")
def coverage(spark, sf_dir):
    return bridge.coverage(S.code_chunks(spark, sf_dir), S.code_imports(spark, sf_dir), S.notes(spark, sf_dir), 2)


_GAPS = f"""{CODE}, t AS (SELECT DISTINCT s, lower(unnest(regexp_extract_all(content, '`([A-Z]\\d{{2,}})\\.fs`', 1))) AS entity FROM notes
  UNION ALL SELECT s, 'lost.thing' FROM notes WHERE contains(content, 'Lost.Thing') UNION ALL SELECT s, 'parts.economy' FROM notes WHERE contains(content, 'Parts.Economy')),
 n AS (SELECT count(*) AS total_files FROM notes),
 g AS (SELECT entity, string_agg('S' || s, ', ' ORDER BY 'S' || s) AS sources, count(*) AS count, (least(5, length(entity) // 3) + CASE WHEN contains(entity, '.') THEN 2 WHEN length(entity) > 12 THEN 1 ELSE 0 END)::INT AS importance FROM t GROUP BY 1),
 gaps AS (SELECT g.*, total_files, CASE WHEN count >= greatest(5, ceil(total_files * 0.05)) THEN 'god-node' WHEN count >= 2 THEN 'shared' ELSE 'isolated' END AS signal FROM g, n)"""


@query(f"WITH {_GAPS} SELECT entity, sources, count, total_files, signal, importance FROM gaps")
def gaps(spark, sf_dir):
    return docs.gaps(S.notes(spark, sf_dir))


@query(f"WITH {_GAPS} SELECT entity, count, signal FROM gaps WHERE (entity = 'lost' OR starts_with(entity, 'lost.') OR starts_with('lost', entity || '.')) AND signal <> 'isolated' AND count >= 2 AND signal = 'god-node'")
def gaps_scoped(spark, sf_dir):
    return docs.gaps(S.notes(spark, sf_dir), scope="Lost", min_docs=2, signal="god-node").select("entity", "count", "signal")


# Extraction --------------------------------------------------------------------


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each supplier: an import for each part, a function and a class."""
    lines = F.concat(F.lit("import parts.p"), F.col("p").cast("string"))
    rows = S.deals(spark, sf_dir).groupBy("s").agg(S._joined(F.struct(F.col("p").alias("k"), lines.alias("line"))).alias("i"))
    tail = "\n\n\ndef sell(x):\n    return x\n\n\nclass Shop:\n    name = 'Shopkeeper'\n\n    def open(self):\n        return Missing(HTTP, Abc)  # of Nobody\n"
    return rows.select(F.concat(F.lit("src/shop"), F.col("s").cast("string"), F.lit(".py")).alias("file_path"), F.concat("i", F.lit(tail)).alias("content"))


@query("""WITH d AS (SELECT l_suppkey AS s, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), c AS (SELECT 'src/shop' || s || '.py' AS file_path, 'src.shop' || s AS module, n FROM d)
 SELECT file_path, module, 'sell' AS name, 'let' AS kind, (n + 3)::INT AS start_line, (n + 4)::INT AS end_line, sha256('def sell(x):' || chr(10) || '    return x') AS body FROM c
 UNION ALL SELECT file_path, module, 'Shop', 'type', (n + 7)::INT, (n + 11)::INT, sha256('class Shop:' || chr(10) || '    name = ''Shopkeeper''' || chr(10) || chr(10) || '    def open(self):' || chr(10) || '        return Missing(HTTP, Abc)  # of Nobody') FROM c""")
def extract_chunks(spark, sf_dir):
    return codefiles.source_table(_scripts(spark, sf_dir)).select("file_path", "module", "name", "kind", "start_line", "end_line", F.sha2("content", 256).alias("body"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem) SELECT 'src/shop' || s || '.py' AS file_path, 'parts.p' || p AS module, row_number() OVER (PARTITION BY s ORDER BY p)::INT AS line, 'import parts.p' || p AS raw FROM d""")
def extract_imports(spark, sf_dir):
    return codefiles.extract(_scripts(spark, sf_dir), "imports")


@query("""SELECT DISTINCT 'src/shop' || l_suppkey || '.py' AS file_path, 'HTTP, Missing' AS types FROM lineitem""")
def extract_type_refs(spark, sf_dir):
    return codefiles.type_refs(_scripts(spark, sf_dir)).select("file_path", F.array_join("types", ", ").alias("types"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS s FROM lineitem) SELECT 'src/shop' || s || '.py' AS file_path, name, signature FROM d, (VALUES ('sell', 'def sell(x)'), ('Shop', 'class Shop')) v(name, signature)""")
def extract_signatures(spark, sf_dir):
    source = codefiles.read(codefiles.source_table(_scripts(spark, sf_dir)))
    # Half of the chunks find their signature by line, the others, a line off, by name.
    moved = source.withColumn("start_line", F.when(F.col("name") == "sell", F.col("start_line") + 1).otherwise(F.col("start_line"))).withColumn("signature", F.lit(""))
    return codefiles.with_signatures(moved, codefiles.read(codefiles.signatures(source))).select("file_path", "name", "signature")


@query(f"""WITH {CODE} SELECT name, sha256(module || chr(10) || kind || ':' || name || chr(10) || content) AS code_text, CASE WHEN length(summary) > 9 THEN summary ELSE kind || ' ' || name END AS summary_text FROM chunks""")
def embedding_texts(spark, sf_dir):
    c = S.code_chunks(spark, sf_dir)
    short = F.when(F.length("summary") > 9, F.col("summary")).otherwise("")
    return c.select("name", F.sha2(codefiles.embedding_text(F.col("module"), F.col("kind"), F.col("name"), F.col("content")), 256).alias("code_text"), codefiles.summary_text(short, F.col("kind"), F.col("name")).alias("summary_text"))


# Sources -----------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as a walk of a repository finds them: each part's, in a folder by its type."""
    folder = F.when(F.col("p_type") == "ECONOMY", "src/bin").when(F.col("p_type") == "PROMO", "src/node_modules/x").when(F.col("p_type") == "LARGE", "docs/a").when(F.col("p_type") == "SMALL", "src/gen/a/b").otherwise("src/app")
    ext = F.when(F.col("p_size") > 40, ".md").when(F.col("p_size") > 30, ".txt").when(F.col("p_size") > 20, ".py").otherwise(".CS")
    return S.table(spark, sf_dir, "part").select(F.concat(folder, F.lit("/f"), F.col("p_partkey").cast("string"), ext).alias("file_path"))


_FOUND = """f AS (SELECT CASE p_type WHEN 'ECONOMY' THEN 'src/bin' WHEN 'PROMO' THEN 'src/node_modules/x' WHEN 'LARGE' THEN 'docs/a' WHEN 'SMALL' THEN 'src/gen/a/b' ELSE 'src/app' END || '/f' || p_partkey ||
 CASE WHEN p_size > 40 THEN '.md' WHEN p_size > 30 THEN '.txt' WHEN p_size > 20 THEN '.py' ELSE '.CS' END AS file_path FROM part)"""


@query(f"WITH {_FOUND} SELECT file_path FROM f WHERE regexp_matches(lower(file_path), '\\.(py|cs)$') AND starts_with(file_path, 'src/') AND NOT regexp_matches(file_path, '^src/(bin|node_modules)/|^src/gen/[^/]*/b/f1[^/]*$')")
def discover_code(spark, sf_dir):
    config = sources.Config.load('{"exclude": ["src/gen/**/b/f1*"]}').detect(["src", "docs"])
    return sources.code_files(_found(spark, sf_dir), config).select("file_path")


@query(f"WITH {_FOUND} SELECT file_path FROM f WHERE ends_with(file_path, '.md') AND starts_with(file_path, 'docs/')")
def discover_docs(spark, sf_dir):
    return sources.doc_files(_found(spark, sf_dir), sources.Config.load(None).detect(["src", "docs"])).select("file_path")


@query(f"WITH {_FOUND} SELECT file_path FROM f WHERE starts_with(file_path, 'src/gen/') OR starts_with(file_path, 'docs/')")
def in_scope(spark, sf_dir):
    return _found(spark, sf_dir).filter(sources.in_scope("file_path", ["src/gen", "docs/"]))


@query(f"""WITH {CODE}, c AS (SELECT file_path, regexp_extract(file_path, '[^/]*$') AS name FROM chunks)
 SELECT file_path, lower(name) = 's1.py' OR ends_with(lower(file_path), '/s1.py') AS by_name, ends_with(lower(file_path), '/brand7/p1.fs') OR lower(name) = 'p1.fs' AS by_tail,
 regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS directory, regexp_replace(name, '\\.[^.]*$', '') AS stem, CASE WHEN starts_with(file_path, 'lib/') THEN file_path[5:] ELSE file_path END AS relative, contains(lower(file_path), 'brand1/p') AS holds FROM c""")
def path_functions(spark, sf_dir):
    c = S.code_chunks(spark, sf_dir)
    p = F.col("file_path")
    return c.select(p, X.match_file(p, "S1.PY").alias("by_name"), X.match_file(p, "Brand7\\P1.fs").alias("by_tail"), X.directory(p).alias("directory"), X.file_stem(p).alias("stem"), X.relative_path(p, "lib").alias("relative"), X.icontains(p, "Brand1/P").alias("holds"))


@query(f"""WITH {CODE}, r AS (SELECT kind, count(*) AS n FROM chunks WHERE ord < 1000000000 GROUP BY 1) SELECT upper(kind) AS kind, n FROM r WHERE n > 1""")
def piped(spark, sf_dir):
    """Steps from left to right, with a look in between."""
    seen: list[int] = []
    return scan.pipe(
        S.code_chunks(spark, sf_dir), lambda d: d.filter("ord < 1000000000"), lambda d: scan.tap(d, lambda x: seen.append(len(x.columns))),
        lambda d: d.groupBy("kind").agg(F.count("*").alias("n")), lambda d: d.filter("n > 1").select(F.upper("kind").alias("kind"), "n"),
    )
