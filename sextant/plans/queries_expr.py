"""Expressions over whole tables, as their users write them: lambdas over rows, in the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.plans import expr
from sextant.plans import standins as S
from sextant.plans.queries import query, sections


def _names(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o = S.table(spark, sf_dir, "orders").withColumn("ord", F.col("o_orderkey"))
    return {"docs": sections(spark, sf_dir), "orders": o}


@query("""SELECT doc_id, upper(lang) || '/' || source AS place, CASE WHEN len(text) > 500 THEN 'long' ELSE 'short' END AS size, coalesce(len(text), 0)::INT AS n FROM documents
 WHERE (lang IN ('en', 'de') OR contains(source, 'e')) AND NOT contains(lower(text), 'worthless') AND doc_id % 2 = 1""")
def expr_filter_map(spark, sf_dir):
    text = """
    some = docs.filter(lambda r: (r.lang in ("en", "de") or "e" in r.source) and "worthless" not in r.content.lower() and r.doc_id % 2 == 1)
    some.map(lambda r: {"doc_id": r.doc_id, "place": r.lang.upper() + "/" + r.source, "size": "long" if len(r.content) > 500 else "short", "n": len(r.content)})
    """
    return expr.evaluate("\n".join(x.strip() for x in text.strip().splitlines()), _names(spark, sf_dir))


@query("SELECT count(*) AS docs, sum(len(text))::BIGINT AS chars, max(len(text))::BIGINT AS longest, count(*) FILTER (lang = 'en' AND len(text) > 200) AS english FROM documents")
def expr_reduce(spark, sf_dir):
    step = "{'docs': a['docs'] + 1, 'chars': a['chars'] + len(r.content), 'longest': max(a['longest'], len(r.content)), 'english': a['english'] + 1 if r.lang == 'en' and len(r.content) > 200 else a['english']}"
    got = expr.evaluate(f"docs.reduce(lambda a, r: {step}, {{'docs': 0, 'chars': 0, 'longest': 0, 'english': 0}})", _names(spark, sf_dir))
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} long" for k in got))


@query("""WITH f AS (SELECT o_orderkey AS k, o_totalprice AS price, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'),
 l AS (SELECT o_orderkey AS k, o_totalprice AS price, row_number() OVER (ORDER BY o_orderkey DESC) AS n FROM orders)
 SELECT k, price, 'first' AS part FROM f WHERE n BETWEEN 11 AND 60 UNION ALL SELECT k, price, NULL FROM l WHERE n <= 20""")
def expr_sort_slice_concat(spark, sf_dir):
    """The report is a top-k by design: places 11 to 60 of the settled orders by priority and price, then the last 20."""
    text = """
    settled = orders.filter(lambda r: r.o_orderstatus == "F").sort(lambda r: (r.o_orderpriority, desc(r.o_totalprice))).map(lambda r: {"k": r.o_orderkey, "price": r.o_totalprice, "part": "first"})
    settled.slice(10, 60).concat(orders.slice(-20).map(lambda r: {"k": r.o_orderkey, "price": r.o_totalprice}))
    """
    return expr.evaluate("\n".join(x.strip() for x in text.strip().splitlines()), _names(spark, sf_dir))


@query("""SELECT w AS key, count(*) AS count FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w""")
def expr_count_by(spark, sf_dir):
    return expr.evaluate('docs.flat_map(lambda r: r.content.lower().split(" ")).filter(lambda r: r.value).count_by(lambda r: r.value)', _names(spark, sf_dir))


@query("SELECT source AS heading, arg_min(doc_id, doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY source")
def expr_unique(spark, sf_dir):
    return expr.evaluate('docs.filter(lambda r: r.content).unique(lambda r: r.source).map(lambda r: {"heading": r.heading, "doc_id": r.doc_id})', _names(spark, sf_dir))
