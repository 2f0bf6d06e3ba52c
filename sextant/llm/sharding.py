"""Sharding (native): proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source and ranked; the fractional rank (rank - phase) / n, with a
phase in (0, 1) for each source, places its rows evenly over [0, 1). All rows in the order of their fractional ranks are cut into shards whose
row counts differ by one at most, so that every shard holds every source in its share, up to a row or so.

Scale: ranks are exact without sorting a source, or everything, in one task: hashes (then fractional ranks) are
cut into BUCKETS ranges, the ranges are counted and prefix-summed, and rows are sorted only within a range.
Two shuffles of narrow rows.

Defined cases: null text counts as no bytes; a null source is a source; a null doc_id is a row as any other;
equal rows each get a place of their own (which one gets which is not told apart); an empty table gives no rows.
Columns besides the operator's own (`OUT`) pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import cut, read_table

BUCKETS = 1024
OUT = ("shard", "slot")


def _places(rows: DataFrame, by: list[str], bucket: str, order: list) -> DataFrame:
    """Adds _rank (from 1) within `by` in the order (bucket, *order), and _all, the number of rows of `by`.

    The ranges' counts are read back in by a join on (by, bucket), whose partitioning the window reuses.
    """
    n = rows.groupBy(*by, bucket).agg(F.count("*").alias("_k"))
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    n = n.withColumn("_before", F.coalesce(F.sum("_k").over(every.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_k").over(every)).drop("_k")
    n = n.select(*[F.col(c).alias(f"_{c}_2") for c in [*by, bucket]], "_before", "_all")
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)))
    on = None
    for c in [*by, bucket]:
        e = F.col(c).eqNullSafe(F.col(f"_{c}_2"))
        on = e if on is None else on & e
    return rows.join(n, on).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_in", "_before", *[f"_{c}_2" for c in [*by, bucket]])


def stratified_shards(rows: DataFrame, shards: int = 16, seed: int = 5, key: str = "doc_id") -> DataFrame:
    """rows with doc_id and source: adds shard (0 to shards - 1) and slot (from 0, gapless in its shard)."""
    rows = rows.drop(*OUT)
    # Rows without a key are shuffled by all that they hold, so that they don't lie in one range.
    plain = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "short", "double", "boolean", "date", "timestamp")]
    rows = rows.withColumn("_h", F.when(F.col(key).isNull(), F.xxhash64(F.lit(seed), *plain)).otherwise(F.xxhash64(F.lit(seed), F.col(key))))
    rows = rows.withColumn("_hb", F.shiftrightunsigned("_h", 54).cast("int"))  # 2 ** 10 ranges
    rows = _places(rows, ["source"], "_hb", [F.col("_h"), F.col(key)])
    # Each source has a phase of its own, or sources of one size would come in bursts.
    phase = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source"), 12).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("_f", (F.col("_rank") - phase) / F.col("_all")).drop("_rank", "_all", "_hb")
    rows = rows.withColumn("_fb", F.floor(F.col("_f") * BUCKETS).cast("int"))
    rows = cut(rows)
    rows = _places(rows, [], "_fb", [F.col("_f"), F.col("source"), F.col("_h"), F.col(key)])
    at = F.col("_rank") - 1
    rows = rows.withColumn("shard", F.expr(f"cast((_rank * {shards} - 1) div _all as int)"))
    # Shard s holds the places p with floor((p + 1) * shards - 1) / n) = s: they begin at floor(s * n / shards).
    first = F.expr(f"(cast(shard as bigint) * _all) div {shards}")
    return rows.withColumn("slot", at - first).drop("_rank", "_all", "_f", "_fb", "_h")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = stratified_shards(rows, 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
