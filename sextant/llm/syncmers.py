"""Document fingerprints (native): closed syncmers over words.

Words are lower-cased and hashed; a k-mer is K words in a row, its inner substrings are the K - S + 1 runs of S words.
A k-mer is a closed syncmer if the least hash of its inner substrings is that of the first or of the last one. Whether a
k-mer is chosen depends on its own words only, never on what stands around it, so that an edit moves the anchors
that it touches and no others. An anchor is a chosen k-mer's hash and its position; a link is two anchors that follow each other and the
distance between them.

The fingerprint is every anchor of the text, as distances and hashes: nothing is sampled, however long the text. Likeness matches by
position: it is the share of the anchors and links of either text that both have. An anchor that stands elsewhere in the other text but
among the same neighbours, at the same distances, counts in full; one out of place counts without its links.
`passages` finds where texts overlap: anchors in common at one shift of position.

Scale: texts become arrays of hashes in one pass of built-in functions; nothing is exploded. The query's "next
document" is found without a global sort in one task: rows are dealt into ranges of doc_id with approximate quantiles
(a bounded number on the driver), a copy of each range's first row goes to the range before, and lead() runs within
ranges. One shuffle of the texts; anchors are made after it.

Defined cases: null and empty texts, and texts of white space, have the fingerprint ""; a text of fewer than K words is one
anchor; two empty fingerprints have likeness 1, an empty and another 0; rows with equal doc_id follow each other in the
order of their texts, a null doc_id comes first; a single row is its own next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.llm.common import SPACE, read_table

K, S = 5, 2
#: Rows of a range of doc_id, about, the most ranges, and the quantiles that are asked for.
RANGE, RANGES, COARSE = 1024, 1 << 18, 128


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words (A-Z only), in order."""
    words = F.filter(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds <out>_at and <out>_hash, the anchors' positions (in words, from 0) and hashes, in order of position."""
    h, g, n, at, to = f"_{out}_h", f"_{out}_g", f"_{out}_n", f"{out}_at", f"{out}_hash"
    df = df.withColumn(h, word_hashes(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(n, F.expr(f"size({h}) - {K - 1}"))  # number of k-mers
    # Inner substrings: a hash of S words from each position on.
    inner = f"transform(sequence(0, size({h}) - {S}), i -> xxhash64({', '.join(f'{h}[i + {j}]' for j in range(S))}))"
    df = df.withColumn(g, F.expr(f"case when {n} > 0 then {inner} end"))
    low = ", ".join(f"{g}[i + {j}]" for j in range(K - S + 1))
    chosen = f"filter(sequence(0, {n} - 1), i -> least({low}) in ({g}[i], {g}[i + {K - S}]))"
    df = df.withColumn(at, F.expr(f"case when {n} > 0 then {chosen} when size({h}) > 0 then array(0) else cast(array() as array<int>) end"))
    kmer = f"xxhash64({', '.join(f'{g}[i + {j}]' for j in range(K - S + 1))})"
    short = f"case when size({h}) > 0 then array(xxhash64({h})) else cast(array() as array<bigint>) end"
    return df.withColumn(to, F.expr(f"case when {n} > 0 then transform({at}, i -> {kmer}) else {short} end")).drop(h, g, n)


def with_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Of <name>_at and <name>_hash: adds <name>_text, the fingerprint, and <name>_set, distinct anchors and links for `likeness`."""
    at, h = f"{name}_at", f"{name}_hash"
    df = df.withColumn(f"_{name}_gap", F.expr(f"case when size({at}) > 1 then transform(sequence(1, size({at}) - 1), i -> {at}[i] - {at}[i - 1]) else cast(array() as array<int>) end"))
    gap = f"_{name}_gap"
    links = f"transform({gap}, (d, i) -> xxhash64({h}[i], {h}[i + 1], d))"
    text = F.concat_ws("|", F.array_join(F.col(gap).cast("array<string>"), " "), F.array_join(F.col(h).cast("array<string>"), " "))
    df = df.withColumn(f"{name}_text", F.when(F.size(h) > 0, text).otherwise(""))
    return df.withColumn(f"{name}_set", F.array_distinct(F.concat(F.col(h), F.expr(links)))).drop(gap)


def likeness(a: Column, b: Column) -> Column:
    """The share of the anchors and links of two texts (distinct, as <name>_set) that both have."""
    shared = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - shared
    return F.when(both == 0, 1.0).otherwise(shared / F.greatest(both, F.lit(1)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds `anchors`, an array of (position, hash), and `fingerprint` to docs with a column text; other columns pass through."""
    out = with_fingerprint(with_anchors(docs.drop("anchors", "fingerprint"), "text", "_own"), "_own")
    pairs = F.expr("transform(_own_at, (p, i) -> named_struct('position', p, 'hash', _own_hash[i]))")
    return out.withColumn("anchors", pairs).withColumn("fingerprint", F.col("_own_text")).drop("_own_at", "_own_hash", "_own_text", "_own_set")


def passages(queries: DataFrame, docs: DataFrame, least: int = 3) -> DataFrame:
    """Positional matches of queries (doc_id, text) in docs (doc_id, text): at one shift (position there less position here), `least`
    anchors or more in common. Rows: query_id, doc_id, shift, n_anchors, begin and end (words of the query). Joined on the anchors."""
    q, d = (with_anchors(x.select("doc_id", "text"), "text", "own") for x in (queries, docs))
    q, d = (x.select("doc_id", F.explode(F.arrays_zip("own_hash", "own_at")).alias("a")).select("doc_id", F.col("a.own_hash").alias("h"), F.col("a.own_at").alias("at")) for x in (q, d))
    met = q.select(F.col("doc_id").alias("query_id"), "h", F.col("at").alias("_q")).join(d, "h").withColumn("shift", F.col("at") - F.col("_q"))
    out = met.groupBy("query_id", "doc_id", "shift").agg(F.count_distinct("_q").alias("n_anchors"), F.min("_q").alias("begin"), (F.max("_q") + K).alias("end"))
    return out.filter(F.col("n_anchors") >= least)


def with_next(docs: DataFrame, prepare=None) -> DataFrame:
    """docs (doc_id, text): adds next_<column> for the text and each column that `prepare` adds, of the next row in the order of doc_id;
    the first's for the last row. prepare runs after the shuffle."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    count = rows.count()
    n = min(RANGES, max(1, count // RANGE))
    coarse = min(COARSE, n)
    edges = sorted(set(rows.approxQuantile("doc_id", [i / coarse for i in range(coarse + 1)], 1 / (4 * coarse)))) if n > 1 else []
    part = F.lit(0)
    if len(edges) > 1:  # between two quantiles, ranges of equal width; any monotone function of doc_id would do
        edge, fine = F.array(*[F.lit(int(e)) for e in edges]), -(-n // coarse)
        k = F.greatest(F.lit(1), F.least(F.lit(len(edges) - 1), F.size(F.filter(edge, lambda e: e <= F.col("doc_id")))))
        low, high = F.get(edge, k - 1), F.get(edge, k)
        place = F.floor((F.col("doc_id") - low) / (high - low) * fine)
        part = F.coalesce(k * fine + F.greatest(F.lit(0), F.least(F.lit(fine - 1), place)), F.lit(0))
    rows = rows.withColumn("_part", part.cast("long"))
    # One row for each range (RANGES at most): its least doc_id and the range before it, the last one for the first.
    first = rows.groupBy("_part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("_first"))
    every = Window.orderBy("_part")
    last = F.max("_part").over(Window.partitionBy(F.lit(1)))
    first = first.select(F.col("_part").alias("_of"), F.col("_first.doc_id").alias("_least"), F.coalesce(F.lag("_part").over(every), last).alias("_before"))
    heads = rows.join(F.broadcast(first), (F.col("_part") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_least")))
    # Of several rows with the least doc_id, the one whose text is least leads: all go along, the window picks it.
    ghosts = heads.select("doc_id", "text", F.col("_before").alias("_part"), F.lit(1).alias("_ghost"))
    all_rows = rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts).repartition("_part")
    given = all_rows.columns
    all_rows = prepare(all_rows) if prepare else all_rows
    order = Window.partitionBy("_part").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "text")
    more = ["text", *(c for c in all_rows.columns if c not in given)]
    return all_rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in more}).filter("_ghost = 0").drop("_ghost", "_part")


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def prepare(df: DataFrame) -> DataFrame:
        return with_fingerprint(with_anchors(df, "text", "own"), "own").drop("own_at", "own_hash")

    rows = with_next(read_table(spark, sf_dir, "documents"), prepare).drop("next_own_text")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_cut", F.expr("n_chars div 2").cast("int"))
    rows = rows.withColumn("_text", F.concat(F.expr("left(text, cast(n_chars as int) - _cut)"), F.expr("left(next_text, _cut)")))
    rows = with_fingerprint(with_anchors(rows, "_text", "edited"), "edited")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("_text", 256).alias("edited_sha256"),
        F.col("own_text").alias("fingerprint"),
        F.col("edited_text").alias("edited_fingerprint"),
        likeness(F.col("own_set"), F.col("edited_set")).alias("near_edited"),
        likeness(F.col("own_set"), F.col("next_own_set")).alias("near_next"),
    )
