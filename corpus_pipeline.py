"""A training-data pipeline of five stages over documents (doc_id, text, lang, source, n_chars).

Toxic documents go; of each group of near copies (shingles of five words, Jaccard similarity of 0.8 or more) one stays;
personal data get surrogates; sources are mixed to target weights, a document standing as often as it is taken; and
what is left is packed into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import jaccard, mixing, packing, pii, toxicity
from sextant.llm.common import read_table, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and keeps those that score under one half; null and empty texts as the model scores them."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of linked documents; documents without words stay, rows without doc_id go where
    their group has a row with one. Repeated rows are copies."""
    return jaccard.one_of_each(docs, k=5, p=4, q=5)


def _counted(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with surrogates in its text and the text's new length; null texts stay null (and so their length)."""
    return _counted(pii.with_surrogates(docs, pii.key_of(spark)), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a document without words is never taken, a null source is a source of its own."""
    return _counted(mixing.mixed_rows(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece; null texts are one end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("personal data", replace_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold run() against their brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared checkpoint folder and read again. An empty table gives no rows."""
    docs = read_table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        # The last stage has read its texts once and keeps its pieces in a checkpoint: what was written for it can go, as after a failure.
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
