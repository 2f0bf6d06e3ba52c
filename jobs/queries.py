"""The jobs as registered queries: each runs twice into a new folder and returns the output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import docs_index, link_audit
from jobs.common import scratch


def job1_docs_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table may be a file or a folder, and a stream takes folders or patterns: so it is given as a pattern."""
    at = scratch(spark, "job1")
    for _ in range(2):
        out = docs_index.run(spark, f"{sf_dir}/documents[.]parquet", f"{at}/out", f"{at}/checkpoint")
    return out


def job2_link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "job2")
    for _ in range(2):
        out = link_audit.run(spark, f"{sf_dir}/pages.parquet", f"{at}/out")
    return out


QUERIES = {f.__name__: f for f in (job1_docs_index, job2_link_audit)}
SQL = {"job1_docs_index": docs_index.SQL, "job2_link_audit": link_audit.SQL}
