"""Where tables are kept: Parquet in versioned folders, with a pointer to the current one; and checkpoints."""

from __future__ import annotations

import json
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.schema import TABLES, schema


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of its own only where that is unset and all tasks run in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoint"))
    return sc.getCheckpointDir()


#: With it, what an execution shuffles goes when it ends, not when the driver happens to collect its garbage; and rows of a batch for Python.
FREED, BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for what is executed meanwhile; the session's own one comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder; what was shuffled for it goes."""
    shared_folder(df.sparkSession)
    with setting(df.sparkSession, FREED, "true"):
        return df.select("*").checkpoint(eager=True)  # an execution of its own, which the setting holds for


def drop(df: DataFrame) -> None:
    """Deletes what cut() has kept of a table that nothing will read again."""
    at = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if at.isDefined():
        _, path, fs = _fs(df.sparkSession, at.get())
        fs.delete(path, True)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file through Hadoop, so that any store that Spark reaches will do."""
    jvm, p, fs = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    jvm, p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


class Catalog:
    """The tables of an index under a folder: a save writes a new version and then moves the pointer, so readers see whole versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def version(self) -> str | None:
        found = read_text(self.spark, f"{self.root}/current.json")
        return json.loads(found)["version"] if found else None

    def save(self, tables: dict[str, DataFrame], **meta: object) -> str:
        version, old = f"v{time.time_ns()}", self.version()
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{version}/{name}")
        kept = {}
        if old:  # what another index under the same root has said stays
            said = json.loads(read_text(self.spark, f"{self.root}/current.json"))
            kept, meta = said["tables"], said["meta"] | meta
        kept |= {name: f"{version}/{name}" for name in tables}
        write_text(self.spark, f"{self.root}/current.json", json.dumps({"version": version, "tables": kept, "meta": meta}))
        return version

    def meta(self) -> dict:
        found = read_text(self.spark, f"{self.root}/current.json")
        return json.loads(found)["meta"] if found else {}

    def table(self, name: str) -> DataFrame:
        """A table of the current version; an empty one where it was never saved."""
        found = read_text(self.spark, f"{self.root}/current.json")
        at = json.loads(found)["tables"].get(name) if found else None
        if at is None:
            if name not in TABLES:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema(name))
        return self.spark.read.parquet(f"{self.root}/{at}")

    def freshness(self, **wanted: object) -> str:
        """fresh, missing, or stale with what differs (layout version, chunk size)."""
        if self.version() is None:
            return "missing"
        meta = self.meta()
        odd = [k for k, v in wanted.items() if meta.get(k) != v]
        return "fresh" if not odd else "stale: " + ", ".join(f"{k} is {meta.get(k)}, not {wanted[k]}" for k in odd)


def semantic_state(chunks: DataFrame, vectors: DataFrame, column: str, stored: str | None = None) -> str:
    """full if every chunk has a vector and all are of one length; no-embed without any; else degraded."""
    r = vectors.filter(F.size(column) > 0).agg(F.count("*").alias("n"), F.min(F.size(column)).alias("lo"), F.max(F.size(column)).alias("hi")).first()
    n = chunks.count()
    if not r.n:
        return "no-embed"
    return "full" if r.n == n and r.lo == r.hi and stored in (None, "full") else "degraded"
