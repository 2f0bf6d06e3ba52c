"""Files to tables: discovery, excludes, scopes, hashes, and legacy index files."""

from __future__ import annotations

import json
import subprocess
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sextant.functions import text as X
from sextant.schema import schema

# Defaults of a configuration.
CODE_EXTENSIONS = (".fs", ".fsx", ".cs", ".js", ".jsx", ".ts", ".tsx", ".py", ".go", ".rs")
CODE_EXCLUDES = ("bin", "obj", "node_modules", ".git", "dist", "build")
DOC_EXCLUDES = ("node_modules", ".git", "bin/", "obj/")
SRC_DIRS = ("src", "lib", "Source", "app")
DOC_DIRS = (".agents", "docs", "doc", "wiki", "knowledge")


@dataclass
class Config:
    """What to index and how; from a JSON file where there is one, defaults else."""

    src_dirs: list[str] = field(default_factory=list)
    doc_dirs: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=lambda: list(CODE_EXTENSIONS))
    scopes: dict[str, list[str]] = field(default_factory=dict)
    embedding_url: str = ""
    embedding_batch: int = 50
    max_chunk_chars: int = 3000

    @classmethod
    def load(cls, text: str | None) -> Config:
        """Unknown keys are left out; custom excludes add to the defaults."""
        given = json.loads(text) if text else {}
        c = cls(**{k: v for k, v in given.items() if k in cls.__dataclass_fields__})
        c.exclude = [*dict.fromkeys([*CODE_EXCLUDES, *c.exclude])]
        return c

    def detect(self, top: list[str]) -> Config:
        """Fills in folders and scopes from the names in the repository's root."""
        self.src_dirs = self.src_dirs or [d for d in SRC_DIRS if d in top] or ["."]
        self.doc_dirs = self.doc_dirs or [d for d in DOC_DIRS if d in top] or ["."]
        if not self.scopes:
            tests = [d for d in top if "test" in d.lower()]
            self.scopes = {"all": self.src_dirs + tests} | {d: [d] for d in self.src_dirs} | ({"tests": tests} if tests else {}) | ({"tools": ["tools"]} if "tools" in top else {})
        return self


def excluded(path: Column | str, rules: list[str] | tuple[str, ...]) -> Column:
    """A bare rule excludes a path segment of that name; one with * or ? is a glob over the whole path."""
    p, out = X.slashed(path), F.lit(False)
    parts = F.split(p, "/")
    for r in rules:
        out = out | (p.rlike(X.glob_pattern(r)) if "*" in r or "?" in r else F.array_contains(parts, r.strip("/")))
    return out


def read_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(file_path, content, sha256, modified) of all files under root, paths relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    tail = PurePosixPath(root.split("://", 1)[-1]).as_posix().rstrip("/")
    full = F.regexp_replace("path", "^[a-z0-9]+:/+(?=/)|^[a-z0-9]+:(?=/)", "")
    start = F.instr(full, tail.rsplit(":", 1)[-1]) + len(tail) + 1
    return df.select(F.substring(full, start, F.length(full)).alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def code_files(files: DataFrame, config: Config) -> DataFrame:
    ext = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1)).isin(*config.extensions)
    inside = F.lit("." in config.src_dirs)
    for d in config.src_dirs:
        inside = inside | F.col("file_path").startswith(d.rstrip("/") + "/")
    return files.filter(ext & inside & ~excluded("file_path", config.exclude))


def doc_files(files: DataFrame, config: Config, exclude: tuple[str, ...] = DOC_EXCLUDES) -> DataFrame:
    """Markdown files; a path that holds an excluded text is left out. A list of one's own replaces the defaults."""
    inside = F.lit("." in config.doc_dirs)
    for d in config.doc_dirs:
        inside = inside | F.col("file_path").startswith(d.rstrip("/") + "/")
    out = files.filter(F.lower("file_path").endswith(".md") & inside)
    for e in exclude:
        out = out.filter(~F.col("file_path").contains(e))
    return out.dropDuplicates(["file_path"])


def in_scope(path: Column | str, dirs: list[str]) -> Column:
    out = F.lit(False)
    for d in dirs:
        out = out | X.slashed(path).startswith(d.rstrip("/") + "/")
    return out


def changed_paths(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """Paths that git names as changed since a commit; where git fails, its words are the error."""
    run = subprocess.run(["git", "-C", repo, "diff", "--name-only", ref], capture_output=True, text=True)
    if run.returncode:
        raise ValueError(f"git diff {ref}: {run.stderr.strip()}")
    return spark.createDataFrame([(p,) for p in run.stdout.splitlines() if p], "file_path string")


def _tabbed(spark: SparkSession, path: str, least: int) -> tuple[DataFrame, Column]:
    """The lines of a tab-separated file with `least` fields or more, and the fields."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(f) >= least), f


def _list(x: Column) -> Column:
    return F.filter(F.split(x, ","), lambda y: y != "")


def legacy_imports(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, module) of a tab-separated file of the old kind."""
    rows, f = _tabbed(spark, path, 2)
    return rows.select(F.get(f, F.lit(0)).alias("file_path"), F.get(f, F.lit(1)).alias("module"))


def legacy_type_refs(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, types): names apart by commas."""
    rows, f = _tabbed(spark, path, 2)
    return rows.select(F.get(f, F.lit(0)).alias("file_path"), _list(F.get(f, F.lit(1))).alias("types"))


def legacy_links(spark: SparkSession, path: str) -> DataFrame:
    """doc_links; an empty resolved target is null."""
    rows, f = _tabbed(spark, path, 6)
    names = ("source_file", "source_heading", "target_path", "target_resolved", "link_text")
    cols = [F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)]
    return rows.select(*cols, F.get(f, F.lit(5)).cast("int").alias("line")).withColumn("target_resolved", F.when(F.col("target_resolved") != "", F.col("target_resolved")))


def legacy_frontmatters(spark: SparkSession, path: str) -> DataFrame:
    """frontmatters, without the further keys, which the old kind doesn't keep."""
    rows, f = _tabbed(spark, path, 6)
    cols = [F.get(f, F.lit(i)).alias(n) for i, n in enumerate(("file_path", "id", "title", "status"))]
    none = F.lit(None).cast("map<string,string>").alias("extra")
    return rows.select(*cols, _list(F.get(f, F.lit(4))).alias("tags"), _list(F.get(f, F.lit(5))).alias("related"), none)


def peer_index(spark: SparkSession, root: str, override: str | None = None, name: str = ".sextant-docs") -> str | None:
    """Where the other index lies: the folder that was named, the index folder in it, or the one beside the repository's own; None without one."""
    from sextant.plans.storage import read_text

    for at in (override, f"{override}/{name}") if override else (f"{root}/{name}",):
        if read_text(spark, f"{at}/current.json") is not None:
            return at
    return None


_SOURCE = "cid string, filePath string, moduleName string, name string, kind string, startLine int, endLine int, content string, context string"


def legacy_source(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a JSON-lines file of the old kind; lines that can't be read are lost_lines()."""
    rows = spark.read.schema(_SOURCE).option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.col("cid").alias("chunk_id"), F.col("filePath").alias("file_path"), F.col("moduleName").alias("module"), "name", "kind", F.col("startLine").alias("start_line"), F.col("endLine").alias("end_line"), "content", "context")


def lost_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines of such a file that are no JSON of that shape."""
    read = F.from_json("value", _SOURCE + ", _lost string", {"columnNameOfCorruptRecord": "_lost"})
    return spark.read.text(path).filter(read["_lost"].isNotNull()).select(F.col("value").alias("line"))


def legacy_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Code chunks of a tab-separated file of the old kind: a header "#fields:" names the columns, others than the first eight
    go to `extra`; rows of fewer than seven are dropped."""
    lines = spark.read.text(path)
    head = lines.filter(F.col("value").startswith("#fields:")).limit(1).collect()
    names = (head[0].value[8:].strip().replace("\t", " ").split() if head else []) or "FilePath Module Name Kind StartLine EndLine Summary Signature".split()
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#")).filter(F.size(f) >= 7)
    extra = F.map_from_arrays(F.array(*[F.lit(n) for n in names[8:]]), F.array(*[F.get(f, F.lit(8 + i)) for i in range(len(names) - 8)])) if len(names) > 8 else F.lit(None)
    known = ("file_path", "module", "name", "kind", "start_line", "end_line", "summary", "signature")
    cols = [(F.get(f, F.lit(i)).cast("int") if "line" in k else F.get(f, F.lit(i))).alias(k) for i, k in enumerate(known)]
    return rows.select(*cols, extra.cast("map<string,string>").alias("extra"))


#: Bytes of a matrix that one task reads.
MATRIX_PART = 64 << 20


class MatrixReader(DataSourceReader):
    """Parts of a matrix as ranges of its rows; each task opens the file at its own place."""

    def __init__(self, path: str, rows: int, length: int, part: int) -> None:
        self.path, self.rows, self.length = path, rows, length
        self.step = max(1, part // max(1, 4 * length))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((a, min(a + self.step, self.rows))) for a in range(0, self.rows, self.step)]

    def read(self, partition: InputPartition):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path)
        first, last = partition.value if partition else (0, 0)  # an empty matrix has no parts
        with store.open_input_file(path) as f:
            for a in range(first, last, 10_000):
                b = min(a + 10_000, last)
                m = np.frombuffer(f.read_at((b - a) * 4 * self.length, 8 + a * 4 * self.length), "<f4")
                if len(m) != (b - a) * self.length:
                    raise ValueError(f"{self.path} ends before row {b} of {self.rows}")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * self.length, pa.int32()), pa.array(m, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b), pa.int64()), lists], ["position", "emb"])


class Matrix(DataSource):
    """spark.read.format("matrix"): options path (a uri), rows, length and part."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "position long, emb array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options["rows"]), int(self.options["length"]), int(self.options.get("part", MATRIX_PART)))


def legacy_vectors(spark: SparkSession, path: str, part: int = MATRIX_PART) -> DataFrame:
    """(position, emb) of a binary matrix: count and length as 32-bit integers, then little-endian floats.

    The header is read first; then every task reads `part` bytes of rows, so that a file of any size is many tasks.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = store.makeQualified(at)
    stream = store.open(at)
    try:
        rows, length = (jvm.java.lang.Integer.reverseBytes(stream.readInt()) for _ in range(2))
    finally:
        stream.close()
    spark.dataSource.register(Matrix)
    return spark.read.format("matrix").option("path", at.toString()).option("rows", rows).option("length", length).option("part", part).load()


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schema(name))
