"""What the jobs share: configuration, the log, and where a registered query lets them write."""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession

from sextant.plans.storage import shared_folder

log = logging.getLogger("jobs")


def configured(spark: SparkSession, path: str | None, known: dict) -> dict:
    """The defaults with what a JSON file says; a key that the job doesn't know is an error. The path may be remote."""
    if not path:
        return dict(known)
    given = json.loads(spark.read.text(path, wholetext=True).first().value)
    if odd := sorted(set(given) - set(known)):
        raise ValueError(f"{path} has keys that aren't known: {', '.join(odd)}")
    return known | given


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Writes a table whole in partitions. Rows are dealt by them, large ones over several files, so that a partition has few files."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)
    log.info("wrote %s, partitioned by %s", path, ", ".join(by))


def started(parser, argv: list[str] | None):
    """The parsed arguments, with the log set up and a session that the command line owns."""
    from sextant.session import session

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    args = parser.parse_args(argv)
    return args, session(parser.prog)
