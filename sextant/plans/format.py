"""Small results as text: what a caller reads, after a limit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stamped(df: DataFrame, source: str) -> DataFrame:
    """Rows that say which primitive made them, so that mixed results can be shown row by row."""
    return df.withColumn("_source", F.lit(source))


def value(x: object, score: bool = False) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return f"{x:.2f}" if score else f"{x:.0f}" if x == int(x) else f"{x:.3f}"
    if isinstance(x, (list, tuple)):
        return ", ".join(value(y) for y in x)
    return str(x)


def line(row: dict) -> str:
    source = row.get("_source")
    body = "  ".join(f"{k}={value(v, k == 'score')}" for k, v in row.items() if k != "_source" and v not in (None, "", []))
    return f"[{source}] {body}" if source else body


def render(df: DataFrame, limit: int = 50, as_json: bool = False) -> str:
    rows = [r.asDict(recursive=True) for r in df.limit(limit).collect()]
    return json.dumps(rows, default=str, ensure_ascii=False) if as_json else "\n".join(map(line, rows))
