"""Packing: bounded-space online packing of token sequences.

Each partition keeps at most `windows` open windows of `length` tokens. A document's tokens (and one end token) are
cut into full windows and a remainder; the remainder goes to the open window that it fills best. Where none has
room, the fullest window is topped up with the remainder's first tokens (unless fewer than `least` would go there, then
it is padded) and emitted, and the rest opens a window. When a partition ends, its open windows are leftovers;
those of up to `together` partitions are merged, largest first, each into the sequence that it fills best.

Scale: one pass over the texts; what is shuffled is only the pieces of leftover windows, at most `windows` a
partition, in groups of bounded size. Memory: one document's ids and the open windows.

Ids are those of the byte-level BPE in `tokenizer` (a `tokenizers` JSON file); they are computed by tiktoken from that
file's vocabulary, whose ids are its merge ranks. Strings of the file's added tokens in a text are those tokens, as with `tokenizers`.

Defined cases: null and empty texts are one end token; a null doc_id stays null; equal rows are packed each; an empty table
gives no rows; further columns are ignored. A sequence id tells the partition (or merge group) and a count in it.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import cut, read_table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Fixed value: how this family of byte-level vocabularies splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict = {}


def encoder(tokenizer: str):
    """The encoder of a byte-level BPE file; one a process."""
    if tokenizer not in _ENCODERS:
        import tiktoken

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _ENCODERS[tokenizer] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[tokenizer]


class Packer:
    """The open windows of a partition: each a list of pieces (document, start, length, crc32, document's tokens)."""

    def __init__(self, length: int, windows: int, least: int):
        self.length, self.windows, self.least = length, windows, least
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list]:
        """Places a document; yields the windows that are done, as lists of pieces."""
        n, at = len(ids), 0

        def piece(k: int) -> tuple:
            nonlocal at
            at += k
            return doc, at - k, k, zlib.crc32(ids[at - k : at].tobytes()), n

        while n - at >= self.length:
            yield [piece(self.length)]
        while at < n:
            r = n - at
            fits = [(w[0], -k) for k, w in enumerate(self.open) if w[0] + r <= self.length]
            if fits:
                k = -max(fits)[1]
                size, pieces = self.open[k]
                pieces.append(piece(r))
                self.open[k] = (size + r, pieces)
                if size + r == self.length:
                    yield self.open.pop(k)[1]
            elif len(self.open) < self.windows:
                self.open.append((r, [piece(r)]))
            else:
                size, pieces = self.open.pop(max(range(len(self.open)), key=lambda k: self.open[k][0]))
                if (gap := self.length - size) >= self.least:
                    pieces.append(piece(gap))
                yield pieces


def merge_leftovers(rows: pd.DataFrame, length: int, base: int) -> pd.DataFrame:
    """Rows of leftover windows (sequence_id, offset): whole windows move together, largest first, best fit."""
    size = rows.groupby("sequence_id", sort=True)["length"].sum()
    order = sorted(size.items(), key=lambda x: (-x[1], x[0]))
    bins: list[int] = []
    moved = {}
    for window, n in order:
        best = max((k for k in range(len(bins)) if bins[k] + n <= length), key=lambda k: (bins[k], -k), default=None)
        if best is None:
            bins.append(0)
            best = len(bins) - 1
        moved[window] = (base + best, bins[best])
        bins[best] += n
    rows = rows.copy()
    rows["offset"] += rows["sequence_id"].map({k: v[1] for k, v in moved.items()}).astype("int64")
    rows["sequence_id"] = rows["sequence_id"].map({k: v[0] for k, v in moved.items()}).astype("int64")
    return rows


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, windows: int = 32, least: int = 16, end: int = 0, together: int = 64) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece, as in SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, part, count = encoder(tokenizer), Packer(length, windows, least), TaskContext.get().partitionId(), 0
        out: list[tuple] = []

        def rows(pieces: list, number: int, left: bool) -> None:
            at = 0
            for p in pieces:
                out.append((*p, (part << 32) + number, at, left))
                at += p[2]

        def batch() -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * 7, pa.bool_()], strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode_to_numpy(text.as_py() or "", allowed_special="all")
                for pieces in packer.add(doc, np.append(ids, end).astype("<u4")):
                    rows(pieces, count, False)
                    count += 1
                if len(out) > 20_000:
                    yield batch()
        for _, pieces in packer.open:
            rows(pieces, count, True)
            count += 1
        if out:
            yield batch()

    done = cut(docs.select("doc_id", "text").mapInArrow(run, SCHEMA + ", left boolean"))  # narrow rows; texts are read once
    left = done.filter("left").withColumn("_group", F.floor(F.shiftright("sequence_id", 32) / together).cast("long"))

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return merge_leftovers(rows, length, (1 << 62) + (int(key[0]) << 32))[[c.split()[0] for c in SCHEMA.split(", ")]]

    return done.filter("not left").drop("left").unionByName(left.drop("left").groupBy("_group").applyInPandas(merge, SCHEMA))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
