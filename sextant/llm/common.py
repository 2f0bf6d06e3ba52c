"""What the operators of this subpackage share: reading, cutting lineage, and vectorised text kernels.

The kernels work on Arrow string columns as one flat UTF-8 byte array with offsets, so that tokenising,
lower-casing and hashing are numpy operations over about a megabyte of text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.plans.storage import FREED, cut, drop, shared_folder  # noqa: F401

#: A word: a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Texts are handled in groups of about this many bytes (a longer text is a group of its own).
CHUNK = 1 << 20

#: Bytes of a group where a worker's memory counts more than the calls: kernels hold about 25 bytes for each.
SMALL_CHUNK = 1 << 18

#: Words of more bytes get a cryptographic hash: polynomials modulo 2 ** 64 collide by construction on some strings of 1024 bytes and more.
LONG_WORD = 128

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null: the runs left when white space is squeezed."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, m: int) -> Column:
    return F.crc32(doc_id.cast("string")) % m


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, over an array."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_BASE = 0x5851F42D4C957F2D | 1
_TABLE = mix(np.arange(1, 257, dtype=U64) * _ODD)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_TABLE = _TABLE[_LOWER]
IS_WORD = np.ones(256, bool)
IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_POWERS: dict[str, np.ndarray] = {"p": np.ones(1, U64), "q": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2**64, and of its inverse. Those for more than four chunks aren't kept."""
    got = _POWERS
    if len(got["p"]) < n:
        got = {}
        for k, a in (("p", _BASE), ("q", _inverse(_BASE))):
            x = np.full(max(1 << 16, 1 << (n - 1).bit_length()), U64(a))
            x[0] = 1
            got[k] = np.multiply.accumulate(x)
        if n <= 4 * CHUNK:
            _POWERS.update(got)
    return got["p"][:n], got["q"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and where each text begins (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about `most` bytes together."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts in `data`: starts, ends, lower-cased 64-bit hashes, and each text's first word (one more at the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    w = IS_WORD[data]
    cutat = np.zeros(n + 1, bool)
    cutat[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | cutat[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | cutat[1:])) + 1
    p, q = powers(n + 1)
    c = np.zeros(n + 1, U64)
    np.cumsum(_LOWER_TABLE[data] * p[:n], out=c[1:])
    h = mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(U64))
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        low = _LOWER[data[starts[i] : ends[i]]].astype(np.uint8)
        h[i] = np.frombuffer(hashlib.blake2b(low, digest_size=8).digest(), U64)[0]
    return starts, ends, h, np.searchsorted(starts, offsets)


_SHINGLE = [U64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(64)]


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k words in a row, ascending; with fewer words, the whole sequence as one; none without words."""
    n = len(h)
    if n == 0:
        return h
    short = n < k
    g = np.zeros(1 if short else n - k + 1, U64)
    for j in range(n if short else k):
        g += h[j : j + len(g)] * _SHINGLE[j]
    g = mix(g + U64(n if short else k))
    g.sort()
    return g[np.flatnonzero(np.r_[True, g[1:] != g[:-1]])] if len(g) > 1 else g
