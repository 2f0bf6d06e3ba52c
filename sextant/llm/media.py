"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles and difference hashes.

`decode` reads PBM, PGM and PPM (plain and raw, with comments, 8 and 16 bits) and uncompressed BMP (1, 4, 8, 24
and 32 bits, either row order). `encode_ppm` and `encode_bmp` write 8-bit RGB losslessly. `area_resize` averages
exact fractional areas by an integral image; `npy` writes a tile as an NPY file; `dhash` compares neighbours.

All work is row by row in Arrow batches (mapInArrow): no shuffle, memory bounded by a batch and its largest row.

Defined cases: a null text is an empty one; an empty payload is padded to one block of spaces; bytes that are no
image give null pixels, tile and feature in `media_columns` instead of an error; equal bytes give equal values;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import read_table

WIDTH = 64
#: Bytes of media that are handled at a time.
RUN = 32 << 20
_HEADER = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def encode_ppm(pixels: np.ndarray, comment: str = "") -> bytes:
    h, w, _ = pixels.shape
    return b"P6\n" + (f"#{comment}\n".encode() if comment else b"") + b"%d %d\n255\n" % (w, h) + pixels.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24 bits, bottom row first, rows padded to four bytes."""
    h, w, _ = pixels.shape
    row = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    row[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + row.size, 0, 0, 54, 40, w, h, 1, 24, 0, row.size, 2835, 2835, 0, 0) + row.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1:2], 2, []
    for _ in range(2 if kind in b"14" else 3):
        m = _HEADER.match(data, at)
        if not m:
            raise ValueError("not a Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    most = 1 if kind in b"14" else head[2]
    depth = 3 if kind in b"36" else 1
    n = w * h * depth
    if kind in b"123":
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        found = re.findall(rb"[01]" if kind == b"1" else rb"\d+", body)[:n]
        x = np.array(found, dtype=np.int64)
    elif kind == b"4":
        rows = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        x = np.unpackbits(rows, axis=1)[:, :w].ravel().astype(np.int64)
    else:
        x = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1)
    if len(x) != n or not 0 < most < 65536:
        raise ValueError("short Netpbm data")
    if kind in b"14":
        x = 1 - x  # 1 is black
    if most != 255:
        x = (x.astype(np.int64) * 255 + most // 2) // most
    return x.astype(np.uint8).reshape(h, w, depth)


def _bmp(data: bytes) -> np.ndarray:
    at, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("a BMP of this kind isn't read")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits >= 24:
        k = bits // 8
        return np.ascontiguousarray(rows[:, : w * k].reshape(abs(h), w, k)[:, :, 2::-1])
    shifts = np.arange(8 - bits, -1, -bits)
    index = ((rows[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(abs(h), -1)[:, :w]
    palette = np.frombuffer(data, np.uint8, (at - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    return palette[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels as a (height, width, depth) array of 8-bit samples; ValueError for other bytes."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (struct.error, IndexError, TypeError) as e:
        raise ValueError(str(e)) from e
    raise ValueError("neither Netpbm nor BMP")


def area_resize(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over h x w equal areas, with fractional borders, from the integral image."""
    t = np.zeros((gray.shape[0] + 1, gray.shape[1] + 1))
    np.cumsum(np.cumsum(gray, 0, dtype=np.float64), 1, out=t[1:, 1:])

    def at(n: int, k: int, x: np.ndarray) -> np.ndarray:
        edge = np.arange(k + 1) * (n / k)
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low)[:, None]
        return x[low] * (1 - part) + x[low + 1] * part

    t = at(gray.shape[0], h, t)
    t = at(gray.shape[1], w, np.ascontiguousarray(t.T)).T
    return np.diff(np.diff(t, axis=0), axis=1) * (h * w / gray.size)


def npy(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(x), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def dhash(tile: np.ndarray) -> str:
    """64 bits in hex: is each of 8 x 9 cells less than its right neighbour?"""
    return np.packbits(tile[:, :-1] + 1e-9 < tile[:, 1:]).tobytes().hex()


def features(data: bytes) -> tuple[bytes, bytes, str]:
    """Pixels, the NPY tile of 8 x 9 gray means, and its difference hash."""
    x = decode(data)
    gray = x[:, :, 0] if x.shape[2] == 1 else x.mean(axis=2)
    tile = area_resize(gray, 8, 9).astype("<f4")
    return x.tobytes(), npy(tile), dhash(tile)


def text_to_media(payload: bytes) -> bytes:
    """A PPM of width 64 whose samples are the payload, padded with spaces to whole rows of 192 bytes, one at least.

    A comment in its header gives the number of bytes before padding.
    """
    n, row = len(payload), 3 * WIDTH
    payload = payload.ljust(max(1, -(-n // row)) * row, b" ")
    return encode_ppm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3), f"bytes {n}")


def _runs(values: pa.Array) -> Iterator[tuple[int, int]]:
    """Begins and lengths of runs of binary values of about RUN bytes together, one value at least, 512 at most."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in values], np.int64)
    ends = np.cumsum(size)
    a = 0
    while a < len(size):
        past = ends[a] - size[a] + RUN
        n = max(1, min(512, int(np.searchsorted(ends, past, "right")) - a))
        yield a, n
        a += n


def store_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, media): each text's bytes stored as an image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()) if not pa.types.is_binary(b.column(1).type) else b.column(1)
            for a, n in _runs(texts):
                media = [text_to_media(x.as_py() or b"") for x in texts.slice(a, n)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, n), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def media_columns(media: DataFrame) -> DataFrame:
    """media (doc_id, media) -> (doc_id, media, pixels, tile, feature); null for bytes that are no image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, n in _runs(b.column(1)):
                part, out = b.slice(a, n), []
                for x in part.column(1):
                    try:
                        out.append(features(x.as_py() or b""))
                    except ValueError:
                        out.append((None, None, None))
                pixels, tile, feature = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pixels, pa.binary()), pa.array(tile, pa.binary()), pa.array(feature, pa.string())], ["doc_id", "media", "pixels", "tile", "feature"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, media binary, pixels binary, tile binary, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    x = media_columns(store_texts(docs))
    head = F.decode(F.expr("substring(media, 1, 32)"), "ISO-8859-1")
    tail = F.expr("substring(pixels, octet_length(pixels) - 15, 16)")
    return x.select(
        "doc_id",
        F.regexp_extract(head, r"#bytes (\d+)", 1).cast("long").alias("n_bytes"),
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
