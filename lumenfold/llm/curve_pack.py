"""Packing along a space-filling curve.

Each document's ids are hashed into a vector, projected to a few dimensions, and given the place of
that point on a Hilbert curve. The documents, in curve order, make one stream that is cut into
sequences of ``length`` ids; so a sequence holds neighbours on the curve, and only the last
sequence of all can be padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, running_starts, scratch, stored, tidy
from .tokens import encoder

LENGTH, END_ID = 4096, 2
#: Hashed dimensions, projected dimensions, bits of each on the curve.
HASHED, DIMS, BITS = 64, 3, 10


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2**bits, a row each.

    Skilling's transform ("Programming the Hilbert curve", 2004), over all rows at once: coordinates
    to the transposed index, then bits interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, DIMS)) / sqrt(HASHED)


_ERF = np.vectorize(erf)


def curve_points(vectors: np.ndarray, scale: float = 4.0) -> np.ndarray:
    """Integer coordinates of hashed count vectors: signed square roots, unit length, projected, spread evenly by a normal law."""
    v = np.sign(vectors) * np.sqrt(np.abs(vectors))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    p = (v / np.where(norm == 0, 1, norm)) @ _projection()
    return np.clip((0.5 + 0.5 * _ERF(p * scale)) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hashed_vector(ids: np.ndarray) -> np.ndarray:
    """Counts of ids in HASHED cells, each id with a sign of its own."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    cell, sign = (h >> np.uint64(40)) % np.uint64(HASHED), ((h >> np.uint64(33)) & np.uint64(1)).astype(np.float64) * 2 - 1
    return np.bincount(cell.astype(np.int64), weights=sign, minlength=HASHED)


def _encode(path: str | None, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, pack = encoder(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for first, ids, bounds in enc.column(batch.column(2), end_id):
                n = np.diff(bounds)
                own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                key = hilbert_key(curve_points(np.array([hashed_vector(x[:-1]) for x in own])))
                columns = [batch.column(0).slice(first, len(n)), batch.column(1).slice(first, len(n)), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array([pack.compress(x.tobytes()) for x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _cut(length: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in PIECE.names}
            for doc_id, rid, n, first, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                raw = np.frombuffer(unpack.decompress(ids), dtype).astype("<u4").tobytes()
                at = 0
                while at < n:
                    sequence, offset = divmod(first + at, length)
                    size = min(n - at, length - offset)
                    for k, v in zip(PIECE.names, (doc_id, at, size, zlib.crc32(memoryview(raw)[4 * at : 4 * (at + size)]), n, sequence, offset, rid), strict=True):
                        rows[k].append(v)
                    at += size
            yield pa.RecordBatch.from_pydict(rows, schema=PIECE)

    return run


PIECE = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id")])


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text; other columns are ignored), a row for each.

    doc_id, start (its document's ids before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers), doc_tokens (with the end id), sequence_id and offset there, row_id
    (tells rows with one doc_id apart). A null or empty text has the end id alone. Equal texts lie
    side by side, by doc_id. No rows give no pieces.
    """
    path = path or scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("text"))
    ids = stored(rows.mapInArrow(tidy(_encode(tokenizer, end_id)), "doc_id long, rid long, key long, n long, ids binary"), f"{path}/ids", TEXT_ROWS)
    # Only keys and lengths are sorted; the ids meet their places in one join.
    places = running_starts(ids.select("key", "doc_id", "rid", "n"), ["key", "doc_id", "rid"], "n", f"{path}/order", "first")
    placed = ids.select("doc_id", "rid", "n", "ids").join(places.select("rid", "first"), "rid").select("doc_id", "rid", "n", "first", "ids")
    return placed.mapInArrow(tidy(_cut(length, encoder(tokenizer).dtype)), ", ".join(f"`{k}` long" for k in PIECE.names))
