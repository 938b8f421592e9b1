"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks at places that depend on
nearby ids only, so texts that share a passage share its chunks. The store is three tables in one
folder:

``chunks``    digest, n_ids, payload: every distinct chunk once, its ids zstd-compressed.
``recipes``   doc_id, start, n_tokens, digests, lengths, root, ...: what each document is made of,
              in ascending doc_id order; ``root`` is the Merkle root over its chunk digests.
``manifest``  one row for each part of the recipes: counts, the first start, and the Merkle root over
              its documents' roots in order; and one for the store (part -1), whose root is over
              those of its parts.

Reading recomputes every digest from the stored ids, every root from the digests, every part's and
the store's root from those, and compares; what is missing on either side raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, running_starts, scratch, stored, tidy
from .tokens import encoder

DIGEST = 16
END_ID = 1


def chunk_digest(ids: bytes | memoryview) -> bytes:
    return hashlib.blake2b(ids, digest_size=DIGEST).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    """Binary tree of BLAKE2b nodes; an odd node moves up as it is. No digests: a root of zeros."""
    level = list(digests)
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\x01" + level[i] + level[i + 1], digest_size=DIGEST).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + ([level[-1]] if len(level) % 2 else [])
    return level[0] if level else bytes(DIGEST)


class Cutter:
    """Cut positions of an id stream: where a polynomial rolling hash of the last ``window`` ids has ``bits`` zero bits.

    No chunk but the last is shorter than ``least`` ids, and none is longer than ``most``.
    """

    def __init__(self, window: int = 16, bits: int = 9, least: int = 128, most: int = 4096):
        if least < window:
            raise ValueError("least must be at least window")
        self.window, self.mask, self.least, self.most = window, np.uint32((1 << bits) - 1), least, most

    def marks(self, ids: np.ndarray) -> np.ndarray:
        """Positions at which the hash of the window that ends before them allows a cut."""
        x = ids.astype(np.uint32) * np.uint32(2654435761)
        x ^= x >> np.uint32(15)
        h = np.zeros(len(x), np.uint32)
        with np.errstate(over="ignore"):
            for j in range(self.window):
                h = h * np.uint32(0x01000193)
                h[self.window - 1 :] += x[j : len(x) - self.window + 1 + j]
        return np.flatnonzero(((h >> np.uint32(7)) & self.mask) == 0) + 1 if len(x) >= self.window else np.zeros(0, np.int64)

    def cuts(self, n: int, marks: list[int]) -> list[int]:
        """Ends of the chunks of a stream of ``n`` ids with these marks."""
        out, last = [], 0
        for m in [*marks, n]:
            while m - last > self.most:
                last += self.most
                out.append(last)
            if m - last >= self.least and m < n:
                last = m
                out.append(m)
        if last < n:
            out.append(n)
        return out


def _encode(path: str | None, cutter: Cutter, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, pack, seen = encoder(path), zstandard.ZstdCompressor(level=1), set()
        width = enc.width

        def recipes(keys: list, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            marks, whole = cutter.marks(ids), memoryview(ids.tobytes())
            at = np.searchsorted(marks, bounds)
            rows: dict[str, list] = {k: [] for k in ("doc_id", "rid", "n_tokens", "digests", "lengths", "root", "fresh")}
            for i, (doc_id, rid) in enumerate(keys):
                b, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
                # A mark whose window reaches into the document before is none of this one's.
                own = [int(m) for m in marks[at[i] : at[i + 1]] - b if m >= cutter.window]
                digests, lengths, fresh, last = [], [], [], 0
                for end in cutter.cuts(n, own):
                    chunk = whole[(b + last) * width : (b + end) * width]
                    d = chunk_digest(chunk)
                    if d not in seen:
                        seen.add(d)
                        fresh.append({"digest": d, "n_ids": end - last, "payload": pack.compress(chunk)})
                    digests.append(d)
                    lengths.append(end - last)
                    last = end
                for k, v in (("doc_id", doc_id), ("rid", rid), ("n_tokens", n), ("digests", b"".join(digests)), ("lengths", np.array(lengths, "<u4").tobytes()), ("root", merkle_root(digests)), ("fresh", fresh)):
                    rows[k].append(v)
            return pa.RecordBatch.from_pydict(rows, schema=_ENCODED)

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for first, ids, bounds in enc.column(batch.column(2), end_id):
                yield recipes(keys[first : first + len(bounds) - 1], ids, bounds)

    return run


_CHUNK = pa.struct([("digest", pa.binary()), ("n_ids", pa.int32()), ("payload", pa.binary())])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("lengths", pa.binary()), ("root", pa.binary()), ("fresh", pa.list_(_CHUNK))])
_ENCODED_DDL = "doc_id long, rid long, n_tokens long, digests binary, lengths binary, root binary, fresh array<struct<digest: binary, n_ids: int, payload: binary>>"


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, cutter: Cutter | None = None) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) into a store at ``path``.

    Null texts are empty and hold the end id only; very long ones are many chunks. Rows with one doc_id, or a null doc_id, are all
    kept, in any order among themselves; nulls come first. An empty table gives an empty store.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("text"))
    encoded = stored(rows.mapInArrow(tidy(_encode(tokenizer, cutter or Cutter(), end_id)), _ENCODED_DDL), f"{path}/encoded", TEXT_ROWS)
    # A task lists each digest once, so a digest has at most one row for each task here.
    fresh = encoded.select(F.explode("fresh").alias("c")).select("c.*")
    stored(fresh.groupBy("digest").agg(F.first("n_ids").alias("n_ids"), F.first("payload").alias("payload")), f"{path}/chunks")
    recipes = running_starts(encoded.drop("fresh"), ["doc_id", "rid"], "n_tokens", f"{path}/ordered")
    recipes = stored(recipes, f"{path}/recipes")
    stored(docs.sparkSession.createDataFrame(manifest(recipes), _MANIFEST_DDL).coalesce(1), f"{path}/manifest")


_MANIFEST_DDL = "part long, n_docs long, n_tokens long, first_start long, root binary"


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        roots = []
        for places in b.column(4):
            roots.append(merkle_root([p["root"] for p in places.as_py()]))
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(roots, pa.binary())], names=["part", "n_docs", "n_tokens", "first_start", "root"])


def manifest(recipes: DataFrame) -> list[tuple]:
    """(part, n_docs, n_tokens, first_start, root) of each part of ``recipes`` in order, and of the whole as part -1. A part is what one task wrote."""
    place = F.sort_array(F.collect_list(F.struct("start", "root"))).alias("places")
    parts = recipes.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.min("start").alias("first_start"), place)
    rows = sorted((r["part"], r["n_docs"], r["n_tokens"], r["first_start"], bytes(r["root"])) for r in parts.mapInArrow(tidy(_part_roots), _MANIFEST_DDL).collect())
    return [(-1, sum(r[1] for r in rows), sum(r[2] for r in rows), 0, merkle_root([r[4] for r in rows])), *rows]


def _crc_tables() -> np.ndarray:
    """tables[k, j, v]: the CRC-32 state v << 8j moved on by 2**k zero bytes."""
    step = np.zeros(256, np.uint32)
    for i in range(256):
        c = i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        step[i] = c
    values = np.arange(256, dtype=np.uint32)
    t = np.stack([values << np.uint32(8 * j) for j in range(4)])
    t = step[t & 0xFF] ^ (t >> np.uint32(8))
    out = [t]
    for _ in range(39):
        last = out[-1]
        out.append(_moved(last, last))
    return np.stack(out)


def _moved(crc: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t[0][crc & 0xFF] ^ t[1][(crc >> np.uint32(8)) & 0xFF] ^ t[2][(crc >> np.uint32(16)) & 0xFF] ^ t[3][crc >> np.uint32(24)]


def crc_moved(crc: np.ndarray, n_bytes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32 of A followed by B is crc_moved(crc(A), len(B)) ^ crc(B)."""
    crc, n_bytes = crc.astype(np.uint32), n_bytes.astype(np.int64)
    for k in range(len(tables)):
        if (on := (n_bytes >> k) & 1 == 1).any():
            crc[on] = _moved(crc[on], tables[k])
    return crc


def _read_chunks(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            digests, crcs, counts = batch.column(0).to_pylist(), [], []
            for d, n, payload in zip(digests, batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = unpack.decompress(payload.as_buffer())
                values = np.frombuffer(ids, dtype).astype("<u4")
                if chunk_digest(ids) != d or len(values) != n:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                crcs.append(zlib.crc32(values.tobytes()))
                counts.append(n)
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "crc": pa.array(crcs, pa.int64()), "n_ids": pa.array(counts, pa.int32())})

    return run


def _read_recipes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for doc_id, start, n, rid, digests, lengths, root in zip(b.doc_id, b.start, b.n_tokens, b.rid, b.digests, b.lengths, b.root, strict=True):
            parts = [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
            sizes = np.frombuffer(lengths, "<u4").astype(np.int64)
            if merkle_root(parts) != root or sizes.sum() != n or len(sizes) != len(parts):
                raise ValueError(f"the recipe of document {doc_id} is damaged")
            after = n - np.cumsum(sizes)
            out += [(doc_id, start, n, rid, len(parts), p, int(a)) for p, a in zip(parts, after, strict=True)]
        frame = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "rid", "n_chunks", "digest", "ids_after"])
        yield frame.astype({"doc_id": "Int64"})


def _shift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tables = _crc_tables()
    for b in batches:
        b["crc"] = crc_moved(b["crc"].to_numpy(), b.pop("ids_after").to_numpy() * 4, tables).astype("int64")
        yield b


def read_store(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """A row for each document: doc_id, start, n_tokens, ids_crc32, rebuilt from the stored chunks.

    Raises if a chunk, a recipe or the manifest doesn't hold what it says. A document's CRC-32 comes
    from those of its chunks, each taken over the ids read from the chunk, so no ids are shuffled.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    # A row for each part, on both sides.
    if manifest(recipes) != sorted((r["part"], r["n_docs"], r["n_tokens"], r["first_start"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/manifest").collect()):
        raise ValueError("the manifest doesn't match the recipes")
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(_read_chunks(dtype), "digest binary, crc long, n_ids int")
    wanted = recipes.select("doc_id", "start", "n_tokens", "rid", "digests", "lengths", "root").mapInPandas(_read_recipes, "doc_id long, start long, n_tokens long, rid long, n_chunks int, digest binary, ids_after long")
    crc = F.when(F.col("crc").isNull(), F.raise_error(F.lit("a chunk is missing")).cast("long")).otherwise(F.col("crc"))
    found = wanted.join(chunks, "digest", "left").select("doc_id", "start", "n_tokens", "rid", "n_chunks", "ids_after", crc.alias("crc"), "n_ids")
    moved = found.mapInPandas(_shift, "doc_id long, start long, n_tokens long, rid long, n_chunks int, crc long, n_ids int")
    docs = moved.groupBy("doc_id", "start", "n_tokens", "rid").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n_ids").alias("_ids"), F.count(F.lit(1)).alias("_n"), F.first("n_chunks").alias("_want"))
    whole = (F.col("_n") == F.col("_want")) & (F.col("_ids") == F.col("n_tokens"))
    return docs.select("doc_id", "start", "n_tokens", F.when(whole, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a chunk is missing"))).alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """doc_id, start and the whole ids of each document as array<int>, put together from its chunks."""
    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "payload")
    wanted = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", "n_tokens", "rid", "digests", "lengths", "root").mapInPandas(_read_recipes, "doc_id long, start long, n_tokens long, rid long, n_chunks int, digest binary, ids_after long")
    payload = F.when(F.col("payload").isNull(), F.raise_error(F.lit("a chunk is missing")).cast("binary")).otherwise(F.col("payload"))
    parts = wanted.join(chunks, "digest", "left").withColumn("payload", payload).groupBy("doc_id", "start", "rid").agg(F.sort_array(F.collect_list(F.struct((-F.col("ids_after")).alias("at"), "payload"))).alias("parts"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "start": b.start, "ids": [np.concatenate([np.frombuffer(unpack.decompress(p["payload"]), dtype).astype(np.int32) for p in x]) for x in b.parts]})

    return parts.mapInPandas(join, "doc_id long, start long, ids array<int>")


def token_store_query(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Store all of ``docs``, read the store back, and describe each document by what was read."""
    path = scratch(spark)
    write_store(docs, path, tokenizer)
    return read_store(spark, path)
