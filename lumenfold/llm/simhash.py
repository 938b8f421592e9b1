"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Of two fingerprints that differ in three bits at
most, one segment differs in one bit at most; so each segment is indexed as it is, and once with
each of its bits left out. Equal signatures give candidate pairs, and a bit count verifies them.

A fingerprint with bit i set in a segment meets only those with that bit clear (and the same other
bits), so a pair that agrees on a segment is not found again for each bit left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, in_few_files, in_files, scratch, stored, tidy

SEED = 42
#: A group of equal signatures up to this size is compared directly; larger ones are cut again.
DIRECT = 2048
_MASK32 = (1 << 32) - 1


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included; words are lower-cased in A-Z only and split at ASCII white space."""
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) <= size:
        return np.array([h(b" ".join(w), SEED)], np.uint64)
    parts = zip(*(w[i:] for i in range(size)), strict=False)
    return np.fromiter((h(b" ".join(p), SEED) for p in parts), np.uint64, len(w) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes. No hashes: zero."""
    ones, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(hashes), step):
        block = hashes[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of each row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t, size)) for t in b["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(tidy(run), "doc_id long, fp long")


def _segment(fp, s: int):
    return fp.bitwiseAND(_MASK32) if s == 0 else F.shiftrightunsigned(fp, 32)


def _cleared(value, i):
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def _left_out(segment, base: int):
    """One struct (slot, sig, side) for each of the segment's 32 bits."""

    def one(i):
        return F.struct((i + base).alias("slot"), _cleared(segment, i).alias("sig"), F.call_function("shiftrightunsigned", segment, i).bitwiseAND(F.lit(1)).cast("int").alias("side"))

    return F.transform(F.sequence(F.lit(0), F.lit(31)), one)


def _signatures(fps: DataFrame) -> DataFrame:
    """slot, sig, side, fp: slot 0 and 33 are whole segments (side 2), the others have a bit left out (side: that bit)."""
    parts = []
    for s in (0, 1):
        seg = _segment(F.col("fp"), s)
        parts += [F.array(F.struct(F.lit(33 * s).alias("slot"), seg.alias("sig"), F.lit(2).alias("side"))), _left_out(seg, 33 * s + 1)]
    return fps.select("fp", F.explode(F.concat(*parts)).alias("k")).select("k.slot", "k.sig", "k.side", "fp")


def _halves(segment):
    """Structs (h, i, v): each 16-bit half of a segment whole (i = -1) and with each bit left out."""

    def of(h: int):
        half = F.shiftrightunsigned(segment, 16 * h).bitwiseAND(0xFFFF)

        def one(i):
            return F.struct(F.lit(h).alias("h"), i.alias("i"), F.when(i < 0, half).otherwise(_cleared(half, F.greatest(i, F.lit(0)))).alias("v"))

        return F.transform(F.sequence(F.lit(-1), F.lit(15)), one)

    return F.concat(of(0), of(1))


class _Forest:
    """Union-find over positions; ``join`` returns whether two were apart."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def forest_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of ``fps`` (distinct, unsigned) under distances up to ``radius``: fewer than its rows."""
    f, out = _Forest(len(fps)), []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)
        out += [(int(fps[j]), int(fps[i])) for j in near if f.join(int(j), i)]
    return out


def _cube_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The same for fingerprints that differ only in a few bits: each is looked up with up to ``radius`` of those flipped."""
    from itertools import combinations

    free = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [np.uint64(1) << np.uint64(i) for i in range(64) if free >> i & 1]
    if len(bits) > 20 or len(fps) <= DIRECT:
        return forest_links(fps, radius)
    fps = np.sort(fps)
    f, out = _Forest(len(fps)), []
    for n in range(1, radius + 1):
        for c in combinations(bits, n):
            other = fps ^ np.bitwise_or.reduce(np.array(c))
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            for i in np.flatnonzero((fps[at] == other) & (other > fps)):
                if f.join(int(i), int(at[i])):
                    out.append((int(fps[i]), int(other[i])))
    return out


def _links_of(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    fps = np.unique(pdf["fp"].to_numpy().astype(np.int64).view(np.uint64))
    links = np.array(_cube_links(fps, radius), np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})


def fingerprint_links(fps: DataFrame, path: str, radius: int = 3) -> DataFrame:
    """a, b: links between distinct fingerprints (``fps``: fp) whose components are those of all pairs within ``radius`` (3 at most).

    A pair alone in its group is verified in place. A larger group gives links that span it, never
    all its pairs; one of over DIRECT fingerprints is first cut by a second round of signatures over
    the other segment, after which at most 18 bits differ, which bounds a group's size.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with one bit left out find up to three differing bits")
    # Fingerprints are a few bytes each, so they come in few partitions; their 66 signatures each need more.
    sigs = _signatures(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    key, n = ["slot", "sig"], fps.count()
    groups = stored(in_few_files(sigs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min("side").alias("least"), F.max("side").alias("most")).where("n > 1 and (least < most or slot in (0, 33))"), n), f"{path}/groups")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = groups.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(close)
    larger = stored(in_few_files(sigs.join(groups.where("n > 2").select(*key, "n"), key).select(*key, "n", "fp"), n), f"{path}/members")
    near = larger.where(F.col("n") <= DIRECT).groupBy(*key).applyInPandas(lambda pdf: _links_of(pdf, radius), "a long, b long")
    other = F.when(F.col("slot") < 33, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    deep = larger.where(F.col("n") > DIRECT).select(*key, "fp", F.explode(_halves(other)).alias("k")).select(*key, "k.h", "k.i", "k.v", "fp")
    deep = deep.groupBy(*key, "h", "i", "v").applyInPandas(lambda pdf: _links_of(pdf, radius), "a long, b long")
    return pairs.unionByName(near).unionByName(deep).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, path: str, most_rounds: int = 60) -> DataFrame:
    """node, component for every node of ``links`` (a, b: long); component is one node of those that can be reached, the same for all.

    Each round points a node to that of it and its neighbours which has the least hash, follows
    that twice, and rewrites the links between the trees so made. The order by hash is another in
    each round and keeps trees shallow, so links fall geometrically, in chains too. Rounds are
    stored, so lineage stays short. Links are never collected.
    """
    spark = links.sparkSession
    links = stored(links.where("a <> b"), f"{path}/links")
    done: list[DataFrame] = []
    for i in range(most_rounds):
        n = links.count()
        if not n:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, i=i: F.struct(F.xxhash64(F.col(c), F.lit(i)).alias("h"), F.col(c).alias("v"))
        up = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select(F.col("a").alias("node"), F.least("least", rank("a"))["v"].alias("up"))
        up2 = up.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        parent = stored(in_files(up.join(up2, "up").select("node", F.col("up2").alias("up")), 2 * n), f"{path}/parent{i}")
        to = lambda c, parent=parent: parent.select(F.col("node").alias(c), F.col("up").alias(f"{c}2"))
        links = links.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        links = stored(in_files(links, n), f"{path}/links{i}")
        done.append(parent)
    else:
        raise RuntimeError("the components did not settle")
    if not done:
        return spark.createDataFrame([], "node long, component long")
    out = done[0].withColumnRenamed("up", "component")
    for later in done[1:]:
        step = later.select(F.col("node").alias("component"), F.col("up").alias("_up"))
        out = out.join(step, "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
    return out


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 3, path: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs`` (doc_id, text; other columns are ignored).

    Documents of one fingerprint are one class, named by its smallest doc_id; only classes are linked.
    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows with a null
    doc_id keep a null id; their class takes the smallest id that it has, null if none.
    """
    path = path or scratch(docs.sparkSession)
    prints = stored(in_few_files(fingerprints(docs, size), docs.count()), f"{path}/prints", TEXT_ROWS)
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{path}/classes")
    links = stored(fingerprint_links(classes.select("fp"), path, radius), f"{path}/fplinks")
    found = components(links, path)
    # A component's id is the smallest doc_id of its classes, so the smallest fingerprint is replaced.
    labelled = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = stored(labelled.join(ids, "component").select("fp", "component_id"), f"{path}/labels")
    return prints.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
