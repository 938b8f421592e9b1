"""One document of each group of near duplicates: five-word shingles, similarity 0.8.

Candidates come from two indexes over classes of documents with equal shingle sets: the SimHash
deletion-variant index, and, because texts at similarity 0.8 often differ in more than three
fingerprint bits, bands of minwise hashes. Either only proposes; a candidate pair is linked if the
Jaccard similarity of its whole shingle sets reaches the limit. In a group of equal bands each class
first meets one leader of the group. A group that those links leave in several components is then
compared whole: every pair of its members from different components, in blocks of bounded size.
Texts are read twice, for their sketches and for the shingle hashes of those in any group; from then
on only hashes move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, give_back, in_files, scratch, stored, tidy
from .simhash import components, fingerprint, fingerprint_links, shingle_hashes

#: Bands of ROWS minwise hashes each: a pair at similarity 0.8 shares no band with a chance of 0.0002.
BANDS, ROWS = 16, 4
#: Share of equal minwise hashes under which a pair isn't compared; five deviations below 0.8.
LEAST_EQUAL = 0.55
#: A block of a group has about so many shingles and members at most; a task compares two blocks.
BLOCK_SHINGLES, BLOCK_MEMBERS = 250_000, 1000
_MULTIPLIERS = np.random.default_rng(29).integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint64(0x9E3779B97F4A7C15)


def minwise(h: np.ndarray) -> np.ndarray:
    """The least of the distinct hashes ``h`` under each of BANDS * ROWS multipliers."""
    if not len(h):
        return np.full(BANDS * ROWS, _EMPTY)
    out = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), 4096):
        np.minimum(out, (h[i : i + 4096, None] * _MULTIPLIERS).min(0), out=out)
    return out


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for text in b.column(2):
                every = shingle_hashes(text.as_py(), size)
                h = np.unique(every)
                m = minwise(h)
                folded = m.reshape(BANDS, ROWS)
                bands = folded[:, 0].copy()
                for r in range(1, ROWS):
                    bands = (bands ^ (bands >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + folded[:, r]
                key = np.bitwise_xor.reduce(h * np.uint64(0x94D049BB133111EB) ^ (h >> np.uint64(31))) ^ np.uint64(len(h)) if len(h) else np.uint64(0)
                rows.append((np.uint64(key).astype(np.int64), np.uint64(fingerprint(every)).astype(np.int64), len(h), bands.view(np.int64), (m >> np.uint64(56)).astype(np.uint8).tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            made = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(list(cols[3]), pa.list_(pa.int64())), pa.array(cols[4], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["_rid", "_id", "set", "fp", "n", "bands", "bytes"])

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def candidates(classes: DataFrame, path: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs to compare first, and the groups that they may not join.

    a, b: pairs of classes (``classes``: set, fp, n, bands, bytes) that the two indexes propose and
    that sizes and minwise bytes allow. band, v, set, n: members of the groups of three or more classes
    with an equal band, or (band BANDS) with fingerprints linked within three bits.
    """
    me = F.struct("set", "n", "bytes")
    cells = stored(classes.select(me.alias("me"), F.posexplode("bands").alias("band", "v")), f"{path}/cells")
    leaders = cells.groupBy("band", "v").agg(F.count(F.lit(1)).alias("k"), F.min("me").alias("other")).where("k > 1")
    members = stored(cells.join(leaders, ["band", "v"]), f"{path}/members")
    near = members.select("me", "other")
    first = classes.groupBy("fp").agg(F.min(me).alias("lead"), F.count(F.lit(1)).alias("k"))
    same = classes.select("fp", me.alias("me")).join(first.where("k > 1"), "fp").select("me", F.col("lead").alias("other"))
    links = stored(fingerprint_links(first.select("fp"), f"{path}/variants"), f"{path}/fplinks")
    of = lambda c, n: first.select(F.col("fp").alias(c), F.col("lead").alias(n))
    hamming = links.join(of("a", "me"), "a").join(of("b", "other"), "b").select("me", "other")
    pairs = near.unionByName(same).unionByName(hamming).where(F.col("me.set") != F.col("other.set"))
    # Similar sets are of similar size.
    pairs = pairs.where(F.least("me.n", "other.n") >= similarity * F.greatest("me.n", "other.n"))
    equal = F.size(F.filter(F.sequence(F.lit(1), F.lit(BANDS * ROWS)), lambda i: F.substring("me.bytes", i, F.lit(1)) == F.substring("other.bytes", i, F.lit(1))))
    distinct = pairs.groupBy(F.least("me.set", "other.set").alias("a"), F.greatest("me.set", "other.set").alias("b")).agg(F.first("me").alias("me"), F.first("other").alias("other"))
    linked = components(links, f"{path}/fpgroups").select(F.col("node").alias("fp"), F.col("component").alias("v"))
    prints = classes.select("fp", "set", "n").join(linked, "fp", "left").select(F.lit(BANDS).alias("band"), F.coalesce("v", "fp").alias("v"), "set", "n")
    crowded = prints.groupBy("band", "v").agg(F.count(F.lit(1)).alias("k")).where("k > 2").select("band", "v")
    groups = members.where("k > 2").select("band", "v", "me.set", "me.n").unionByName(prints.join(crowded, ["band", "v"]))
    return distinct.where(equal >= LEAST_EQUAL * BANDS * ROWS).select("a", "b"), groups


def spanning(components: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of components that have members (``sets``: distinct hashes, none empty) at the limit; what they join is what all such pairs join."""
    _, label = np.unique(components, return_inverse=True)
    n = np.array([len(s) for s in sets])
    kinds, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    # The member whose shingles most others have comes first: it may join them all at once.
    order = np.argsort(-np.add.reduceat(np.bincount(at)[at], starts) / n, kind="stable")
    most = np.bincount(label).argmax()
    home = order[np.flatnonzero(label[order] == most)[-1]] if (label == most).sum() > 1 else order[-1]
    mark, out = np.zeros(len(kinds), np.int32), []
    for i in order:
        # Of two members of different components one at least is never in that of ``home``, and meets the other here.
        if label[i] == label[home]:
            if (label == label[home]).all():
                break
            continue
        own = at[starts[i] : starts[i] + n[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[at], starts)
        mark[own] = 0
        for j in np.flatnonzero((both >= similarity * (n + n[i] - both) - 1e-9) & (label != label[i])):
            if label[j] != label[i]:
                out.append((int(components[i]), int(components[j])))
                label[label == label[j]] = label[i]
    return out


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(t.as_py(), size)).tobytes() for t in b.column(1)], pa.binary())], names=["set", "hashes"])

    return run


def rest_links(groups: DataFrame, labels: DataFrame, hashes: DataFrame, similarity: float, path: str) -> DataFrame:
    """a, b: links between components of ``labels`` (set, component) that pairs within ``groups`` (band, v, set, n) make.

    ``hashes``: set, hashes of all members. Groups with the same members are compared once. A group of
    several blocks deals the members of its largest component and the others to blocks of their own;
    two blocks of the largest component needn't meet.
    """
    key = ["band", "v"]
    named = groups.where("n > 0").join(labels, "set", "left").select(*key, "set", "n", F.coalesce("component", "set").alias("component"))
    named = stored(named, f"{path}/grouped")
    parts = named.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("set")).alias("mix"), F.min("set").alias("lo"), F.max("set").alias("hi"))
    whole = parts.groupBy(*key).agg(
        F.count(F.lit(1)).alias("parts"), F.sum("k").alias("k"), F.sum("w").alias("w"), F.bit_xor("mix").alias("mix"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(F.struct("k", "w", "component")).alias("most")
    ).where("parts > 1")
    once = whole.groupBy("k", "w", "mix", "lo", "hi").agg(F.min(F.struct(*key, "most")).alias("g")).select("g.*", "k", "w")
    blocks = lambda k, w: F.greatest(F.ceil(k / BLOCK_MEMBERS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    single = blocks(F.col("k"), F.col("w")) <= 1
    once = once.select(*key, F.col("most.component").alias("most"), F.when(single, 0).otherwise(blocks(F.col("most.k"), F.col("most.w"))).alias("nb"), F.when(single, 1).otherwise(blocks(F.col("k") - F.col("most.k"), F.col("w") - F.col("most.w"))).alias("nr"))
    once = stored(once, f"{path}/open")
    salt = lambda n: F.pmod(F.xxhash64("set", F.lit(5)), F.greatest(n, F.lit(1))).cast("int")
    own = F.when((F.col("nb") > 0) & (F.col("component") == F.col("most")), salt(F.col("nb"))).otherwise(F.col("nb") + salt(F.col("nr")))
    dealt = named.join(once, key).withColumn("own", own)
    every = F.sequence(F.lit(0), F.col("nb") + F.col("nr") - 1)
    meets = F.filter(every, lambda j: (F.col("nb") == 0) | (j != F.col("own")) & ((j >= F.col("nb")) | (F.col("own") >= F.col("nb"))))
    dealt = dealt.select(*key, "set", "component", "own", F.explode(meets).alias("j")).select(*key, F.least("own", "j").alias("x"), F.greatest("own", "j").alias("y"), "set", "component")
    dealt = stored(dealt, f"{path}/dealt")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = spanning(pdf["component"].to_numpy(), [np.frombuffer(h, np.uint64) for h in pdf["hashes"]], similarity)
        give_back()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.join(hashes, "set").groupBy(*key, "x", "y").applyInPandas(one, "a long, b long").distinct()


def distinct_documents(docs: DataFrame, size: int = 5, similarity: float = 0.8, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns), one of each group of near duplicates: that with the smallest doc_id.

    Documents with equal shingle sets are one class; texts without words (null, empty, blank) are one
    class too. Of rows that tie on doc_id one stays; a null doc_id stays only if its group has no other.
    """
    path = path or scratch(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_rid"), row), f"{path}/rows")
    texts = rows.select("_rid", F.col("_row.doc_id").cast("long").alias("_id"), F.col("_row.text").cast("string").alias("_text"))
    kept = stored(texts.mapInArrow(tidy(_sketch(size)), "_rid long, _id long, set long, fp long, n long, bands array<long>, bytes binary"), f"{path}/sketches", TEXT_ROWS)
    order = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_rid")
    classes = stored(kept.groupBy("set").agg(F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes")), f"{path}/classes")
    pairs, crowds = candidates(classes.select("set", "fp", "n", "bands", "bytes"), path, similarity)
    n = classes.count()
    # At most a pair for each class and band, and fingerprint; far fewer where few are alike.
    pairs, crowds = stored(in_files(pairs, BANDS * n, 1 << 22), f"{path}/pairs"), stored(in_files(crowds, BANDS * n, 1 << 22), f"{path}/crowds")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).unionByName(crowds.select("set")).distinct()
    named = texts.select("_rid", "_text").join(wanted.join(classes.select("set", F.col("first._rid").alias("_rid")), "set"), "_rid").select("set", "_text")
    hashes = stored(named.mapInArrow(tidy(_sets(size)), "set long, hashes binary"), f"{path}/hashes", TEXT_ROWS)
    of = lambda c: hashes.select(F.col("set").alias(c), F.col("hashes").alias(f"hashes_{c}"))
    compared = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "hashes_a", "hashes_b")
    links = stored(compared.mapInArrow(tidy(_verified(similarity)), "a long, b long"), f"{path}/similar")
    groups = components(links, path)
    groups = stored(groups.withColumnRenamed("node", "set"), f"{path}/labels")
    rest = stored(rest_links(crowds, groups, hashes, similarity, f"{path}/rest"), f"{path}/restlinks")
    merged = components(rest, f"{path}/merged").select(F.col("node").alias("component"), F.col("component").alias("_up"))
    labelled = classes.join(groups, "set", "left").select(F.coalesce("component", "set").alias("component"), "first")
    labelled = labelled.join(merged, "component", "left").select(F.coalesce("_up", "component").alias("component"), "first")
    stay = labelled.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first._rid").alias("_rid"))
    return rows.join(stay, "_rid", "left_semi").select("_row.*")
