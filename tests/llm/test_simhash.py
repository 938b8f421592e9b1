"""Fingerprints and components against a brute-force version."""

import random

import numpy as np
import pytest
import xxhash

from lumenfold.llm import simhash
from lumenfold.llm.common import in_few_files, table


def plain_fingerprint(text, size=3):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    sh = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def plain_components(fps, radius=3):
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    fs = sorted(fps)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if bin(a ^ b).count("1") <= radius:
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {f: top(f) for f in fs}


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_equals_brute_force(spark, odd_docs, sf, which):
    docs = odd_docs if which == "odd" else table(spark, sf, "documents")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    comp = plain_components({f for _, f in rows})
    least = {}
    for i, f in rows:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert got == sorted((str(i), f"{f:016x}", least.get(comp[f])) for i, f in rows)


@pytest.mark.parametrize("direct", [2048, 8])
def test_links_span_the_components_of_all_pairs(spark, tmp_path, monkeypatch, direct):
    """Clusters, chains, and a dense group that needs the second cut; ``direct`` makes every group take it."""
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng, fps = random.Random(5), set()
    for n in (1, 1, 1, 5, 40):
        f = rng.getrandbits(64)
        for _ in range(n):
            fps.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    fps |= {hub ^ sum(1 << b for b in rng.sample(range(20), 2)) for _ in range(150)} | {hub ^ sum(1 << b for b in rng.sample(range(64), 4)) for _ in range(40)}
    fps |= {0, (1 << 64) - 1, 7}
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash.fingerprint_links(frame, f"file://{tmp_path}/a")
    edges = [(int(np.int64(r["a"]).astype(np.uint64)), int(np.int64(r["b"]).astype(np.uint64))) for r in links.collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    up = {f: f for f in fps}

    def top(f):
        while up[f] != f:
            f = up[f]
        return f

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    assert {f: top(f) for f in fps} == plain_components(fps)
    got = {int(np.int64(r["node"]).astype(np.uint64)): r["component"] for r in simhash.components(links, f"file://{tmp_path}/b").collect()}
    groups = plain_components(fps)
    assert all((got[a] == got[b]) == (groups[a] == groups[b]) for a in got for b in got)


def test_cube_links_equal_direct_ones():
    rng = np.random.default_rng(0)
    fps = np.unique(rng.integers(0, 1 << 14, 4000).astype(np.uint64)) | np.uint64(1 << 40)
    direct, cube = simhash.forest_links(fps, 1), simhash._cube_links(fps, 1)
    assert len(direct) == len(cube)


def test_long_chain_settles(spark, tmp_path):
    n = 120
    chain = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    got = simhash.components(chain, f"file://{tmp_path}/c").collect()
    assert len(got) == n and len({r["component"] for r in got}) == 1


def test_small_tables_lie_in_few_files(spark, odd_docs, tmp_path, monkeypatch):
    """However many tasks find the rows of a table; and a table of more rows gets more files."""
    keys = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    files = lambda at, name: len(list((tmp_path / at / name).glob("*.parquet")))
    words = [f"w{i}" for i in range(400)]
    near = [(100 + i, " ".join([*words[: 9 * i], "other", *words[9 * i + 1 :]])) for i in range(40)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string")).repartition(16)
    got = {}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        for at, each in (("one", 50_000), ("more", 14)):
            monkeypatch.setattr(simhash, "in_few_files", lambda df, n, each=each: in_few_files(df, n, each))
            got[at] = sorted(map(str, simhash.simhash_components(docs, path=f"file://{tmp_path}/{at}").collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [files("one", t) for t in ("prints", "groups", "members")] == [1, 1, 1]
    assert files("more", "prints") == 4 and files("more", "members") > 1
    assert len(got["one"]) == docs.count() and got["one"] == got["more"]


def test_no_rows(no_docs):
    assert simhash.simhash_components(no_docs).count() == 0
