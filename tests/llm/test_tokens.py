"""Token store and curve packing against the library's whole encoder."""

import glob
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenfold.llm import curve_pack, token_store
from lumenfold.llm.common import table
from lumenfold.llm.tokens import encoder, tokenizer_path


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def docs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_store_equals_library(spark, odd_docs, sf, lib, which, tmp_path):
    docs = odd_docs if which == "odd" else table(spark, sf, "documents")
    token_store.write_store(docs, f"file://{tmp_path}/s")
    got = sorted(tuple(r) for r in token_store.read_store(spark, f"file://{tmp_path}/s").collect()) if which == "sf" else [tuple(r) for r in token_store.read_store(spark, f"file://{tmp_path}/s").collect()]
    want = Counter((i, len(ids := lib.encode(t or "", add_special_tokens=False).ids + [1]), crc(ids)) for i, t in docs_of(docs))
    assert Counter((i, n, c) for i, _, n, c in got) == want
    spans = sorted((s, n, i) for i, s, n, _ in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[0][0] == 0
    ids = [i for _, _, i in spans if i is not None]
    assert ids == sorted(ids)
    whole = {(r["doc_id"], r["start"]): crc(list(r["ids"])) for r in token_store.read_ids(spark, f"file://{tmp_path}/s").collect()}
    assert whole == {(i, s): c for i, s, _, c in got}


@pytest.mark.parametrize("lost", ["recipes", "chunks", "manifest"])
def test_a_lost_part_is_seen(spark, tmp_path, lost):
    """A whole file of any of the three tables is gone; the rows of what is left agree with each other."""
    docs = spark.createDataFrame([(i, f"text {i} " * (3 + i)) for i in range(40)], "doc_id long, text string").repartition(5)
    path = f"file://{tmp_path}/s"
    token_store.write_store(docs, path)
    assert token_store.read_store(spark, path).count() == 40
    files = sorted(glob.glob(f"{tmp_path}/s/{lost}/*.parquet"), key=os.path.getsize)
    os.remove(files[-1])
    with pytest.raises(Exception, match="manifest|missing|Unable to infer|UNABLE_TO_INFER"):
        token_store.read_store(spark, path).collect()


def test_manifest_is_a_merkle_tree_in_order(spark, tmp_path):
    token_store.write_store(spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string").repartition(3), f"file://{tmp_path}/s")
    recipes = spark.read.parquet(f"file://{tmp_path}/s/recipes").orderBy("start").collect()
    rows = {r["part"]: r for r in spark.read.parquet(f"file://{tmp_path}/s/manifest").collect()}
    roots = []
    for part in sorted({r["part"] for r in recipes}):
        own = [bytes(r["root"]) for r in recipes if r["part"] == part]
        roots.append(token_store.merkle_root(own))
        assert bytes(rows[part]["root"]) == roots[-1] and rows[part]["n_docs"] == len(own)
        assert len(own) < 2 or token_store.merkle_root(own[::-1]) != roots[-1]
    assert bytes(rows[-1]["root"]) == token_store.merkle_root(roots) and rows[-1]["n_docs"] == 30 and len(rows) == 1 + len(roots)


def test_store_keeps_a_chunk_once_and_sees_damage(spark, tmp_path):
    text = " ".join(f"w{i % 977} x{i}" for i in range(4000))
    path = f"file://{tmp_path}/s"
    token_store.write_store(spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string").repartition(5), path)
    chunks, recipes = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/recipes")
    n = len(recipes.first()["digests"]) // token_store.DIGEST
    assert n > 3 and chunks.count() == chunks.select("digest").distinct().count() <= n
    chunks.limit(1).collect()
    bad = chunks.toPandas()
    bad.loc[0, "payload"] = bad.loc[1, "payload"]
    spark.createDataFrame(bad).selectExpr("digest", "int(n_ids) n_ids", "payload").write.mode("overwrite").parquet(f"{path}/chunks2")
    import shutil

    shutil.rmtree(f"{tmp_path}/s/chunks")
    shutil.move(f"{tmp_path}/s/chunks2", f"{tmp_path}/s/chunks")
    with pytest.raises(Exception, match="damaged"):
        token_store.read_store(spark, path).collect()


def test_cut_depends_on_nearby_ids_only():
    cut, rng = token_store.Cutter(), np.random.default_rng(1)
    a, b = rng.integers(0, 49000, 20_000).astype("<u2"), rng.integers(0, 49000, 3001).astype("<u2")
    ends = cut.cuts(len(a), cut.marks(a).tolist())
    moved = cut.cuts(len(a) + len(b), cut.marks(np.concatenate([b, a])).tolist())
    assert len({e + len(b) for e in ends} & set(moved)) > 0.7 * len(ends)
    assert max(np.diff([0, *ends])) <= cut.most and min(np.diff([0, *ends][:-1])) >= cut.least


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_pieces_rebuild_every_document(spark, odd_docs, sf, lib, which):
    docs = odd_docs if which == "odd" else table(spark, sf, "documents")
    got, at = curve_pack.pack_documents(docs).collect(), defaultdict(list)
    for r in got:
        at[r["row_id"]].append(r)
    want = Counter()
    for i, t in docs_of(docs):
        want[(i, tuple(lib.encode(t or "", add_special_tokens=False).ids + [2]))] += 1
    by_id = defaultdict(list)
    for (i, ids), n in want.items():
        by_id[i] += [ids] * n
    for pieces in at.values():
        pieces.sort(key=lambda r: r["start"])
        fits = [ids for ids in by_id[pieces[0]["doc_id"]] if len(ids) == pieces[0]["doc_tokens"] and all(crc(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in pieces)]
        assert fits and sum(r["length"] for r in pieces) == len(fits[0])
        assert all(a["start"] + a["length"] == b["start"] for a, b in zip(pieces, pieces[1:])) and pieces[0]["start"] == 0
        by_id[pieces[0]["doc_id"]].remove(fits[0])
    assert not any(by_id.values())
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    sizes = []
    for parts in seq.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end and n > 0
            end += n
        sizes.append(end)
    assert max(sizes) <= 4096 and sum(s < 4096 for s in sizes) <= 1


def test_hilbert_key_visits_every_cell_by_single_steps():
    side, dims = 8, 3
    cells = np.array(np.meshgrid(*[range(side)] * dims)).reshape(dims, -1).T
    key = curve_pack.hilbert_key(cells, 3)
    assert sorted(key) == list(range(side**dims))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_no_rows(spark, no_docs, tmp_path):
    token_store.write_store(no_docs, f"file://{tmp_path}/s")
    assert token_store.read_store(spark, f"file://{tmp_path}/s").count() == 0
    assert curve_pack.pack_documents(no_docs).count() == 0


def test_cache_starts_anew_when_full():
    from lumenfold.llm.tokens import WordEncoder

    small = WordEncoder(most=3)
    text = "one two three four five one, two; ÉTÉ été"
    assert small.text(text) == encoder().text(text) and len(small.known) <= 3
