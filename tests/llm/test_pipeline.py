"""Near-duplicate removal against all pairs, and the pipeline stage by stage against plain versions."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from lumenfold.llm import edit_match, near_dup, rule_ensemble
from lumenfold.llm.common import table


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def plain_groups(docs, limit=0.8):
    """Groups of all pairs at ``limit`` or more, by union of lists."""
    sets = [shingles(t) for _, t in docs]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {b"\0none"}:
            where[x].append(i)
    up = list(range(len(docs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    shared = defaultdict(int)
    for own in where.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                shared[(j, i)] += 1
    for (j, i), n in shared.items():
        a, b = sets[i] or {b"\0none"}, sets[j] or {b"\0none"}
        if n >= limit * (len(a) + len(b) - n):
            up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(docs))]


def plain_kept(docs):
    best = {}
    for g, (i, _) in zip(plain_groups(docs), docs):
        best[g] = min(best.get(g, (i is None, i or 0)), (i is None, i or 0))
    return sorted(str(None if none else i) for none, i in best.values())


def near_copies():
    rng, out = random.Random(3), []
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    for g in range(12):
        base = [word() for _ in range(rng.choice([8, 40, 120, 400]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 25])):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                t[rng.randrange(len(t))] = word()
            out.append((" " if rng.random() < 0.5 else "\n").join(t))
        out.append(" ".join(base[: len(base) // 2] + [word() for _ in range(len(base) // 2)]))
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("which", ["odd", "made", "sf"])
def test_near_duplicates_equal_all_pairs(spark, odd_docs, which):
    if which == "made":
        docs = spark.createDataFrame([(i, t, "x", 1) for i, t in near_copies()], "doc_id long, text string, `set` string, fp int").repartition(3)
    else:
        docs = odd_docs if which == "odd" else table(spark, "/root/testdata/sf0.01", "documents")
    got = near_dup.distinct_documents(docs)
    assert got.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(str(r["doc_id"]) for r in got.select("doc_id").collect()) == plain_kept(rows)


def star(copies, words=200):
    """An original and copies edited independently: each at 0.8 or more to it, below 0.8 to one another; with some strays that only share its beginning."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=8))
    base = [word() for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        t = list(base)
        for k in rng.sample(range(5, words - 5), 3):
            t[k] = word()
        out.append(" ".join(t))
    out += [" ".join(base[: words * 4 // 5] + [word() for _ in range(words // 5)]) for _ in range(copies // 20)]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("members", [1000, 60])
def test_a_star_equals_all_pairs(spark, monkeypatch, members):
    monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", members)
    rows = star(300 if members < 1000 else 1000)
    got = near_dup.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                up[max(top(i), top(j))] = min(top(i), top(j))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({top(i) for i in range(len(rows))})


def test_no_rows(spark, no_docs):
    assert near_dup.distinct_documents(no_docs).count() == 0


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        after = stage(spark, docs, sf)
        if name == "packing":
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == {i for i, _ in before}
            break
        assert after.columns == columns
        kept = sorted(str(r["doc_id"]) for r in after.select("doc_id").collect())
        if name == "quality":
            want = [str(r["doc_id"]) for r in rule_ensemble.score_documents(docs, table(spark, sf, "labels")).where("predicted = 1").collect()]
        elif name == "near_duplicates":
            want = plain_kept(before)
        else:
            items = [edit_match.normal(r["text"]) for r in table(spark, sf, "benchmark").collect()]
            m = [edit_match.Myers(x) for x in items]
            want = [str(i) for i, t in before if not any(k.best(edit_match.normal(t), edit_match.budget(k.n)) for k in m)]
        assert kept == sorted(want) and len(kept) < len(before)
        docs = spark.createDataFrame(after.collect(), docs.schema)


def test_run_ends_with_pieces(spark, sf):
    assert corpus_pipeline.run(spark, sf).where("length > 0").count() > 0
