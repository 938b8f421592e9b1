"""Matches against a plain dynamic programme over every item and document."""

import random
import re

import pytest

from lumenfold.llm import edit_match as em
from lumenfold.llm.common import table


def plain_best(item, text):
    """Least edit distance of item to any substring of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(item):
            new.append(min(row[i] + (c != d), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_equals_plain():
    rng = random.Random(2)
    for _ in range(150):
        item = "".join(rng.choices("abc ", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc ", k=rng.randint(0, 150)))
        if rng.random() < 0.6:
            at = rng.randint(0, len(text))
            text = text[:at] + item[: rng.randint(0, len(item))] + text[at:]
        want = plain_best(item, text)
        got = em.Myers(item).best(text, len(item))
        assert (got[0] if got else len(item)) == want


def edited(text, n, rng):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        rng.choice([lambda i=i: t.__setitem__(i, "z"), lambda i=i: t.pop(i), lambda i=i: t.insert(i, "q")])()
    return "".join(t)


@pytest.fixture(scope="module")
def planted(spark, sf):
    rng = random.Random(7)
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").limit(12).collect()]
    noise = [r["text"][:400] for r in table(spark, sf, "documents").limit(30).collect()]
    docs = [(i, t) for i, t in enumerate(noise)]
    for k, (_, t) in enumerate(items):
        docs.append((100 + k, noise[k] + " " + t.upper().replace(" ", "\n ") + noise[k + 1]))
        docs.append((200 + k, noise[k] + edited(t, len(t) // 14, rng) + noise[k + 1]))
        docs.append((300 + k, edited(t, len(t) // 5, rng)))
    docs += [(400, None), (401, ""), (402, " "), (403, (items[0][1] + " ") * 300), (404, items[0][1] * 2), (404, items[0][1] * 2), (None, items[1][1]), (405, "the " * 20_000)]
    odd = [(900, None), (901, ""), (902, "too short"), (items[0][0] + 1000, items[0][1]), (903, "the " * 20)]
    return docs, items + odd


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_equals_plain_over_all_pairs(spark, planted, block):
    docs, items = planted
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    got = em.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
    want = []
    for i, t in docs:
        n = em.normal(t)
        for j, x in items:
            x = em.normal(x)
            if not x:
                continue
            if len(x) < em.SHORTEST:
                if len(n) < 3000 and re.search(rf"(?<!\w){re.escape(x)}(?!\w)", n):
                    want.append((str(i), j, 0))
            elif len(n) < 3000 and (d := plain_best(x, n)) <= em.budget(len(x)):
                want.append((str(i), j, d))
    assert sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in got if r["doc_id"] not in (403, 405)) == sorted(want)
    assert {(r["item_id"], r["distance"]) for r in got if r["doc_id"] == 403} >= {(items[0][0], 0), (items[0][0] + 1000, 0)}
    assert {r["item_id"] for r in got if r["doc_id"] == 405} == {903}
    found = {str(r["doc_id"]) for r in got}
    assert {str(100 + k) for k in range(12)} | {str(200 + k) for k in range(12)} <= found
    left = em.decontaminated(frame, spark.createDataFrame(items, "item_id long, text string"), block=block)
    assert left.columns == frame.columns and sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _ in docs if str(i) not in found)


def test_short_items_are_matched_whole(spark):
    items = spark.createDataFrame([(1, "Tea Pot"), (2, "x"), (3, "  "), (4, "#tag!")], "item_id long, text string")
    texts = ["a tea\npot.", "steapot tea pots", "teapot", "(X)", "xx", "y#tag!y", "tag", "Tea pot tea pots"]
    got = em.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == {(0, 1, 0), (3, 2, 0), (5, 4, 0), (7, 1, 0)}


def test_a_worker_makes_a_matcher_once(spark):
    from pyspark import cloudpickle

    one = cloudpickle.loads(cloudpickle.dumps(em._matcher))
    items = [(1, "some text of an item that is long enough")]
    assert one("k", items, em.RATE, em.PIECE, em.SHORTEST) is em._matcher("k", items, em.RATE, em.PIECE, em.SHORTEST)


def test_the_rate_is_never_lowered():
    assert all(em.budget(n) == int(n * em.RATE) for n in range(em.SHORTEST, 5000))


def test_no_rows(spark, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a passage that is long enough to be evidence of a leak")], "item_id long, text string")
    assert em.contaminated(no_docs, some).count() == 0 and em.contaminated(no_docs, none).count() == 0
    assert em.decontaminated(no_docs, some).count() == 0 and em.decontaminated(no_docs, none).columns == no_docs.columns


def test_pieces_cover_the_item():
    for n in (30, 31, 200, 999):
        item = "".join(chr(97 + i % 26) for i in range(n))
        k = em.budget(n)
        p = em.pieces(item, k)
        assert "".join(x for _, x in p) == item and len(p) == k + 1 and min(len(x) for _, x in p) >= min(em.PIECE, n)
