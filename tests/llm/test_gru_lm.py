"""Base scores against plain counts; the network against finite differences, its own law, and held-out text."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenfold.llm import gru_lm as lm
from lumenfold.llm.common import table


def plain_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def plain_base(docs):
    held = [zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in docs]
    counts = Counter()
    for (_, t), h in zip(docs, held):
        if not h:
            counts.update([*plain_words(t), 0])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, t), h in zip(docs, held):
        toks = [*plain_words(t), 0]
        out.append((str(i), h, len(toks), sum(counts[w] > 0 for w in toks), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks)))
    return sorted(out)


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_base_equals_plain_counts(spark, odd_docs, sf, which, monkeypatch):
    if which == "sf":
        monkeypatch.setattr(lm, "FREQUENT", 5000)
    docs = odd_docs if which == "odd" else table(spark, sf, "documents")
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score_documents(docs).collect())
    want = plain_base([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(g[6] < 0 for g in got)


def test_network_beats_the_base_on_held_out_text(spark):
    got = lm.score_documents(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def stats_of(texts):
    c = Counter(w for t in texts for w in plain_words(t))
    n = dict((w.encode(), k) for w, k in c.most_common())
    return lm.Statistics(sum(c.values()) + len(texts), len(c) + 1, len(texts), n, [0] * 4, [0] * 4)


def plain_tail(w):
    b = w.encode()[-1]
    return 0 if chr(b) in "abcdefghijklmnopqrstuvwxyz" or b > 127 else {46: 1, 44: 2}.get(b, 3)


def plain_symbols(words, index):
    return [index.get(w.encode(), lm.VOCABULARY + plain_tail(w)) for w in words] + [lm.END]


def plain_law(net, h):
    """Natural log probabilities of all symbols after the state ``h``, in doubles."""
    def soft(x):
        e = np.exp(x - x.max())
        return np.log(e / e.sum())

    h = h.astype(float)
    kinds = soft(net.wc.astype(float) @ h + net.bc)
    return np.concatenate([*(kinds[c] + soft(net.wv[c].astype(float) @ h + net.bv[c]) for c in range(lm.CLASSES)), kinds[lm.CLASSES :]])


def plain_step(net, h, x):
    k, sig = net.hidden, lambda v: 1 / (1 + np.exp(-v))
    a, b = net.w.astype(float) @ net.inputs[x], net.u.astype(float) @ h
    z, r = sig(a[:k] + b[:k]), sig(a[k : 2 * k] + b[k : 2 * k])
    return (1 - z) * np.tanh(a[2 * k :] + r * b[2 * k :]) + z * h


def plain_log_likelihood(net, symbols):
    h, before, out = np.zeros(net.hidden), lm.END, 0.0
    for s in symbols:
        h = plain_step(net, h, before)
        out += plain_law(net, h)[s]
        before = s
    return out


def noisy(net, seed=0):
    rng = np.random.default_rng(seed)
    net.wc[:] = rng.normal(0, 0.3, net.wc.shape)
    net.wv[:] = rng.normal(0, 0.3, net.wv.shape)
    return net


def test_order_matters_to_the_network():
    texts = ["the cat sat on the mat and the dog lay by the door ."] * 40 + ["a bird sang in a tree while a fox slept ."] * 40
    s = stats_of(texts)
    net, index = lm.Network.of(s), lm.vocabulary(s)
    stream = lambda t: np.array(plain_symbols(t.split(), index), np.uint16)
    for _ in range(60):
        lm.learn(net, map(stream, texts), 0.05, 4)
    right, wrong = net.score([stream(texts[0]), stream(" ".join(reversed(texts[0].split())))])
    assert right > wrong + 5


def test_probabilities_sum_to_one_and_windows_carry_the_state(monkeypatch):
    monkeypatch.setattr(lm, "LANES", 2)
    net = noisy(lm.Network.fresh(np.arange(lm.VOCABULARY)[::-1].astype(float), np.array([5.0, 4, 3, 2])))
    every = np.arange(lm.VOCABULARY + lm.TAILS)
    rng = np.random.default_rng(0)
    h = np.repeat(rng.normal(0, 1, (net.hidden, 1)).astype(np.float32), len(every), 1)
    assert abs(np.exp(net.log_likelihood(h, every)).sum() - 1) < 1e-4
    assert np.allclose(net.log_likelihood(h, every), plain_law(net, h[:, 0]), atol=1e-4)
    texts = [np.append(rng.integers(1, lm.VOCABULARY + lm.TAILS, n), lm.END).astype(np.uint16) for n in (5 * lm.WINDOW + 7, 0, 90, 1, lm.WINDOW - 1, lm.WINDOW, 90)]
    assert np.allclose(net.score(texts), [plain_log_likelihood(net, x) for x in texts], rtol=1e-4)


def test_large_logits_do_not_overflow():
    net = noisy(lm.Network.fresh(np.ones(lm.VOCABULARY), np.ones(4)))
    net.wc *= 100
    net.wv *= 100
    h = np.random.default_rng(2).normal(0, 1, (net.hidden, 50)).astype(np.float32)
    t = np.arange(50) * 80
    assert np.allclose(net.log_likelihood(h, t), [plain_law(net, h[:, i])[t[i]] for i in range(50)], rtol=1e-3, atol=1e-2)


def test_biases_of_any_size():
    """A bias that all kinds of a class share changes nothing, however large it is; gradients neither."""
    net, rng = noisy(lm.Network.fresh(np.arange(lm.VOCABULARY)[::-1].astype(float), np.ones(4))), np.random.default_rng(3)
    h, t = rng.normal(0, 1, (net.hidden, 3000)).astype(np.float32), rng.integers(0, lm.VOCABULARY + lm.TAILS, 3000)
    small, large = {}, {}
    want = net.log_likelihood(h, t, small)
    net.bc += 100
    net.bv[:20] -= 90
    assert np.allclose(net.log_likelihood(h, t, large), want, atol=1e-3)
    assert all(np.allclose(small[k], large[k], atol=1e-6) for k in ("wc", "bc", "wv", "bv", "h"))
    net.bv[5, 7] -= 500
    law = plain_law(net, h[:, 0])
    assert np.allclose(net.log_likelihood(np.repeat(h[:, :1], len(law), 1), np.arange(len(law))), law, rtol=1e-4, atol=1e-3)


def test_symbols_stay_short(monkeypatch):
    """Windows are sorted by symbol, which for short integers takes a sixth of the time."""
    net, kinds = lm.Network.fresh(np.ones(lm.VOCABULARY), np.ones(4)), set()
    monkeypatch.setattr(net, "train_window", lambda h, symbols, targets, first, rate: (kinds.update((symbols.dtype, targets.dtype)), (h, 0.0))[1])
    lm.learn(net, iter([np.array([1, 2, lm.END], np.uint16)] * 50), 0.1, 2)
    assert kinds == {np.dtype(np.uint16)}


def test_rare_words_meet_their_counts_unsorted(spark, odd_docs, tmp_path, monkeypatch):
    """By hash, where Spark would sort every rare word and the whole table of counts."""
    monkeypatch.setattr(lm, "FREQUENT", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = lm.scored(*lm.trained(odd_docs.select("doc_id", "text"), str(tmp_path)), str(tmp_path))
        plan = scores._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"ShuffledHashJoin \[word", plan) and not re.search(r"SortMergeJoin \[word", plan)


def test_gradients(monkeypatch):
    net = lm.Network.fresh(np.ones(lm.VOCABULARY), np.ones(4), hidden=5)
    for k in lm._WEIGHTS:
        setattr(net, k, np.random.default_rng(4).normal(0, 0.4, getattr(net, k).shape))
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 200, (6, 3)), rng.integers(0, 200, (6, 3))
    y[2, 1] = lm.VOCABULARY + 2
    first = np.zeros((6, 3), bool)
    first[3, 0] = True
    seen = {}
    monkeypatch.setattr(net, "_adam", lambda g, r: seen.update(g))
    h = rng.normal(0, 1, (5, 3))
    net.train_window(h, x, y, first, 0.0)

    def loss():
        total = 0.0
        for lane in range(3):
            s = h[:, lane]
            for t in range(6):
                s = plain_step(net, np.zeros(5) if first[t, lane] else s, x[t, lane])
                total -= plain_law(net, s)[y[t, lane]]
        return total / 18

    kind = int(y[0, 0]) // lm.CLASS
    for k, at in (("u", (2, 3)), ("u", (11, 1)), ("w", (7, 2)), ("w", (13, 0)), ("wc", (kind, 1)), ("bc", (lm.CLASSES + 2,)), ("inputs", (int(x[1, 1]), 3)), ("inputs", (int(x[0, 2]), 2)), ("wv", (kind, 3, 2)), ("bv", (kind, int(y[0, 0]) % lm.CLASS))):
        p = getattr(net, k)
        p[at] += 1e-5
        up = loss()
        p[at] -= 2e-5
        down = loss()
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - seen[k][at]) < 1e-6, (k, at)


def test_all_training_rows_are_learned_and_whole_documents_scored(spark, odd_docs, tmp_path):
    """Every symbol once, those of very long documents too; scores by the definition, over nulls, ties and long texts."""
    rows = odd_docs.select("doc_id", "text")
    counts, stats, encoded, net = lm.trained(rows, str(tmp_path))
    assert not np.array_equal(lm.Network.of(stats).wv, net.wv)
    again = lm.Network.of(stats)
    assert lm.learn_rows(encoded, again, str(tmp_path / "b")) == stats.tokens
    assert encoded.count() == rows.count()
    index = lm.vocabulary(stats)
    every = {bytes(r["word"]): r["c"] for r in counts.collect()}
    outside = [w for w in every if w not in index]
    mass = [[every[w] for w in outside if plain_tail(w.decode()) == t] for t in range(4)]
    assert (stats.tail_tokens, stats.tail_kinds) == ([sum(m) for m in mass], [len(m) for m in mass])
    want = []
    for r in rows.collect():
        words = plain_words(r["text"])
        x = np.array(plain_symbols(words, index))
        # Step by step over short texts; by one lane of its own over the long ones.
        p = plain_log_likelihood(net, x) if len(x) < 500 else net.score([x.astype(np.uint16)])[0]
        rest = sum(math.log10((every.get(w.encode(), 0) + 1) / (sum(m := mass[plain_tail(w)]) + len(m) + 1)) for w in words if w.encode() not in index)
        want.append((str(r["doc_id"]), len(x), p / math.log(10) + rest))
    got = [(str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.scored(counts, stats, encoded, net, str(tmp_path)).collect()]
    assert [g[:2] for g in sorted(got)] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2] for g in sorted(got)], [w[2] for w in sorted(want)], rtol=1e-3)


@pytest.mark.parametrize("lanes", [1, 3, 50])
def test_each_symbol_is_learned_after_the_one_before(monkeypatch, lanes):
    monkeypatch.setattr(lm, "BLOCK", 300)
    texts = [[1 + (7 * i + k) % 90 for k in range(n)] + [lm.END] for i, n in enumerate([0, 1, 31, 32, 33, 69, 70, 71, 140, 400])]
    pairs, net = Counter(), lm.Network.fresh(np.ones(lm.VOCABULARY), np.ones(4))

    def window(h, symbols, targets, first, rate):
        pairs.update(zip(symbols.ravel().tolist(), targets.ravel().tolist()))
        assert (first == (symbols == lm.END)).all()
        return h, 0.0

    monkeypatch.setattr(net, "train_window", window)
    assert lm.learn(net, (np.array(t, np.uint16) for t in texts), 0.1, lanes) == sum(map(len, texts))
    want = Counter()
    for t in texts:
        want.update(zip([lm.END, *t], t))
    missing = sum((want - pairs).values())  # where the last block is filled up, its first symbol may follow another
    assert missing <= 2 and sum(pairs.values()) < sum(want.values()) + lanes


def test_words_by_arrow():
    texts = ["Ab  c\tdé\n" * 50 + "z" * 400 + " end", None, "", " \x0b\x0c ", "x\x1cy\x85z  Ü\u00a0Q ", "A"]
    words, n = lm.split_words(pa.array(texts))
    assert n.tolist() == [len(plain_words(t)) for t in texts]
    assert words.to_pylist() == [w.encode() for t in texts for w in plain_words(t)]
    assert lm.tails_of(words).tolist() == [plain_tail(w) for t in texts for w in plain_words(t)]
    assert lm.tails_of(words.slice(3, 0)).tolist() == [] and lm.tails_of(words.slice(2)).tolist() == lm.tails_of(words).tolist()[2:]


def test_no_rows(no_docs):
    assert lm.score_documents(no_docs).count() == 0
