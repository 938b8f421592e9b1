"""Statistics against a plain version, rules against their columns, scores against held-out labels."""

import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import rule_ensemble as re_
from lumenfold.llm.common import table


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.01"
    return re_.score_documents(table(spark, d, "documents"), table(spark, d, "labels")).collect()


def test_held_out_rows_and_accuracy(spark, scored):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, d, "labels").collect()}
    assert len(scored) == table(spark, d, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    unseen = [(r["predicted"], labels[r["doc_id"]]) for r in scored if r["held_out"] and r["doc_id"] in labels]
    assert len(unseen) > 60 and np.mean([a == b for a, b in unseen]) > 0.97


def test_statistics(spark):
    text = "Und Und und AB!! x*** y%%% | 12,\nline two\nline two"
    r = re_.with_statistics(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "z" * 300_000), (5, "a " * 50_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    words = re.findall(r"\S+", text)
    want = dict(n_words=12, mean_word=len(text) / 12, upper=4 / len(text), shouts=2 / 12, symbol_runs=2 / 12, bars=1 / 12, digits=2 / len(text), stops=1 / 12, repeated_words=1 / 12, repeated_lines=1 / 3, words_a_line=4.0, other_marks=6 / len(text))
    assert len(words) == 12 and all(abs(r[0][k] - v) < 1e-9 for k, v in want.items()), r[0]
    assert tuple(r[1])[1:] == tuple(r[2])[1:] and r[4]["repeated_words"] == pytest.approx(1, abs=1e-4)


def plain_statistics(text):
    text = text or ""
    words, lines, chars = re.findall(r"[^ \t\n\x0b\f\r]+", text), text.split("\n"), max(len(text), 1)
    n = max(len(words), 1)
    again, i = 0, 0
    while i + 1 < len(words):
        again += words[i] == words[i + 1]
        i += 1
    marks = sum(not (unicodedata.category(c)[0] in "LN" or c in " \t\n\x0b\f\r" or c in ".,;:?!|'\"()-") for c in text)
    return [
        len(words), len(text) / n, sum(unicodedata.category(c) == "Lu" for c in text) / chars, text.count("!") / n, len(re.findall(r"[*%&#$@^~=]{3}", text)) / n, text.count("|") / n, sum(c in "0123456789" for c in text) / chars,
        sum(c in ".,;:?" for c in text) / n, again / n, 1 - len(set(lines)) / len(lines), len(words) / len(lines), marks / chars,
    ]


def test_scores_equal_rules_on_plain_statistics(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(re_, "fit", lambda x, y, fit=re_.fit: fitted.append(fit(x, y)) or fitted[-1])
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    got = {r["doc_id"]: r["score"] for r in re_.score_documents(docs, table(spark, d, "labels")).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = fitted[0].score(np.array([plain_statistics(r["text"]) for r in rows]))
    assert fitted[0].rules
    # A statistic that lies on a cut may fall on either side by rounding; none does here.
    assert np.allclose([got[r["doc_id"]] for r in rows], want)


def test_columns_equal_the_model(spark):
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.4) & (x[:, 2] < 0.8)).astype(float)
    model = re_.fit(x, y)
    assert 0 < len(model.rules) < 60 and np.mean((model.score(x) > 0.5) == (y > 0.5)) > 0.98 and model.described(["a", "b", "c"])
    got = spark.createDataFrame([tuple(map(float, v)) for v in x[:40]], "a double, b double, c double").select(model.column(["a", "b", "c"]).alias("s")).collect()
    assert np.allclose([r["s"] for r in got], model.score(x[:40]))


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = re_.score_documents(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and {r["score"] for r in got} == {0.5}
    assert re_.score_documents(no_docs, none).count() == 0
    one = spark.createDataFrame([(1, None), (1, 1), (1, 0), (None, 1), (99, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in re_.score_documents(odd_docs, one).collect())


def test_accepted_keeps_columns_and_clean_rows(spark, scored):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents").withColumn("n_words", F.lit("clash"))
    kept = re_.accepted(docs, table(spark, d, "labels"))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] for r in scored if r["predicted"])
