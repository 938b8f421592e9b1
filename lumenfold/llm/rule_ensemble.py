"""Quality by a sparse rule ensemble.

Shallow boosted trees over statistics of the text propose rules: each path from a root is a
conjunction of comparisons. A lasso logistic fit keeps few of them with a weight each, and those
become one Spark column over the statistics. The statistics cover the whole text; they are the only
inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled, scratch, stored
from .trees import Boosted, Node, boost

#: Labelled rows that the rules are fitted on, about, chosen by a hash of doc_id.
SAMPLE = 20_000
THRESHOLD = 0.7
STATISTICS = ["n_words", "mean_word", "upper", "shouts", "symbol_runs", "bars", "digits", "stops", "repeated_words", "repeated_lines", "words_a_line", "other_marks"]


def with_statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, STATISTICS and the columns ``more`` of each row of ``docs`` (doc_id, text): shares of words, characters or lines. Null texts count as empty."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *more).alias("_more"))
    text = F.col("text")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    counted = base.select(
        "doc_id", "_more", F.length(text).cast("double").alias("chars"), count(r"\S+").alias("words"), count(r"\p{Lu}").alias("_upper"), count("!").alias("_shouts"), count(r"[*%&#$@^~=]{3}").alias("_runs"),
        count(r"\|").alias("_bars"), count("[0-9]").alias("_digits"), count("[.,;:?]").alias("_stops"), count(r"[^\p{L}\p{N}\s.,;:?!|'\"()\-]").alias("_other"),
        # A word like the one before it. Nothing is given back once matched, so an endless word is read once.
        count(r"(?<!\S)(\S++)(?=\s++\1(?!\S))").alias("_again"),
        F.size(F.split(text, "\n")).cast("double").alias("lines"), F.size(F.array_distinct(F.split(text, "\n"))).cast("double").alias("_kinds"),
    )
    chars, words = F.greatest("chars", F.lit(1.0)), F.greatest("words", F.lit(1.0))
    return counted.select(
        "doc_id", "_more.*", F.col("words").alias("n_words"), (F.col("chars") / words).alias("mean_word"), (F.col("_upper") / chars).alias("upper"), (F.col("_shouts") / words).alias("shouts"), (F.col("_runs") / words).alias("symbol_runs"),
        (F.col("_bars") / words).alias("bars"), (F.col("_digits") / chars).alias("digits"), (F.col("_stops") / words).alias("stops"), (F.col("_again") / words).alias("repeated_words"),
        (1 - F.col("_kinds") / F.col("lines")).alias("repeated_lines"), (F.col("words") / F.col("lines")).alias("words_a_line"), (F.col("_other") / chars).alias("other_marks"),
    ).drop("_")


@dataclass(frozen=True)
class Rule:
    """All of these hold: (feature, at, whether it is <= at)."""

    tests: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for j, at, below in self.tests:
            out &= (x[:, j] <= at) == below
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for j, at, below in self.tests:
            out = out & ((F.col(names[j]) <= at) if below else (F.col(names[j]) > at))
        return out


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[float, Rule]]

    def score(self, x: np.ndarray) -> np.ndarray:
        m = np.full(len(x), self.bias)
        for w, r in self.rules:
            m += w * r.holds(x)
        return 1 / (1 + np.exp(-m))

    def column(self, names: list[str]) -> Column:
        m = F.lit(self.bias)
        for w, r in self.rules:
            m = m + F.when(r.column(names), w).otherwise(0.0)
        return 1 / (1 + F.exp(-m))

    def described(self, names: list[str]) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{names[j]} {'<=' if b else '>'} {at:.4g}" for j, at, b in r.tests) for w, r in self.rules]


def paths(model: Boosted) -> list[Rule]:
    """Every path from a root to a node below it, once."""
    found: dict[Rule, None] = {}

    def walk(t: Node, tests: tuple) -> None:
        if tests:
            found[Rule(tests)] = None
        if t.feature >= 0:
            walk(t.left, (*tests, (t.feature, t.at, True)))
            walk(t.right, (*tests, (t.feature, t.at, False)))

    for t in model.trees:
        walk(t, ())
    return list(found)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise the mean log loss plus ``penalty`` times the sum of weights' sizes (accelerated proximal gradient)."""
    n, k = x.shape
    p = (y.sum() + 0.5) / (n + 1)
    bias, w = float(np.log(p / (1 - p))), np.zeros(k)
    step = 4 / (np.linalg.norm(x, 2) ** 2 / n + 1)
    zb, zw, t = bias, w.copy(), 1.0
    for _ in range(rounds):
        d = 1 / (1 + np.exp(-(x @ zw + zb))) - y
        nb = zb - step * d.mean()
        nw = zw - step * (x.T @ d) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zb, zw = nb + (t - 1) / nt * (nb - bias), nw + (t - 1) / nt * (nw - w)
        bias, w, t = nb, nw, nt
    return float(bias), w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 3e-3) -> Ensemble:
    """Rules for labels ``y``: the lasso chooses them, and a second fit with a slight penalty frees the chosen from its shrinkage.

    Without both labels there are no rules, and all score the smoothed share of label 1.
    """
    model = boost(x, y, rounds=15, depth=3, rate=0.4, least=3)
    rules = paths(model)
    if not rules:
        return Ensemble(model.bias, [])
    held = np.column_stack([r.holds(x) for r in rules]).astype(float)
    _, once = np.unique(held, axis=1, return_index=True)
    rules, held = [rules[i] for i in sorted(once)], held[:, sorted(once)]
    chosen = np.flatnonzero(lasso_logistic(held, y, penalty)[1])
    bias, w = lasso_logistic(held[:, chosen], y, penalty / 30) if len(chosen) else (model.bias, [])
    return Ensemble(bias, [(float(a), rules[i]) for a, i in zip(w, chosen, strict=True) if a])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the CRC-32 of doc_id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality of about ``sample`` labelled ids at most that are not held out. Of several labels of one id the largest holds."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("quality"))
    return sampled(known, ["doc_id"], sample)


def train(rows: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Fit on ``rows`` (doc_id, quality, STATISTICS), about ``sample`` of them at most."""
    rows = sampled(rows, ["doc_id", *STATISTICS], sample).select("quality", *STATISTICS).collect()
    data = np.array([tuple(r) for r in rows], float).reshape(-1, 1 + len(STATISTICS))
    data = data[np.lexsort(data.T)]  # the same rules whatever the order of the rows
    return fit(data[:, 1:], (data[:, 0] > 0.5).astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts are scored by their statistics, which are zeros; very long ones by those of
    the whole text. Rows with equal texts have equal scores, repeated rows are all scored. Without
    labels every score is 0.5. No rows give no scores.
    """
    path = path or scratch(docs.sparkSession)
    statistics = stored(with_statistics(docs), f"{path}/statistics")
    score = train(statistics.join(training_labels(labels, sample), "doc_id"), sample).column(STATISTICS)
    return statistics.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score_documents`` over all of ``docs``, with the module's parameters."""
    return score_documents(docs, labels)


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns.

    Rows are stored with their statistics first: a filter over them in one plan would make Spark work
    out each statistic again for every rule that names it. No row is matched by its id.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = stored(with_statistics(docs, row), f"{path or scratch(docs.sparkSession)}/rows")
    model = train(rows.select("doc_id", *STATISTICS).join(training_labels(labels, sample), "doc_id"), sample)
    return rows.where(model.column(STATISTICS) >= threshold).select("_row.*")
