"""The inverted index of a corpus: TF-IDF weights, stems, Arabic forms, vectors, as DataFrames.

``passages`` everywhere: row_idx (order, unique), ref, text, and optionally arabic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions.text import STOP_WORDS, stem, tokens, vector_terms


def spread(passages: DataFrame) -> DataFrame:
    """``passages`` over all cores, where a scan of few large row groups would leave most of them idle; else as they are.

    Texts are cut into many times their number of rows, so moving the texts first is the cheap order.
    """
    cores = passages.sparkSession.sparkContext.defaultParallelism
    return passages.repartition(cores) if passages.rdd.getNumPartitions() < cores else passages


def vocabulary(passages: DataFrame) -> DataFrame:
    """(word, freq) over all tokens."""
    return spread(passages.select("text")).select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def _once(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of ``value``, which is worked out once however often the step names it."""
    return F.transform(F.array(value), step)[0]


def _runs(terms: Column) -> Column:
    """array<struct<term, tf>> of the distinct ``terms``: places in the sorted array where one differs from the one before."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        ends = lambda at: F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(s) + 1))
        return _once(starts, lambda at: F.zip_with(at, ends(at), lambda a, b: F.struct(F.element_at(s, a).alias("term"), (b - a).cast("long").alias("tf"))))

    return _once(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, counted(s)))


def term_counts(passages: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(row_idx, term, tf) of words and pairs of neighbours. A passage is one row, so its terms are counted where they are: nothing is shuffled."""
    return spread(passages.select("row_idx", "text")).select("row_idx", F.inline(_runs(vector_terms(F.col("text"), stop_words))))


def inverse_frequency(counts: DataFrame, n_passages: int) -> DataFrame:
    """(term, df, idf): the smoothed logarithm ln((1 + n) / (1 + df)) + 1."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((1.0 + n_passages) / (1.0 + F.col("df"))) + 1.0)


def weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(row_idx, term, w): sublinear frequency times idf, each passage of unit length. Long form: nothing is ever dense."""
    raw = counts.join(idf.select("term", "idf"), "term").select("row_idx", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("raw"))
    return scaled(raw, lengths(raw))


def lengths(raw: DataFrame) -> DataFrame:
    """(row_idx, norm) of (row_idx, term, raw); summed in each task before anything is shuffled."""
    return raw.groupBy("row_idx").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))


def scaled(raw: DataFrame, norms: DataFrame) -> DataFrame:
    return raw.join(norms, "row_idx").select("row_idx", "term", F.when(F.col("norm") > 0, F.col("raw") / F.col("norm")).otherwise(0.0).alias("w"))


def stem_postings(passages: DataFrame) -> DataFrame:
    """(row_idx, stem), distinct. Words are stemmed once each, not once for each passage."""
    words = spread(passages.select("row_idx", "text")).select("row_idx", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    known = words.select("word").distinct().select("word", stem(F.col("word")).alias("stem"))
    return words.join(known, "word").select("row_idx", "stem").distinct()


def arabic_postings(passages: DataFrame) -> DataFrame:
    """(row_idx, form), distinct."""
    rows = passages.where(F.length(F.coalesce("arabic", F.lit(""))) > 0)
    return rows.select("row_idx", F.explode(ar.passage_forms(F.col("arabic"))).alias("form"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``embedding`` scaled to length one; a zero vector stays. Adds norm, the length before."""
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    v = vectors.withColumn("norm", length)
    return v.withColumn("embedding", F.transform("embedding", lambda x: x / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))))


def alignment(indexed: DataFrame, passages: DataFrame) -> DataFrame:
    """One row: aligned, and a description of the first difference. Both sides: row_idx, ref."""
    both = indexed.select("row_idx", F.col("ref").alias("a")).join(passages.select("row_idx", F.col("ref").alias("b")), "row_idx", "full_outer")
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    found = both.agg(
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(differ).alias("n_diff"), F.min(F.when(differ, F.struct("row_idx", "a", "b"))).alias("first")
    )
    text = (
        F.when(F.col("n_a") != F.col("n_b"), F.format_string("%d indexed vs %d passages", "n_a", "n_b"))
        .when(F.col("n_diff") > 0, F.format_string("same length (%d) but differs at index %d: indexed '%s' vs corpus '%s'", "n_b", F.col("first.row_idx"), F.coalesce("first.a", F.lit("")), F.coalesce("first.b", F.lit(""))))
        .otherwise("")
    )
    return found.select((F.col("n_diff") == 0).alias("aligned"), text.alias("mismatch"))


def _kept(df: DataFrame, path: str, *by: str) -> DataFrame:
    """``df`` as a stored table, sorted by ``by`` if given, so that a filter on it reads few row groups. A second column lets a frequent value of the first be divided."""
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class PassageIndex:
    """All layers of a corpus. ``problem`` says why the semantic layer is off, if it was asked for."""

    passages: DataFrame
    n_passages: int
    idf: DataFrame
    weights: DataFrame
    stems: DataFrame
    arabic: DataFrame | None = None
    vectors: DataFrame | None = None
    problem: str = ""
    stop_words: list[str] | None = None

    @staticmethod
    def build(passages: DataFrame, vectors: DataFrame | None = None, stop_words: list[str] = STOP_WORDS, path: str | None = None) -> PassageIndex:
        """Index ``passages``. With ``path`` the layers are written there, sorted by term, and read again, so a search scans few row groups.

        ``vectors``: row_idx, ref, embedding; they must have the passages' refs in the passages' order,
        else the semantic layer stays off. A corpus without usable words gives empty layers.
        """
        n = passages.count()
        counts = term_counts(passages, stop_words)
        if path:
            counts = _kept(counts, f"{path}/counts")
        idf = inverse_frequency(counts, n)
        if path:
            idf = _kept(idf, f"{path}/idf", "term")
            raw = counts.join(idf.select("term", "idf"), "term").select("row_idx", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("raw"))
            raw = _kept(raw, f"{path}/raw")  # both its sums and its rows are needed
            weighed = scaled(raw, lengths(raw))
        else:
            weighed = weights(counts, idf)
        index = PassageIndex(passages, n, idf, weighed, stem_postings(passages), stop_words=stop_words)
        if "arabic" in passages.columns:
            index.arabic = arabic_postings(passages)
        if vectors is not None:
            try:
                found = alignment(vectors, passages).first()
                index.problem = "" if found["aligned"] else found["mismatch"]
                if found["aligned"]:
                    index.vectors = unit_vectors(vectors).select("row_idx", "embedding")
            except Exception as e:  # noqa: BLE001  a broken index turns one layer off
                index.problem = f"unreadable: {type(e).__name__}"
        return index.saved(path) if path else index

    def saved(self, path: str) -> PassageIndex:
        def keep(df: DataFrame | None, name: str, *by: str) -> DataFrame | None:
            return None if df is None else _kept(df, f"{path}/{name}", *by)

        return PassageIndex(
            keep(self.passages, "passages", "row_idx"), self.n_passages, self.idf, keep(self.weights, "weights", "term", "row_idx"), keep(self.stems, "stems", "stem", "row_idx"),
            keep(self.arabic, "arabic", "form", "row_idx"), keep(self.vectors, "vectors", "row_idx"), self.problem, self.stop_words,
        )

    def persisted(self) -> PassageIndex:
        """Keep the layers in memory and disk of the executors, for a session of many searches."""
        for df in (self.idf, self.weights, self.stems, self.arabic, self.vectors):
            if df is not None:
                df.persist()
        return self

    @property
    def spark(self) -> SparkSession:
        return self.passages.sparkSession
