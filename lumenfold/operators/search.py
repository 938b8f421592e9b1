"""Hybrid search: keyword, TF-IDF and vector layers, one relevance gate, one ranking.

A query is small: its terms become literals, so the index scans are filtered where they are read.
Nothing of the corpus comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions.text import STOP_WORDS, content_terms, stem, vector_terms
from .index import PassageIndex

# Fixed values of the gate and the ranking.
MIN_SCORE, SEMANTIC, SEMANTIC_SLACK, BOOST, ARABIC_ALONE, TOP_K = 0.05, 0.35, 0.05, 0.25, 0.5, 5


@dataclass(frozen=True)
class QueryTerms:
    """Of one query: counts of vector terms; stems and Arabic words, each with its alternatives. Duplicates stay."""

    vector: dict[str, int]
    stems: list[frozenset[str]]
    arabic: list[frozenset[str]]

    @property
    def n(self) -> int:
        return len(self.stems) + len(self.arabic)


def synonym_stems(spark: SparkSession, synonyms: Mapping[str, frozenset[str]]) -> dict[str, frozenset[str]]:
    """Alternatives by stem; groups whose terms share a stem are joined."""
    pairs = [(t, o) for t, group in synonyms.items() for o in group]
    if not pairs:
        return {}
    rows = spark.createDataFrame(pairs, "term string, other string").select(stem(F.col("term")).alias("s"), stem(F.col("other")).alias("o")).distinct().collect()
    out: dict[str, set[str]] = {}
    for r in rows:
        out.setdefault(r["s"], set()).add(r["o"])
    return {k: frozenset(v) for k, v in out.items()}


def query_terms(spark: SparkSession, query: str, synonyms: Mapping[str, frozenset[str]] | None = None, stop_words: list[str] = STOP_WORDS) -> QueryTerms:
    q = F.lit(query)
    row = spark.range(1).select(vector_terms(q, stop_words).alias("v"), F.transform(content_terms(q, stop_words), stem).alias("s"), ar.query_terms(q).alias("a")).first()
    counts: dict[str, int] = {}
    for t in row["v"]:
        counts[t] = counts.get(t, 0) + 1
    known = synonyms or {}
    return QueryTerms(counts, [known.get(s, frozenset([s])) for s in row["s"]], [frozenset(a) for a in row["a"] if a])


def tfidf_scores(index: PassageIndex, terms: QueryTerms) -> DataFrame | None:
    """(row_idx, tfidf): cosine with the query over the terms that both have; None if the corpus has none of them."""
    if not terms.vector:
        return None
    found = index.idf.where(F.col("term").isin(list(terms.vector))).select("term", "idf").collect()
    raw = {r["term"]: (1.0 + math.log(terms.vector[r["term"]])) * r["idf"] for r in found}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    if not norm:
        return None
    q = F.create_map(*(F.lit(x) for t, w in raw.items() for x in (t, w / norm)))
    return index.weights.where(F.col("term").isin(list(raw))).groupBy("row_idx").agg(F.sum(F.col("w") * q[F.col("term")]).alias("tfidf"))


def keyword_fractions(index: PassageIndex, terms: QueryTerms) -> DataFrame | None:
    """(row_idx, kw): the share of the query's terms of which a passage has an alternative."""
    if not terms.n:
        return None

    def hits(postings: DataFrame, column: str, groups: list[frozenset[str]]) -> DataFrame:
        where: dict[str, list[int]] = {}
        for i, alternatives in enumerate(groups):
            for a in alternatives:
                where.setdefault(a, []).append(i)
        m = F.create_map(*(x for a, at in where.items() for x in (F.lit(a), F.array(*map(F.lit, at)))))
        own = postings.where(F.col(column).isin(list(where))).select("row_idx", F.explode(m[F.col(column)]).alias("i"))
        return own.groupBy("row_idx").agg(F.count_distinct("i").alias("n"))

    parts = [hits(index.stems, "stem", terms.stems)] if terms.stems else []
    if terms.arabic and index.arabic is not None:
        parts.append(hits(index.arabic, "form", terms.arabic))
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).groupBy("row_idx").agg((F.sum("n") / terms.n).alias("kw"))


def dot(embedding: Column, vector: list[float]) -> Column:
    return F.aggregate(F.zip_with(embedding, F.array(*map(F.lit, vector)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def usable_vector(vector: object, width: int | None = None) -> list[float] | None:
    """A query vector scaled to length one; None unless it is flat, of that width, and not zero."""
    try:
        v = [float(x) for x in vector]  # type: ignore[attr-defined]
    except (TypeError, ValueError):
        return None
    n = math.sqrt(sum(x * x for x in v))
    if not v or (width is not None and len(v) != width) or not n or not math.isfinite(n):
        return None
    return [x / n for x in v]


def semantic_scores(index: PassageIndex, query: str, embed_query: Callable[[str], list[float]] | None) -> DataFrame | None:
    """(row_idx, sem): cosine with the query's vector; None where the layer is off or the vector is unusable. Nothing raises."""
    if index.vectors is None or embed_query is None:
        return None
    try:
        vector = embed_query(query)
        first = index.vectors.select(F.size("embedding").alias("n")).first()
        vector = usable_vector(vector, first["n"] if first else None)
    except Exception:  # noqa: BLE001
        return None
    if vector is None:
        return None
    return index.vectors.select("row_idx", dot(F.col("embedding"), vector).alias("sem"))


def gate(kw: Column, tfidf: Column, sem: Column, min_score: float, semantic: float, arabic_only: bool) -> Column:
    """Whether a passage is relevant: all terms occur, a layer is sure, some terms occur and a layer half agrees, or half of an Arabic query occurs. A null ``sem`` is no evidence."""
    some = (tfidf >= min_score / 2) | F.coalesce(sem >= semantic - SEMANTIC_SLACK, F.lit(False))
    out = (kw >= 1.0) | (tfidf >= min_score) | F.coalesce(sem >= semantic, F.lit(False)) | ((kw > 0) & some)
    return out | (kw >= ARABIC_ALONE) if arabic_only else out


def layers(kw: Column, tfidf: Column, sem: Column, min_score: float, semantic: float) -> Column:
    """Names of the layers that matched, in a fixed order."""
    return F.array_compact(
        F.array(F.when(kw >= 1.0, "keyword").when(kw > 0, "keyword-partial"), F.when(F.coalesce(sem >= semantic, F.lit(False)), "semantic"), F.when(tfidf >= min_score, "tfidf"))
    )


class Retriever:
    """Search over a :class:`PassageIndex`."""

    def __init__(self, index: PassageIndex, embed_query: Callable[[str], list[float]] | None = None, semantic_threshold: float = SEMANTIC, synonyms: Mapping[str, frozenset[str]] | None = None):
        self.index, self.embed_query, self.semantic_threshold = index, embed_query, semantic_threshold
        self.synonyms = synonym_stems(index.spark, synonyms or {})

    def scores(self, query: str, min_score: float = MIN_SCORE) -> DataFrame:
        """(row_idx, kw, tfidf, sem, score, matched) of every passage that clears the gate, in no order."""
        ix = self.index
        terms = query_terms(ix.spark, query, self.synonyms, ix.stop_words or STOP_WORDS)
        parts = [("kw", keyword_fractions(ix, terms)), ("tfidf", tfidf_scores(ix, terms)), ("sem", semantic_scores(ix, query, self.embed_query))]
        # Each layer lists only passages that it knows, so the corpus itself isn't joined: the union is summed.
        kinds = {name: "double" for name, _ in parts}
        rows = [df.select("row_idx", *(F.col(n) if n == name else F.lit(None).cast(k).alias(n) for n, k in kinds.items())) for name, df in parts if df is not None]
        if not rows:
            return ix.spark.createDataFrame([], "row_idx long, kw double, tfidf double, sem double, score double, matched array<string>")
        joined = reduce(DataFrame.unionByName, rows).groupBy("row_idx").agg(F.coalesce(F.max("kw"), F.lit(0.0)).alias("kw"), F.coalesce(F.max("tfidf"), F.lit(0.0)).alias("tfidf"), F.max("sem").alias("sem"))
        kw, tfidf, sem = F.col("kw"), F.col("tfidf"), F.col("sem")
        kept = joined.where(gate(kw, tfidf, sem, min_score, self.semantic_threshold, bool(terms.arabic) and not terms.stems))
        return kept.select("row_idx", "kw", "tfidf", "sem", (F.greatest(tfidf, F.coalesce(sem, tfidf)) + BOOST * kw).alias("score"), layers(kw, tfidf, sem, min_score, self.semantic_threshold).alias("matched"))

    def search(self, query: str, top_k: int = TOP_K, min_score: float = MIN_SCORE, mode: str = "top") -> DataFrame:
        """(row_idx, ref, text, ..., score, matched), best first. mode "top": ``top_k`` of them; "all": every one."""
        ranked = self.scores(query, min_score).select("row_idx", "score", "matched").orderBy(F.desc("score"), F.desc("row_idx"))
        if mode == "top":
            ranked = ranked.limit(top_k)
        return ranked.join(self.index.passages, "row_idx").select(*self.index.passages.columns, "score", "matched").orderBy(F.desc("score"), F.desc("row_idx"))


def response_rows(hits: DataFrame, commentary: DataFrame | None = None) -> DataFrame:
    """ref, text, arabic, score (3 places), matched, has_commentary. ``commentary``: ref of those that have it."""
    arabic = F.col("arabic") if "arabic" in hits.columns else F.lit("")
    rows = hits.select("row_idx", "ref", "text", arabic.alias("arabic"), F.round("score", 3).alias("score"), "matched")
    return with_commentary_flag(rows, commentary)


def with_commentary_flag(rows: DataFrame, commentary: DataFrame | None) -> DataFrame:
    if commentary is None:
        return rows.withColumn("has_commentary", F.lit(False))
    known = commentary.select("ref", F.lit(True).alias("_has")).distinct()
    return rows.join(known, "ref", "left").withColumn("has_commentary", F.col("_has").isNotNull()).drop("_has")


def match_label(matched: Column) -> Column:
    """What a reader is told of a match."""
    return F.when(F.array_contains(matched, "keyword") | F.array_contains(matched, "keyword-partial"), "word match").when(F.array_contains(matched, "semantic"), "related by meaning").otherwise("related")


def strength(score: Column, best: Column) -> Column:
    """1 to 4 by the share of the best score; 0 where that is 0."""
    return F.when(best > 0, F.greatest(F.lit(1), F.least(F.lit(4), F.floor(4 * score / best + 0.5)))).otherwise(0).cast("int")
