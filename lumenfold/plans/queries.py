"""Named queries over the test tables, each with the SQL that states what it should return, where SQL can.

``documents`` stand for passages (ref: the id), ``conversations`` for chapter and verse, ``labels`` for
commentary, ``embeddings`` for the vector index, ``events`` for requests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arabic as ar
from ..functions import text as tx
from ..operators import answer, etl, index, search, understand
from ..sources import passages as src
from ..session import scratch
from ..streaming import limiter
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUESTION = "the thing that enti and eras"
SOURCE = "the corpus"
OFF_TOPIC = "kubernetes zzqx"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("ref"), "text")


def verses(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_idx"), F.concat_ws(":", "conv_id", "turn").alias("ref"), "text", F.col("conv_id").cast("int").alias("chapter"), F.col("turn").cast("int").alias("verse"))


def shifted(spark: SparkSession, d: str) -> DataFrame:
    """Verses whose refs are one too high in every third chapter, as a source that lost count."""
    v = verses(spark, d)
    return v.withColumn("ref", F.concat_ws(":", "chapter", F.col("verse") + F.when(F.col("chapter") % 3 == 0, 1).otherwise(0)))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("vec_id").cast("string").alias("ref"), "embedding")


def retriever(spark: SparkSession, d: str) -> search.Retriever:
    """Vectors cover the first passages only, so the index is put together without the check of refs; the query's vector is that of passage 7."""
    ix = index.PassageIndex.build(corpus(spark, d), path=scratch(spark))
    ix.vectors = index.unit_vectors(vectors(spark, d)).select("row_idx", "embedding")
    own = vectors(spark, d).where("row_idx = 7").first()["embedding"]
    return search.Retriever(ix, lambda _: list(own))


def lexical(spark: SparkSession, d: str) -> search.Retriever:
    return search.Retriever(index.PassageIndex.build(corpus(spark, d), path=scratch(spark)))


# Text functions


@query("SELECT word, count(*) AS freq FROM (SELECT unnest(" + sql.TOKENS.format("text") + ") AS word FROM documents) GROUP BY word")
def vocab_counts(spark, d):
    return index.vocabulary(corpus(spark, d))


@query("WITH w AS (SELECT unnest(" + sql.TOKENS.format("text") + ") AS word FROM documents), " + sql.stems("w") + " SELECT word, stem FROM stemmed")
def stem_terms(spark, d):
    return index.vocabulary(corpus(spark, d)).select("word", tx.stem(F.col("word")).alias("stem"))


@query("WITH w AS (SELECT unnest(" + sql.TOKENS.format("text") + ") AS word FROM documents), " + sql.spelling_keys("w") + " SELECT key, string_agg(word, ' ' ORDER BY word) AS words, count(*) AS n_words FROM keyed WHERE length(word) >= 4 GROUP BY key")
def translit_keys(spark, d):
    g = understand.key_groups(index.vocabulary(corpus(spark, d)))
    return g.select("key", F.array_join("words", " ").alias("words"), F.size("words").cast("long").alias("n_words"))


@query("SELECT item_id, array_to_string(list_filter(" + sql.TOKENS.format("text") + f", lambda t: length(t) >= 3 AND NOT list_contains({sql.STOP}, t)), ' ') AS terms FROM benchmark")
def query_term_filter(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(tx.content_terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT doc_id, CAST(len({sql.bag('text')}) AS BIGINT) AS n_words, array_to_string(list_sort({sql.bag('text')}), ' ') AS words FROM documents")
def content_bags(spark, d):
    b = tx.content_bag(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(b).cast("long").alias("n_words"), F.array_join(F.array_sort(b), " ").alias("words"))



@query(
    """WITH l AS (SELECT page_id, list_filter(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)), lambda x: regexp_matches(x, '[A-Za-z]{2,}')) AS kept,
         list_filter(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)), lambda x: NOT (trim(x) = '' OR regexp_matches(x, '^\\s*\\d+\\s+out\\s+of\\s+\\d+\\s*$') OR regexp_matches(x, '^\\s*\\d{1,3}\\s+[A-Z]') OR regexp_matches(x, '^\\s*(?i)\\(REPEATED'))) AS plain FROM pages)
       SELECT page_id, CAST(len(kept) AS BIGINT) AS n_latin, CAST(len(plain) AS BIGINT) AS n_plain, md5(array_to_string(kept, chr(10))) AS latin_md5 FROM l"""
)
def line_cleaning(spark, d):
    p = table(spark, d, "pages").withColumn("t", F.replace("html", F.lit("><"), F.lit(">\n<")))
    latin = tx.latin_lines(F.col("t"))
    plain = F.filter(F.split("t", "\n"), lambda x: ~tx.is_furniture(x))
    return p.select("page_id", F.size(latin).cast("long").alias("n_latin"), F.size(plain).cast("long").alias("n_plain"), F.md5(F.array_join(latin, "\n")).alias("latin_md5"))


@query(
    """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-z]{2,}')) AS l FROM documents),
       a AS (SELECT doc_id, regexp_replace(array_to_string(l, ' '), '\\[\\d+:\\d+\\]', '', 'g') AS t FROM l),
       b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([A-Za-z])\\d{1,3}($|[\\s.,;:!?''‘’")\\]])', '\\1\\2', 'g'), '([A-Za-z])\\d{1,3}($|[\\s.,;:!?''‘’")\\]])', '\\1\\2', 'g') AS t FROM a),
       c AS (SELECT doc_id, regexp_replace(trim(regexp_replace(t, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' ([.,;:!?])', '\\1', 'g') AS t FROM b)
       SELECT doc_id, md5(trim(t, ' .')) AS cleaned_md5 FROM c"""
)
def cleaned_text(spark, d):
    """Every document as one cleaned line."""
    return table(spark, d, "documents").select("doc_id", F.md5(tx.clean(F.col("text"))).alias("cleaned_md5"))


_MARKED = [(1, "See [2:255] and [3:18], then [2:256]."), (2, "none here"), (3, "[114:6][1:1]"), (4, "[1:x] [12:] [7:7]"), (5, "")]
_MARKED_SQL = ", ".join(f"({i}, {sql.text(t)})" for i, t in _MARKED)


@query(
    f"""WITH m AS (SELECT * FROM (VALUES {_MARKED_SQL}) AS m(id, t)), z AS (SELECT id, unnest(list_zip(regexp_extract_all(t, '\\[(\\d+):(\\d+)\\]', 1), regexp_extract_all(t, '\\[(\\d+):(\\d+)\\]', 2), range(len(regexp_extract_all(t, '\\[(\\d+):(\\d+)\\]'))))) AS z FROM m)
        SELECT CAST(id AS BIGINT) AS id, CAST(z[3] AS INTEGER) AS pos, CAST(z[1] AS INTEGER) AS chapter, CAST(z[2] AS INTEGER) AS verse FROM z"""
)
def citations_extract(spark, d):
    m = spark.createDataFrame(_MARKED, "id long, t string")
    return m.select("id", F.posexplode(tx.citations(F.col("t"))).alias("pos", "c")).select("id", "pos", "c.chapter", "c.verse")


_ARABIC = ["ٱلْحَمْدُ لِلَّهِ رَبِّ ٱلْعَٰلَمِينَ", "ٱلرَّحْمَٰنِ ٱلرَّحِيمِ", "يَٰمُوسَىٰ", "بِٱلصَّبْرِ", "مؤمن آمن شيئة إلى", "وَبِٱلْوَٰلِدَيْنِ إِحْسَٰنًا", "plain", ""]
_ARABIC_SQL = ", ".join(f"({i}, {sql.text(t)})" for i, t in enumerate(_ARABIC))


@query(f"SELECT CAST(id AS BIGINT) AS id, {sql.arabic('t', ar.ALEF)} AS with_alef, {sql.arabic('t', '')} AS without_alef FROM (VALUES {_ARABIC_SQL}) AS m(id, t)")
def arabic_normalise(spark, d):
    t = F.col("t")
    return spark.createDataFrame(list(enumerate(_ARABIC)), "id long, t string").select("id", ar.normalized(t).alias("with_alef"), ar.normalized(t, False).alias("without_alef"))


# Twelve rounds over the four kinds of particles; then forms of over three letters also without a last alef.
@query(
    f"""WITH RECURSIVE r AS (SELECT id, unnest([{sql.arabic('t', ar.ALEF)}, {sql.arabic('t', '')}]) AS t FROM (VALUES {_ARABIC_SQL}) AS m(id, t)),
        w AS (SELECT DISTINCT id, unnest(list_filter(string_split(t, ' '), lambda x: x <> '')) AS t FROM r),
        p AS (SELECT id, t, 0 AS i FROM w UNION ALL
              SELECT id, CASE WHEN i % 4 = 0 AND length(t) > 4 AND t[1:2] = 'يا' THEN t[3:] WHEN i % 4 = 1 AND length(t) > 3 AND t[1] IN ('و', 'ف') THEN t[2:]
                              WHEN i % 4 = 2 AND length(t) > 3 AND t[1] IN ('ب', 'ك', 'ل') THEN t[2:] WHEN i % 4 = 3 AND length(t) > 3 AND t[1:2] = 'ال' THEN t[3:] ELSE t END, i + 1
              FROM p WHERE i < 12)
        SELECT CAST(id AS BIGINT) AS id, t AS form FROM p UNION SELECT CAST(id AS BIGINT), t[:-2] FROM p WHERE length(t) > 3 AND t[-1] = '{ar.ALEF}'"""
)
def arabic_variants(spark, d):
    """Every form under which a passage's Arabic words are indexed."""
    return spark.createDataFrame(list(enumerate(_ARABIC)), "id long, t string").select("id", F.explode(ar.passage_forms(F.col("t"))).alias("form"))


_REQUESTS = [(1, "1.1.1.1, 2.2.2.2, 3.3.3.3", "9.9.9.9"), (2, "", "9.9.9.9"), (3, None, "8.8.8.8"), (4, " , ,", "7.7.7.7"), (5, "5.5.5.5", None), (6, None, None)]
_REQUESTS_SQL = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else sql.text(x) for x in r) + ")" for r in _REQUESTS)


def _client_sql(hops: int) -> str:
    parts = "list_filter(list_transform(string_split(coalesce(forwarded, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
    return f"CASE WHEN len({parts}) = 0 THEN coalesce(peer, 'unknown') ELSE ({parts})[greatest(len({parts}) - {hops} + 1, 1)] END"


@query(f"SELECT CAST(id AS BIGINT) AS id, {_client_sql(1)} AS one_hop, {_client_sql(2)} AS two_hops, {_client_sql(9)} AS many_hops, coalesce(peer, 'unknown') AS no_hops FROM (VALUES {_REQUESTS_SQL}) AS m(id, forwarded, peer)")
def client_key(spark, d):
    f, p = F.col("forwarded"), F.col("peer")
    r = spark.createDataFrame(_REQUESTS, "id long, forwarded string, peer string")
    return r.select("id", tx.client_key(f, p, 1).alias("one_hop"), tx.client_key(f, p, 2).alias("two_hops"), tx.client_key(f, p, 9).alias("many_hops"), tx.client_key(f, p, 0).alias("no_hops"))


# A word's edge is stated here by letters, digits, marks and underscores of any script, which both engines tell alike.
@query("SELECT item_id, regexp_replace(regexp_replace(text, '(^|[^\\p{L}\\p{N}\\p{M}_])(?i:the)($|[^\\p{L}\\p{N}\\p{M}_])', '\\1THAT\\2', 'g'), '(^|[^\\p{L}\\p{N}\\p{M}_])(?i:the)($|[^\\p{L}\\p{N}\\p{M}_])', '\\1THAT\\2', 'g') AS replaced FROM benchmark")
def word_replacement(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", tx.replace_word(F.col("text"), "the", "THAT").alias("replaced"))


@query("SELECT conv_id, turn, CAST(conv_id AS INTEGER) AS chapter, CAST(turn AS INTEGER) AS verse FROM conversations")
def ref_parsing(spark, d):
    c = table(spark, d, "conversations")
    at = tx.ref_parts(F.concat_ws(":", "conv_id", "turn"))
    return c.select("conv_id", "turn", at["chapter"].alias("chapter"), at["verse"].alias("verse"))


_HEADERS = ["VERSES 1 - 4", "VERSE 12", "VERSES 16 & 21", "VERSES"]


@query("SELECT h, list_min(n) AS first, list_max(n) AS last FROM (SELECT h, list_transform(regexp_extract_all(h, '\\d+'), lambda x: CAST(x AS INTEGER)) AS n FROM (VALUES " + ", ".join(f"({sql.text(h)})" for h in _HEADERS) + ") AS m(h))")
def header_ranges(spark, d):
    return spark.createDataFrame([(h,) for h in _HEADERS], "h string").select("h", tx.header_range(F.col("h")).alias("r")).select("h", "r.first", "r.last")


# Index


@query("WITH " + sql.tfidf() + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def inverse_frequency(spark, d):
    c = corpus(spark, d)
    return index.inverse_frequency(index.term_counts(c), c.count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query("WITH " + sql.tfidf() + " SELECT id AS row_idx, count(*) AS n_terms, round(max(w), 6) AS heaviest, round(sum(w * w), 6) AS length FROM weight GROUP BY id")
def tfidf_weights(spark, d):
    w = index.PassageIndex.build(corpus(spark, d)).weights
    return w.groupBy("row_idx").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("w"), 6).alias("heaviest"), F.round(F.sum(F.col("w") * F.col("w")), 6).alias("length"))


@query("WITH passage AS (SELECT doc_id AS id, text FROM documents), " + sql.vector_terms("passage") + " SELECT term, count(*) AS n FROM terms WHERE contains(term, ' ') GROUP BY term")
def bigram_counts(spark, d):
    t = corpus(spark, d).select(F.explode(tx.vector_terms(F.col("text"))).alias("term")).where(F.contains("term", F.lit(" ")))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS row_idx, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def embedding_norms(spark, d):
    return index.unit_vectors(vectors(spark, d)).select("row_idx", F.round("norm", 6).alias("norm"))


@query(
    """WITH a AS (SELECT vec_id AS i, CAST(vec_id AS VARCHAR) AS a FROM embeddings), b AS (SELECT vec_id AS i, CAST(CASE WHEN vec_id % 100 = 42 THEN -vec_id ELSE vec_id END AS VARCHAR) AS b FROM embeddings),
       j AS (SELECT i, a, b, a IS DISTINCT FROM b AS differ FROM a FULL JOIN b USING (i)), f AS (SELECT * FROM j WHERE differ ORDER BY i LIMIT 1)
       SELECT (SELECT count(*) FROM j WHERE differ) = 0 AS aligned, 'same length (' || (SELECT count(*) FROM b) || ') but differs at index ' || i || ': indexed ''' || a || ''' vs corpus ''' || b || '''' AS mismatch FROM f"""
)
def index_alignment(spark, d):
    v = vectors(spark, d)
    return index.alignment(v, v.withColumn("ref", F.when(F.col("row_idx") % 100 == 42, -F.col("row_idx")).otherwise(F.col("row_idx")).cast("string")))


# Search


@query("WITH passage AS (SELECT doc_id AS id, text FROM documents), " + sql.keyword(QUESTION) + " SELECT id AS row_idx, round(kw, 6) AS kw FROM keyword")
def keyword_fraction(spark, d):
    c = corpus(spark, d)
    ix = index.PassageIndex(c, 0, c, c, index.stem_postings(c))
    return search.keyword_fractions(ix, search.query_terms(spark, QUESTION)).select("row_idx", F.round("kw", 6).alias("kw"))


_LEXICAL = "WITH " + sql.tfidf() + ", " + sql.query_scores(QUESTION) + """,
        scored AS (SELECT id, coalesce(kw, 0) AS kw, coalesce(tfidf, 0) AS tfidf FROM keyword FULL JOIN tfidf_score USING (id)),
        gated AS (SELECT *, tfidf + 0.25 * kw AS score FROM scored WHERE kw >= 1 OR tfidf >= 0.05 OR (kw > 0 AND tfidf >= 0.025))"""


@query("WITH " + sql.tfidf() + ", " + sql.query_scores(QUESTION) + " SELECT id AS row_idx, round(tfidf, 6) AS tfidf FROM tfidf_score ORDER BY tfidf DESC, id DESC LIMIT 10")
def tfidf_topk(spark, d):
    ix = index.PassageIndex.build(corpus(spark, d), path=scratch(spark))
    s = search.tfidf_scores(ix, search.query_terms(spark, QUESTION))
    return s.orderBy(F.desc("tfidf"), F.desc("row_idx")).limit(10).select("row_idx", F.round("tfidf", 6).alias("tfidf"))


@query(_LEXICAL + " SELECT id AS row_idx, round(score, 6) AS score FROM gated")
def tfidf_all_gated(spark, d):
    return lexical(spark, d).search(QUESTION, mode="all").select("row_idx", F.round("score", 6).alias("score"))


_DENSE = """
        u AS (SELECT vec_id AS id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings),
        dense AS (SELECT a.id, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: (CAST(a.e[i] AS DOUBLE) / a.n) * (CAST(b.e[i] AS DOUBLE) / b.n))) AS sem FROM u a, (SELECT * FROM u WHERE id = 7) b)"""


@query("WITH " + _DENSE.strip() + " SELECT id AS row_idx, round(sem, 6) AS sem FROM dense ORDER BY sem DESC, id DESC LIMIT 10")
def dense_cosine_topk(spark, d):
    own = vectors(spark, d).where("row_idx = 7").first()["embedding"]
    v = index.unit_vectors(vectors(spark, d)).select("row_idx", search.dot(F.col("embedding"), search.usable_vector(own)).alias("sem"))
    return v.orderBy(F.desc("sem"), F.desc("row_idx")).limit(10).select("row_idx", F.round("sem", 6).alias("sem"))


_HYBRID = "WITH " + sql.tfidf() + ", " + sql.query_scores(QUESTION) + "," + _DENSE + """,
        scored AS (SELECT id, coalesce(kw, 0) AS kw, coalesce(tfidf, 0) AS tfidf, sem FROM keyword FULL JOIN tfidf_score USING (id) FULL JOIN dense USING (id)),
        gated AS (SELECT *, greatest(tfidf, coalesce(sem, tfidf)) + 0.25 * kw AS score FROM scored
                  WHERE kw >= 1 OR tfidf >= 0.05 OR coalesce(sem >= 0.35, false) OR (kw > 0 AND (tfidf >= 0.025 OR coalesce(sem >= 0.3, false)))),
        labelled AS (SELECT *, concat_ws(',', CASE WHEN kw >= 1 THEN 'keyword' WHEN kw > 0 THEN 'keyword-partial' END, CASE WHEN sem >= 0.35 THEN 'semantic' END, CASE WHEN tfidf >= 0.05 THEN 'tfidf' END) AS matched FROM gated)"""


@query(_HYBRID + " SELECT id AS row_idx, CAST(id AS VARCHAR) AS ref, round(score, 6) AS score, matched FROM labelled JOIN documents ON doc_id = id ORDER BY score DESC, id DESC LIMIT 5")
def hybrid_search(spark, d):
    return retriever(spark, d).search(QUESTION).select("row_idx", "ref", F.round("score", 6).alias("score"), F.array_join("matched", ",").alias("matched"))


@query(_HYBRID + " SELECT id AS row_idx, round(kw, 6) AS kw, round(tfidf, 6) AS tfidf, round(sem, 6) AS sem, round(score, 6) AS score, matched FROM labelled JOIN documents ON doc_id = id")
def matched_layers(spark, d):
    s = retriever(spark, d).scores(QUESTION).join(corpus(spark, d), "row_idx", "left_semi")
    return s.select("row_idx", *(F.round(c, 6).alias(c) for c in ("kw", "tfidf", "sem", "score")), F.array_join("matched", ",").alias("matched"))


@query(
    _HYBRID + """, h AS (SELECT id, score, matched FROM labelled JOIN documents ON doc_id = id), m AS (SELECT max(score) AS best FROM h)
        SELECT id AS row_idx, CASE WHEN contains(matched, 'keyword') THEN 'word match' WHEN contains(matched, 'semantic') THEN 'related by meaning' ELSE 'related' END AS label,
               CAST(CASE WHEN best > 0 THEN greatest(1, least(4, floor(4 * score / best + 0.5))) ELSE 0 END AS INTEGER) AS strength FROM h, m"""
)
def strength_marks(spark, d):
    h = retriever(spark, d).search(QUESTION, mode="all")
    best = F.max("score").over(Window.partitionBy())
    return h.select("row_idx", "score", search.match_label(F.col("matched")).alias("label"), best.alias("best")).select("row_idx", "label", search.strength(F.col("score"), F.col("best")).alias("strength"))


@query(
    _HYBRID + """ SELECT CAST(id AS VARCHAR) AS ref, text, '' AS arabic, round(score, 3) AS score, matched, quality IS NOT NULL AS has_commentary
        FROM labelled JOIN documents d ON d.doc_id = id LEFT JOIN labels l ON l.doc_id = id ORDER BY labelled.score DESC, id DESC LIMIT 20"""
)
def response_rows(spark, d):
    hits = retriever(spark, d).search(QUESTION, top_k=20)
    known = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("ref"))
    r = search.response_rows(hits, known)
    return r.select("ref", "text", "arabic", "score", F.array_join("matched", ",").alias("matched"), "has_commentary")


@query(
    _HYBRID + """, h AS (SELECT id, score, text FROM labelled JOIN documents ON doc_id = id ORDER BY score DESC, id DESC LIMIT 5)
        SELECT true AS found, string_agg('[' || id || '] ' || text, chr(10) || chr(10) ORDER BY score DESC, id DESC) AS text, string_agg('[' || id || ']', ', ' ORDER BY score DESC, id DESC) AS sources, CAST(count(*) AS INTEGER) AS n_citations FROM h"""
)
def grounded_answer(spark, d):
    return answer.answer_row(retriever(spark, d).search(QUESTION), SOURCE)


@query(f"SELECT false AS found, {sql.text(answer.decline(SOURCE))} AS text, '' AS sources, CAST(0 AS INTEGER) AS n_citations")
def declined_answer(spark, d):
    return answer.answer_row(lexical(spark, d).search(OFF_TOPIC), SOURCE)


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS ref, doc_id IN (SELECT doc_id FROM labels) AS has_commentary FROM documents")
def has_commentary(spark, d):
    known = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("ref"))
    return search.with_commentary_flag(table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("ref")), known)


_PROMPT = "'Verse [' || doc_id || ']: ' || text || chr(10) || chr(10) || 'Commentary:' || chr(10) || CASE WHEN text = '' THEN '(no commentary available)' WHEN length(text) > 12000 THEN left(text, 12000) || " + sql.text(tx.CUT_NOTE) + " ELSE text END || chr(10) || chr(10) || 'Reader''s original question: why'"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS ref, {_PROMPT} AS prompt FROM documents")
def explanation_prompts(spark, d):
    p = corpus(spark, d).select("ref", "text", F.col("text").alias("commentary"))
    return answer.explanation_prompts(p, "why")


# Understanding


@query(
    "WITH w AS (SELECT DISTINCT unnest(" + sql.TOKENS.format("text") + ") AS word FROM documents), g AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {sql.text(t)})" for i, g in enumerate([["the", "thing", "things"], ["moses", "and", "zz"], ["of", "qq"], ["xx", "yy"]]) for t in g)
    + ") AS g(gid, term)), u AS (SELECT gid, string_agg(term, ' ' ORDER BY term) AS usable FROM g SEMI JOIN w ON word = term GROUP BY gid) SELECT term, usable FROM g JOIN u USING (gid)"
)
def synonym_expand(spark, d):
    a = understand.alias_table(spark, [["the", "thing", "things"], ["moses", "and", "zz"], ["of", "qq"], ["xx", "yy"]])
    return understand.usable_aliases(a, index.vocabulary(corpus(spark, d))).select("term", F.array_join("usable", " ").alias("usable"))


@query(
    "WITH w AS (SELECT DISTINCT unnest(" + sql.TOKENS.format("text") + ") AS word FROM documents) SELECT word FROM w UNION SELECT term FROM (VALUES "
    + ", ".join(f"({sql.text(t)})" for g in understand.alias_groups() for t in g) + ") AS g(term)"
)
def known_inputs(spark, d):
    return understand.known_inputs(index.vocabulary(corpus(spark, d)), understand.alias_table(spark))


_TYPED = ["thinng", "withh", "ationn", "moses", "thatt", "zzzqqxyw", "hwich", "noah"]


@query()
def spelling_candidates(spark, d):
    """Candidates of mistyped words among the corpus's words."""
    qu = understand.QueryUnderstanding(spark, index.vocabulary(corpus(spark, d)))
    return qu.candidates(_TYPED).select("word", "candidate", F.round("score", 6).alias("score"), "rank")


@query()
def interpreted_queries(spark, d):
    # Stored, not cached: each question reads it several times, and nothing is left in memory.
    words, path = index.vocabulary(corpus(spark, d)), scratch(spark)
    words.write.parquet(path)
    qu = understand.QueryUnderstanding(spark, spark.read.schema(words.schema).parquet(path))
    rows = [qu.analyse(q) for q in ("thinng of moses", "zzzqqxyw", "the thing", "withh")]
    return spark.createDataFrame([(i.query, i.effective, len(i.replaced), len(i.choices), i.unclear) for i in rows], "original string, effective string, n_corrections int, n_suggestions int, needs_confirmation boolean")


# Corpus building

_SHIFT = "shifted AS (SELECT conv_id * 1000 + turn AS row_idx, conv_id AS c, turn + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS v, text FROM conversations)"
_AUDIT = f"""WITH {_SHIFT}, b AS (SELECT row_idx, c, v, {sql.bag('text')} AS bag FROM shifted), n AS (SELECT conv_id AS c, turn AS v, {sql.bag('text')} AS bag FROM conversations),
        s AS (SELECT row_idx, b.c, b.v, off, CASE WHEN least(len(b.bag), len(n.bag)) > 0 THEN len(list_intersect(b.bag, n.bag)) / CAST(least(len(b.bag), len(n.bag)) AS DOUBLE) WHEN n.c IS NOT NULL THEN 0 END AS s
              FROM b CROSS JOIN (VALUES (0), (-2), (-1), (1), (2)) AS o(off) LEFT JOIN n ON n.c = b.c AND n.v = b.v + off),
        w AS (SELECT row_idx, c, v, coalesce(max(s) FILTER (off = 0), 0) AS s0, max(s) FILTER (off = -2) AS s1, max(s) FILTER (off = -1) AS s2, max(s) FILTER (off = 1) AS s3, max(s) FILTER (off = 2) AS s4 FROM s GROUP BY ALL),
        a1 AS (SELECT *, CASE WHEN s1 > s0 + 0.15 THEN s1 ELSE s0 END AS b1, CASE WHEN s1 > s0 + 0.15 THEN -2 ELSE 0 END AS o1 FROM w),
        a2 AS (SELECT *, CASE WHEN s2 > b1 + 0.15 THEN s2 ELSE b1 END AS b2, CASE WHEN s2 > b1 + 0.15 THEN -1 ELSE o1 END AS o2 FROM a1),
        a3 AS (SELECT *, CASE WHEN s3 > b2 + 0.15 THEN s3 ELSE b2 END AS b3, CASE WHEN s3 > b2 + 0.15 THEN 1 ELSE o2 END AS o3 FROM a2),
        a4 AS (SELECT *, CASE WHEN s4 > b3 + 0.15 THEN s4 ELSE b3 END AS best, CASE WHEN s4 > b3 + 0.15 THEN 2 ELSE o3 END AS o FROM a3),
        audited AS (SELECT row_idx, c || ':' || v AS ref, c || ':' || (v + o) AS target, s0 AS own, best, o <> 0 AS moved, o = 0 AND s0 < 0.15 AS weak, c FROM a4)"""


def _audited(spark, d):
    return etl.audit(shifted(spark, d), verses(spark, d))


@query(_AUDIT + " SELECT row_idx, ref, target, round(own, 2) AS own, round(best, 2) AS best, moved, weak FROM audited")
def neighbour_audit(spark, d):
    a = _audited(spark, d)
    return a.select("row_idx", "ref", "target", F.round("own", 2).alias("own"), F.round("best", 2).alias("best"), "moved", "weak")


@query(_AUDIT + ", r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY best DESC, row_idx) AS n FROM audited) SELECT row_idx, target AS ref, text FROM r JOIN shifted USING (row_idx) WHERE n = 1")
def realign_winner(spark, d):
    return etl.realigned(_audited(spark, d), shifted(spark, d)).select("row_idx", "ref", "text")


@query(_AUDIT + " SELECT count(*) AS n_rows, count(*) FILTER (moved) AS misaligned, count(*) FILTER (weak) AS weak, count(DISTINCT target) AS kept, count(*) - count(DISTINCT target) AS dropped FROM audited")
def audit_summary(spark, d):
    return etl.audit_summary(_audited(spark, d))


@query(_AUDIT + " SELECT CAST(c AS INTEGER) AS chapter, count(*) AS misaligned FROM audited WHERE moved GROUP BY c ORDER BY misaligned DESC, c LIMIT 12")
def worst_chapters(spark, d):
    return etl.worst_chapters(_audited(spark, d))


@query("SELECT doc_id AS position, md5(text) AS ref FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_wins(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("position"), F.md5("text").alias("ref"))
    return etl.first_wins(rows)


@query("SELECT CAST(range AS INTEGER) AS chapter, count(conv_id) AS verses FROM range(1, 115) LEFT JOIN conversations ON conv_id = range GROUP BY range")
def chapter_counts(spark, d):
    return src.chapter_report(verses(spark, d))


@query("SELECT ref, n FROM (SELECT conv_id || ':' || turn AS ref, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations) WHERE n BETWEEN 26 AND 50")
def ref_order_page(spark, d):
    """The second page of 25 passages in order of chapter and verse, from a corpus written in order and read again."""
    path = scratch(spark)
    src.write_passages(verses(spark, d).select("row_idx", "ref", "text", F.lit("").alias("commentary"), F.lit("").alias("arabic")), path)
    return src.page(src.read_passages(spark, path), 2, 25).select("ref", "n")


@query("SELECT CAST(doc_id AS VARCHAR) AS ref FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_refs(spark, d):
    script = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("ref"), F.lit("x").alias("text"))
    return etl.without_script(corpus(spark, d), script)


@query("SELECT CAST(d.doc_id AS VARCHAR) AS ref, md5(d.text) AS text_md5, coalesce(CAST(l.quality AS VARCHAR), '') AS arabic FROM documents d LEFT JOIN labels l USING (doc_id)")
def merged_script(spark, d):
    script = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("ref"), F.col("quality").cast("string").alias("text"))
    return etl.merge_script(corpus(spark, d), script).select("ref", F.md5("text").alias("text_md5"), "arabic")


@query("SELECT count(*) AS n_rows, count(*) FILTER (length(quality) > 0) AS with_commentary FROM (SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality FROM documents d LEFT JOIN labels l USING (doc_id))")
def build_counters(spark, d):
    q = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("commentary"))
    return src.build_counters(table(spark, d, "documents").join(q, "doc_id", "left").select(F.coalesce("commentary", F.lit("")).alias("commentary")))


@query(
    """WITH o AS (SELECT text AS opening FROM conversations ORDER BY conv_id, turn LIMIT 1), t AS (SELECT conv_id, turn, CASE WHEN turn = 1 AND conv_id <> 0 THEN opening || ' ' || text ELSE text END AS text, opening FROM conversations, o)
       SELECT CAST(conv_id AS INTEGER) AS chapter, CAST(turn AS INTEGER) AS verse, conv_id || ':' || turn AS ref,
              trim(CASE WHEN turn = 1 AND conv_id <> 1 AND starts_with(trim(text), trim(opening)) AND length(trim(opening)) > 0 THEN substr(trim(text), length(trim(opening)) + 1) ELSE text END) AS text FROM t"""
)
def flattened_translation(spark, d):
    """Verses nested by chapter, the opening put before each first verse, then flattened and cut again."""
    v = verses(spark, d)
    opening = v.orderBy("chapter", "verse").first()["text"]
    put = v.withColumn("text", F.when((F.col("verse") == 1) & (F.col("chapter") != 0), F.concat(F.lit(opening + " "), F.col("text"))).otherwise(F.col("text")))
    nested = put.groupBy(F.col("chapter").alias("number")).agg(F.collect_list(F.struct(F.col("verse").alias("numberInSurah"), "text")).alias("ayahs")).select(F.array(F.struct("number", "ayahs")).alias("surahs"))
    flat = src.flatten_translation(nested)
    return flat.select("chapter", "verse", "ref", tx.without_opening(F.col("text"), F.col("chapter"), F.col("verse"), F.lit(opening)).alias("text"))


@query("SELECT conv_id AS doc, role AS header, max(turn) AS start FROM conversations GROUP BY ALL")
def last_headers(spark, d):
    return etl.last_headers(table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("header"), F.col("turn").alias("start")))


@query(
    """WITH p AS (SELECT conv_id, turn, chr(10) || 'VERSES ' || turn || ' - ' || turn AS head, chr(10) || '[' || conv_id || ':' || turn || '] ' || translate(text, chr(10) || '[]', '   ') AS rest FROM conversations),
       s AS (SELECT *, length('T') + coalesce(sum(length(head) + length(rest)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p)
       SELECT conv_id AS position, substr(head, 2) AS header, CAST(pos AS INTEGER) AS head, CAST(pos + length(head) + 1 AS INTEGER) AS start,
              CAST(lead(pos, 1, pos + length(head) + length(rest)) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS stop, CAST(1 AS INTEGER) AS declared FROM s"""
)
def section_windows(spark, d):
    """Where the parser has each section of a text begin and end: a header and a mark for each turn of a conversation."""
    v = verses(spark, d)
    head = F.concat(F.lit("\nVERSES "), F.col("verse"), F.lit(" - "), F.col("verse"))
    rest = F.concat(F.lit("\n["), F.col("chapter"), F.lit(":"), F.col("verse"), F.lit("] "), F.translate("text", "\n[]", "   "))
    parts = v.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("verse", F.concat(head, rest).alias("t")))).alias("x"))
    return etl.section_bounds(parts.select(F.col("chapter").cast("long").alias("position"), "chapter", F.concat(F.lit("T"), F.array_join("x.t", "")).alias("text")))


@query("SELECT n_nationkey, n_name, coalesce(r_name, '') AS r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def chapter_names(spark, d):
    """Names of a small dimension by key, empty where it has none."""
    names = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return src.with_names(table(spark, d, "nation"), names, "n_regionkey", "r_name").select("n_nationkey", "n_name", "r_name")


@query("SELECT CAST(doc_id AS VARCHAR) AS ref, text AS commentary FROM documents WHERE doc_id = 17")
def commentary_lookup(spark, d):
    path = scratch(spark)
    src.CommentaryStore.build(corpus(spark, d).select("ref", F.col("text").alias("commentary")), path)
    return src.CommentaryStore(spark, path).rows("17")


@query("SELECT text AS ref, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_refs(spark, d):
    return src.duplicate_refs(table(spark, d, "documents").select(F.col("text").alias("ref")))


@query(
    """WITH v AS (SELECT conv_id AS c, turn AS v, translate(text, chr(10) || '[]', '   ') AS t FROM conversations),
       h AS (SELECT c, 'VERSES ' || min(v) || ' - ' || max(v) AS header FROM v GROUP BY c),
       x AS (SELECT c, v, trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z])\\d{1,3}($|[\\s.,;:!?''‘’")\\]])', '\\1\\2', 'g'), '([A-Za-z])\\d{1,3}($|[\\s.,;:!?''‘’")\\]])', '\\1\\2', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')), ' ([.,;:!?])', '\\1', 'g'), ' .') AS text FROM v)
       SELECT c AS position, CAST(c AS INTEGER) AS chapter, CAST(v AS INTEGER) AS verse, c || ':' || v AS ref, text, 'Commentary on all of it' AS commentary, header FROM x JOIN h USING (c)"""
)
def parsed_sections(spark, d):
    """Verses of texts made of the conversations: a header and marks for each chapter."""
    v = verses(spark, d)
    lines = v.groupBy("chapter").agg(F.array_sort(F.collect_list(F.struct("verse", F.regexp_replace("text", r"[\n\[\]]", " ").alias("t")))).alias("x"))
    body = F.array_join(F.transform("x", lambda i: F.concat(i["t"], F.lit(" ["), F.col("chapter"), F.lit(":"), i["verse"], F.lit("]"))), "\n")
    head = F.concat(F.lit("Title\nVERSES "), F.col("x")[0]["verse"], F.lit(" - "), F.element_at("x", -1)["verse"], F.lit("\n"))
    docs = lines.select(F.col("chapter").cast("long").alias("position"), "chapter", F.concat(head, body, F.lit("\nCommentary on all of it.\n")).alias("text"))
    return etl.parse_documents(docs).drop("error")


# Limiter

_EVENTS = "SELECT user_id AS k, epoch_us(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"
_LIMIT, _WINDOW = 3, 6 * 86_400
_LIMITED = f"""WITH RECURSIVE e AS ({_EVENTS}), run AS (
        SELECT k, n, ts, true AS allowed, 0::BIGINT AS retry_after, [ts] AS log FROM e WHERE n = 1
        UNION ALL
        SELECT e.k, e.n, e.ts, len(l) < {_LIMIT}, CASE WHEN len(l) < {_LIMIT} THEN 0 ELSE greatest(1, (l[1] + {_WINDOW}000000 - e.ts) // 1000000 + 1) END, CASE WHEN len(l) < {_LIMIT} THEN list_append(l, e.ts) ELSE l END
        FROM (SELECT run.k, run.n, run.log FROM run) r JOIN e ON e.k = r.k AND e.n = r.n + 1, LATERAL (SELECT list_filter(r.log, lambda x: x >= e.ts - {_WINDOW}000000) AS l)
    ) SELECT CAST(k AS VARCHAR) AS key, ts, allowed, retry_after FROM run"""


def _requests(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))


@query(_LIMITED)
def rate_limit_log(spark, d):
    return limiter.limited(_requests(spark, d), _LIMIT, _WINDOW)


@query(_LIMITED)
def rate_limit_stream(spark, d):
    """The same events as a stream; with all of them at hand, one batch."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    requests = events.select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    name = f"limited_{uuid.uuid4().hex}"
    q = limiter.limited_stream(requests, _LIMIT, _WINDOW, forget=False).writeStream.format("memory").queryName(name).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d).search(QUESTION, mode="all").select("row_idx", "ref", F.round("score", 6).alias("score"), "matched")


__all__ = ["QUERIES", "SQL", "flagship"]
