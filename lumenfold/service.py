"""The service's answers as plain functions: whoever serves them over a network only maps errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.answer import Complete, explain
from .operators.index import PassageIndex, vocabulary
from .operators.search import Retriever, response_rows
from .operators import understand
from .operators.understand import QueryUnderstanding
from .streaming.limiter import ASK_BUDGET, EXPLAIN_BUDGET, RateLimiter

# Fixed limits of a request.
QUESTION_CHARS, MOST_K, REF_CHARS = 2000, 100, 32


class Refused(Exception):
    """``status`` is the HTTP status that fits; ``retry_after`` the seconds to wait, if that helps."""

    def __init__(self, status: int, reason: str, retry_after: int = 0):
        super().__init__(reason)
        self.status, self.retry_after = status, retry_after


@dataclass
class Service:
    """``passages``: row_idx, ref, text, and optionally commentary and arabic."""

    source: str
    passages: DataFrame
    vectors: DataFrame | None = None
    embed_query: Callable[[str], list[float]] | None = None
    complete: Complete | None = None
    commentary: DataFrame | None = None
    index_path: str | None = None
    limits: dict[str, RateLimiter] = field(default_factory=lambda: {"ask": RateLimiter(*ASK_BUDGET), "explain": RateLimiter(*EXPLAIN_BUDGET)})

    def __post_init__(self) -> None:
        spark, lean = self.passages.sparkSession, self.passages.drop("commentary")
        if self.commentary is None and "commentary" in self.passages.columns:
            self.commentary = self.passages.select("ref", "commentary")
        index = PassageIndex.build(lean, self.vectors, path=self.index_path)
        self.understanding = QueryUnderstanding(spark, vocabulary(lean))
        self.retriever = Retriever(index, self.embed_query, synonyms=self.understanding.synonym_map())

    @property
    def semantic(self) -> bool:
        return self.retriever.index.vectors is not None and self.embed_query is not None

    def healthy(self) -> dict:
        return {"status": "ok"}

    def ready(self) -> dict:
        n = self.retriever.index.n_passages
        if not n:
            raise Refused(503, "the corpus is missing")
        return {"status": "ready", "passages": n}

    def info(self) -> dict:
        return {"source": self.source, "passages": self.retriever.index.n_passages, "explain_available": self.complete is not None, "semantic_available": self.semantic}

    def _spend(self, what: str, client: str) -> None:
        allowed, wait = self.limits[what].check(client)
        if not allowed:
            raise Refused(429, f"too many requests to {what}", wait)

    def _with_commentary(self) -> DataFrame | None:
        return None if self.commentary is None else self.commentary.where(F.length("commentary") > 0).select("ref")

    def ask(self, question: str, k: int = 5, mode: str = "top", exact: bool = False, client: str = "unknown") -> dict:
        """The literal query first. Only if it finds nothing, and ``exact`` isn't asked for, the corrected one; if that finds nothing either and the spelling is unclear, the choices."""
        if not 1 <= len(question) <= QUESTION_CHARS or not 1 <= k <= MOST_K:
            raise Refused(422, "question or k out of range")
        mode = mode if mode in ("top", "all") else "top"
        if self.semantic:
            self._spend("ask", client)
        meaning = self.understanding.analyse(question)
        searched, rows = question, self._rows(question, k, mode)
        if not rows and not exact and meaning.replaced:
            searched, rows = meaning.effective, self._rows(meaning.effective, k, mode)
        if not rows and not exact and meaning.unclear:
            return {"found": False, "needs_confirmation": True, "suggestions": meaning.choices, "interpretation": understand.response_of(meaning)}
        return {"found": bool(rows), "count": len(rows), "source": self.source, "searched": searched, "interpretation": understand.response_of(meaning), "results": rows}

    def _rows(self, query: str, k: int, mode: str) -> list[dict]:
        hits = self.retriever.search(query, top_k=k, mode=mode)
        return [r.asDict() for r in response_rows(hits, self._with_commentary()).orderBy(F.desc("score"), F.desc("row_idx")).drop("row_idx").collect()]

    def _passage(self, ref: str) -> DataFrame:
        """The last row of ``ref``, with its commentary."""
        if not 1 <= len(ref) <= REF_CHARS:
            raise Refused(422, "ref out of range")
        row = self.retriever.index.passages.where(F.col("ref") == ref).orderBy(F.desc("row_idx")).limit(1)
        if row.isEmpty():
            raise Refused(404, "no such passage")
        if self.commentary is None:
            return row.withColumn("commentary", F.lit(""))
        own = self.commentary.where(F.col("ref") == ref).groupBy("ref").agg(F.max("commentary").alias("commentary"))
        return row.join(own, "ref", "left").withColumn("commentary", F.coalesce("commentary", F.lit("")))

    def commentary_of(self, ref: str) -> dict:
        r = self._passage(ref).first().asDict()
        return {"ref": r["ref"], "arabic": r.get("arabic", ""), "text": r["text"], "commentary": r["commentary"]}

    def explain(self, ref: str, question: str = "", client: str = "unknown") -> dict:
        passage = self._passage(ref)
        self._spend("explain", client)
        if self.complete is None:
            raise Refused(503, "no model is set up")
        try:
            return {"ref": ref, "explanation": explain(passage, question, self.complete, self.source)}
        except TimeoutError as e:
            raise Refused(504, "the model took too long") from e
        except Exception as e:
            raise Refused(502, "the model failed") from e

