"""Answers from passages only: verbatim with citations, or composed by a model that sees nothing else."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import within_budget
from .search import TOP_K, Retriever

Complete = Callable[..., str]
#: Sizes of completions.
ANSWER_TOKENS, EXPLAIN_TOKENS = 600, 1200


@dataclass
class Answer:
    found: bool
    text: str
    citations: list[Row] = field(default_factory=list)


def decline(source: str) -> str:
    # Fixed format.
    return f"This topic does not appear to be addressed in {source}."


def grounding_prompt(source: str) -> str:
    return (
        f"Answer from {source} alone. Below are numbered passages of it. Use only what they say, add no knowledge or reading of your own, "
        f"and put the reference, as [2:255], after each statement. If they don't address the question, say so."
    )


def explaining_prompt(source: str) -> str:
    return (
        f"Explain one verse of {source} from its commentary. Begin with its plain meaning, then the context and connections that the commentary gives, "
        f"name verses and reports that it refers to as [2:255], and come back to the reader's question if there is one. Use only the commentary given; "
        f"if it is thin or missing, say so."
    )


def cited(ref: Column, text: Column) -> Column:
    # Fixed format.
    return F.concat(F.lit("["), ref, F.lit("] "), text)


def joined_passages(hits: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One row: text, all passages of ``hits`` (row_idx, ref, text, score) in rank order, and sources, their refs."""
    item = F.struct((-F.col("score")).alias("a"), (-F.col("row_idx")).alias("b"), cited(F.col("ref"), F.col("text")).alias("t"), F.concat(F.lit("["), F.col("ref"), F.lit("]")).alias("r"))
    all_ = F.array_sort(F.collect_list(item))
    return hits.agg(all_.alias("x")).select(F.array_join(F.transform("x", lambda i: i["t"]), separator).alias("text"), F.array_join(F.transform("x", lambda i: i["r"]), ", ").alias("sources"), F.size("x").alias("n_citations"))


def answer_row(hits: DataFrame, source: str) -> DataFrame:
    """One row: found, text, sources, n_citations; the fixed sentence if there are no hits."""
    one = joined_passages(hits)
    found = F.col("n_citations") > 0
    return one.select(found.alias("found"), F.when(found, F.col("text")).otherwise(decline(source)).alias("text"), "sources", "n_citations")


class GroundedAnswerer:
    def __init__(self, retriever: Retriever, source: str, complete: Complete | None = None):
        self.retriever, self.source, self.complete = retriever, source, complete

    def ask(self, question: str, top_k: int = TOP_K, compose: bool = False) -> Answer:
        """The passages, or with ``compose`` and a model, its text about them; either way with the passages as citations."""
        hits = self.retriever.search(question, top_k=top_k).collect()  # top_k rows
        if not hits:
            return Answer(False, decline(self.source))
        lines = [f"[{h['ref']}] {h['text']}" for h in hits]
        if compose and self.complete is not None:
            user = "Question: {}\n\nPassages from {}:\n{}".format(question, self.source, "\n".join(lines))
            return Answer(True, self.complete(grounding_prompt(self.source), user, max_tokens=ANSWER_TOKENS), hits)
        return Answer(True, "\n\n".join(lines), hits)


def explanation_prompts(passages: DataFrame, question: str = "") -> DataFrame:
    """(ref, prompt) for the explanation of each passage (ref, text, commentary)."""
    # Fixed format.
    prompt = F.concat(F.lit("Verse ["), F.col("ref"), F.lit("]: "), F.col("text"), F.lit("\n\nCommentary:\n"), within_budget(F.col("commentary")), F.lit(f"\n\nReader's original question: {question or '(none given)'}"))
    return passages.select("ref", prompt.alias("prompt"))


def explain(passage: DataFrame, question: str, complete: Complete, source: str) -> str:
    """A model's explanation of the one row of ``passage``."""
    row = explanation_prompts(passage, question).first()
    if row is None:
        raise LookupError("no such passage")
    return complete(explaining_prompt(source), row["prompt"], max_tokens=EXPLAIN_TOKENS)


class MockModel:
    """A model for tests: ``fn(system, user)``, or the user's prompt itself."""

    def __init__(self, fn: Callable[[str, str], str] | None = None):
        self.fn = fn or (lambda system, user: user)

    def __call__(self, system: str, user: str, *, max_tokens: int = ANSWER_TOKENS) -> str:
        return self.fn(system, user)


#: name -> factory(api_key, model). Networks are the caller's: register a factory for a provider.
PROVIDERS: dict[str, Callable[[str | None, str | None], Complete]] = {"mock": lambda key, model: MockModel()}


def register_provider(name: str, factory: Callable[[str, str | None], Complete]) -> None:
    """``factory`` gets a key, which must be given, and a model's name or None."""

    def checked(key: str | None, model: str | None) -> Complete:
        if not key:
            raise ValueError(f"provider {name!r} needs an API key")
        return factory(key, model)

    PROVIDERS[name] = checked


def get_model(name: str = "mock", api_key: str | None = None, model: str | None = None) -> Complete:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](api_key, model)
