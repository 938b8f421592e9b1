"""Completion and embedding services over an injected transport.

``Post`` sends a JSON body to a URL with headers and gives the decoded JSON reply; the engine holds no
network code. A client is a plain callable, so it goes wherever a ``complete`` or ``embed`` function does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators.answer import ANSWER_TOKENS

Post = Callable[[str, dict, dict, float], dict]

# Time limits of calls.
CHAT_SECONDS, QUERY_SECONDS, BATCH_SECONDS = 60.0, 30.0, 120.0


class BadReply(ValueError):
    """A service's reply doesn't have the agreed shape."""


@dataclass(frozen=True)
class Endpoint:
    """Where and how a service is called. ``headers``: name to value, the key among them."""

    post: Post
    url: str
    model: str
    headers: dict[str, str] = field(default_factory=dict)

    def call(self, body: dict, seconds: float) -> dict:
        return self.post(self.url, self.headers, {"model": self.model, **body}, seconds)


def _at(reply: object, *path: str | int) -> object:
    for step in path:
        try:
            reply = reply[step]  # type: ignore[index]
        except (KeyError, IndexError, TypeError) as e:
            raise BadReply(f"the reply has no {'.'.join(map(str, path))}") from e
    return reply


@dataclass(frozen=True)
class ChatCompletion:
    """A model for ``GroundedAnswerer`` and ``explain``, by a service that takes the instruction as the first message and replies with choices."""

    endpoint: Endpoint

    def __call__(self, system: str, user: str, *, max_tokens: int = ANSWER_TOKENS) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        return str(_at(self.endpoint.call({"messages": messages, "max_tokens": max_tokens}, CHAT_SECONDS), "choices", 0, "message", "content")).strip()


@dataclass(frozen=True)
class BlockCompletion:
    """The same by a service that takes the instruction apart and replies with blocks, of which those of text count."""

    endpoint: Endpoint

    def __call__(self, system: str, user: str, *, max_tokens: int = ANSWER_TOKENS) -> str:
        reply = self.endpoint.call({"system": system, "messages": [{"role": "user", "content": user}], "max_tokens": max_tokens}, CHAT_SECONDS)
        return "".join(str(b.get("text", "")) for b in _at(reply, "content") if b.get("type") == "text").strip()


@dataclass(frozen=True)
class Embeddings:
    """``embed(texts)``: vectors in the order of the texts, whatever the order of the reply. ``kind`` is "query" or "passage"."""

    endpoint: Endpoint
    kind: str = "passage"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        reply = self.endpoint.call({"input": list(texts), "input_type": self.kind, "truncate": "END"}, QUERY_SECONDS if self.kind == "query" else BATCH_SECONDS)
        by_place = {_at(row, "index"): _at(row, "embedding") for row in _at(reply, "data")}
        if sorted(by_place) != list(range(len(texts))):
            raise BadReply(f"{len(by_place)} vectors for {len(texts)} texts")
        return [list(map(float, by_place[i])) for i in range(len(texts))]

    def one(self, text: str) -> list[float]:
        """The vector of one query, for ``Retriever``."""
        return self([text])[0]
