"""Grounded passage retrieval and corpus processing, expressed as Spark DataFrames.

The names below are imported when they are first used, so a worker that needs one module loads no other.
"""

from importlib import import_module

__version__ = "0.1.0"

_HOME = {
    "create_session": "session", "read_passages": "sources.passages", "write_passages": "sources.passages", "CommentaryStore": "sources.passages", "PassageIndex": "operators.index", "Retriever": "operators.search",
    "response_rows": "operators.search", "GroundedAnswerer": "operators.answer", "explain": "operators.answer", "get_model": "operators.answer", "register_provider": "operators.answer", "QueryUnderstanding": "operators.understand",
    "Reading": "operators.understand", "RateLimiter": "streaming.limiter", "limited": "streaming.limiter", "limited_stream": "streaming.limiter", "client_key": "functions.text", "spelling_key": "functions.text", "stem": "functions.text",
    "parse_documents": "operators.etl", "audit": "operators.etl", "realigned": "operators.etl", "embed_passages": "sources.passages", "Service": "service",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_HOME[name]}", __name__), name)
