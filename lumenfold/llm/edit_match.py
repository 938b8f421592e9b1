"""Benchmark decontamination by pigeonhole edit matching.

An item within ``k`` edits of a passage, cut into ``k + 1`` pieces, has one piece that the passage
holds unchanged. So every piece of every item goes into one automaton, documents are scanned for
exact hits, and around each hit Myers' bit-parallel algorithm (1999) finds the least edit distance
of the whole item to any substring of the document there.

Items are the stated query set. They are scanned in blocks of bounded size, so what each worker
holds doesn't grow with their number.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy

#: Edits allowed for each character of an item. An item under SHORTEST normalized characters allows none, and must stand between word boundaries.
RATE, SHORTEST = 0.08, 30
#: No piece is shorter. From SHORTEST characters on RATE never asks for shorter ones.
PIECE = 8
#: Characters of items in one automaton.
BLOCK = 1 << 20
_SPACES = re.compile(r"\s+")


def normal(text: str | None) -> str:
    """Lower case, each run of white space one space, trimmed."""
    return _SPACES.sub(" ", (text or "").lower()).strip()


def budget(n: int, rate: float = RATE, piece: int = PIECE, shortest: int = SHORTEST) -> int:
    return 0 if n < shortest else max(0, min(int(n * rate), n // piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length: (start, piece)."""
    ends = [len(item) * (i + 1) // (k + 1) for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip([0, *ends], ends)]


class Myers:
    """Least edit distance of ``item`` to a substring of a text, by bit vectors (Python's integers: any length)."""

    def __init__(self, item: str):
        self.n, self.peq = len(item), defaultdict(int)
        for i, c in enumerate(item):
            self.peq[c] |= 1 << i
        self.peq = dict(self.peq)

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """(distance, end) of the best match, the first of equals; None if it is over ``most``."""
        get, n = self.peq.get, self.n
        full, top = (1 << n) - 1, 1 << (n - 1)
        pv, mv, score, found = full, 0, n, None
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph <<= 1
            mh <<= 1
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv & full
            if score <= most:
                found, most = (score, j + 1), score - 1
                if not score:
                    break
        return found


class Matcher:
    """Items of one block: (item_id, normalized text)."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, piece: int = PIECE, shortest: int = SHORTEST):
        import ahocorasick

        self.items, self.shortest = [], shortest
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            k = budget(len(text), rate, piece, shortest)
            for start, p in pieces(text, k):
                found[p].append((len(self.items), start))
            self.items.append((item_id, text, k, Myers(text)))
        self.auto = ahocorasick.Automaton()
        for p, where in found.items():
            self.auto.add_word(p, (len(p), where))
        if found:
            self.auto.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of each item that ``text`` (normalized) holds; start is where its window begins."""
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if not self.items or not text:
            return []
        for last, (size, where) in self.auto.iter(text):
            at = last - size + 1
            for i, start in where:
                _, item, k, _ = self.items[i]
                if len(item) < self.shortest and (text[at - 1 : at].isalnum() and item[0].isalnum() or text[last + 1 : last + 2].isalnum() and item[-1].isalnum()):
                    continue
                a, b = max(0, at - start - k), min(len(text), at - start + len(item) + k)
                own = spans[i]
                if own and a <= own[-1][1]:  # hits come in order, so windows of an item merge as they come
                    own[-1] = (min(own[-1][0], a), max(own[-1][1], b))
                else:
                    own.append((a, b))
        out = []
        for i, windows in spans.items():
            item_id, item, k, myers = self.items[i]
            best = None
            for a, b in windows:
                if (hit := myers.best(text[a:b], k if best is None else best[0] - 1)) is not None:
                    end = a + hit[1]
                    best = (hit[0], max(0, end - len(item)), end)
                    if not hit[0]:
                        break
            if best:
                out.append((item_id, *best))
        return out


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> list[list[tuple[int, str]]]:
    """Distinct normalized items in blocks of at most ``block`` characters (an item that is longer is alone).

    Null and empty items hold nothing to find and are left out. Items come to the driver one
    partition at a time; of equal texts each item_id is kept.
    """
    out: list[list[tuple[int, str]]] = []
    size = block
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        text = normal(r["text"])
        if not text:
            continue
        if size + len(text) > block:
            out.append([])
            size = 0
        out[-1].append((r["item_id"], text))
        size += len(text)
    return out


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(name: str, items: list[tuple[int, str]], rate: float, piece: int, shortest: int) -> Matcher:
    """The matcher of a block, made once in each Python worker; ``name`` tells blocks apart, and the last one is kept."""
    key = (name, rate, piece, shortest)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(items, rate, piece, shortest)
    return _MATCHERS[key]


HIT = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("match_start", pa.int64()), ("match_end", pa.int64())])
HITS_DDL = "array<struct<item_id: bigint, distance: int, match_start: bigint, match_end: bigint>>"


def with_hits(docs: DataFrame, items: list[tuple[int, str]], rate: float = RATE, piece: int = PIECE, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with a column ``_hits``: for each row the items of this block that its text holds."""
    shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK characters
    names, name = docs.columns, uuid.uuid4().hex
    at = names.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(name, shared.value, rate, piece, shortest)
        for b in batches:
            hits = [[dict(zip(("item_id", "distance", "match_start", "match_end"), h, strict=True)) for h in m.matches(normal(t.as_py()))] for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(HIT))], names=[*names, "_hits"])

    return docs.mapInArrow(tidy(run), f"{fields}, `_hits` {HITS_DDL}")


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, piece: int = PIECE, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that it holds.

    doc_id, item_id, distance (least edits), match_end and match_start (in the normalized text: the
    end of the best match, and the item's length before it), item_chars. An item of n characters
    allows ``rate`` * n edits, fewer if pieces would be under ``piece`` characters; one of under
    ``shortest`` allows none, and no letter or digit may go on at its ends. Null and empty texts hold
    nothing, very long ones are scanned whole; repeated rows are each reported; extra columns are
    ignored. No documents or no items give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = []
    for items in item_blocks(benchmark, block):
        lengths = docs.sparkSession.createDataFrame([(i, len(t)) for i, t in items], "item_id long, item_chars int").distinct()
        hits = with_hits(rows, items, rate, piece, shortest).where(F.size("_hits") > 0).select("doc_id", F.explode("_hits").alias("h")).select("doc_id", "h.*")
        parts.append(hits.join(F.broadcast(lengths.groupBy("item_id").agg(F.max("item_chars").alias("item_chars"))), "item_id"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, match_start long, match_end long, item_chars int")
    return reduce(DataFrame.unionByName, parts).select("doc_id", "item_id", "distance", "match_start", "match_end", "item_chars")


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, piece: int = PIECE, shortest: int = SHORTEST, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, with all their columns. Blocks filter one after another; nothing is shuffled."""
    names = docs.columns
    for items in item_blocks(benchmark, block):
        inner = docs.select(F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
        docs = with_hits(inner, items, rate, piece, shortest).where(F.size("_hits") == 0).select("_row.*")
    return docs


def decontamination_query(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``contaminated`` over all of both tables, with the module's parameters."""
    return contaminated(docs, benchmark)
