"""A gated recurrent language model with class-factored output, and a smoothed unigram base.

Counts of all training words are one distributed table. Its most frequent words are the network's
vocabulary, in classes of CLASS words by rank; all other words belong to a few tail classes by their
last byte, and share the tail's probability by their counts plus one. The network gives a class,
then a word within it.

Every row is turned into symbols once. The network starts from the unigram law and learns from every
symbol of every training row by truncated backpropagation in numpy: in each round tasks start from
the same weights, each learns from its own rows, and their weights are averaged. A document is
scored in windows that hand the state on, so its likelihood is that of the complete text.

Arrays of states have a row for each unit and a column for each document, so that what is done for
all documents runs along memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_memory, scratch, stored, tidy

#: Words of a class, number of classes (the network's vocabulary is their product, end included), hidden units.
CLASS, CLASSES, HIDDEN = 128, 32, 24
#: Words whose counts each worker holds at most; the others meet theirs in a join.
FREQUENT = 131_072
#: Steps of truncated backpropagation, and of a scoring window; documents scored side by side.
STEPS, WINDOW, LANES = 32, 64, 512
#: Symbols of documents that are scored together; the batch that reaches it is the last.
AT_ONCE = 6_000_000
#: Rows of logits that are worked on together.
ROWS = 1024
#: Tenths of the training rows that each round deals out, each row in one; streams trained side by side; symbols that are laid out at once; rate of the first round.
ROUNDS, TRAIN_LANES, BLOCK, RATE = (1, 2, 3, 4), 256, 1 << 20, 0.01
TAILS = 4
VOCABULARY = CLASS * CLASSES
END = 0


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts`` as bytes, lower-cased in A-Z, and how many each text has. Nulls are empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, per_text = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    # White space at either end gives an empty word there.
    full = pc.not_equal(words, "")
    if not pc.all(full, min_count=0).as_py():
        owner = np.repeat(np.arange(len(per_text)), per_text)[full.to_numpy(zero_copy_only=False)]
        words, per_text = words.filter(full), np.bincount(owner, minlength=len(per_text))
    return words.cast(pa.binary()), per_text


def tails_of(words: pa.Array) -> np.ndarray:
    """Tail class of each of ``words`` (bytes, none empty) by its last byte: letter, full stop, comma, other."""
    if not len(words):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    last = np.frombuffer(words.buffers()[2], np.uint8)[offsets[1:].astype(np.int64) - 1]
    return np.select([(last >= 97) & (last <= 122) | (last >= 128), last == 46, last == 44], [0, 1, 2], 3)


def _tail_column() -> Column:
    last = F.hex(F.substring("word", -1, 1))
    return F.when(((last >= "61") & (last <= "7A")) | (last >= "80"), 0).when(last == "2E", 1).when(last == "2C", 2).otherwise(3)


def held_out() -> Column:
    """Whether the CRC-32 of doc_id as text leaves 2 when divided by 7; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting, n = [], 0

    def flush() -> pa.RecordBatch:
        counts = pa.chunked_array(waiting, pa.binary()).value_counts()
        return pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["word", "c"])

    for b in batches:
        words, _ = split_words(b.column(0))
        waiting.append(words)
        n += len(words)
        if n >= 3_000_000:
            yield flush()
            waiting, n = [], 0
    yield flush()


@dataclass
class Statistics:
    """Of training tokens: N, V (end included), documents; counts of frequent words; sums of the tail classes."""

    tokens: int
    kinds: int
    documents: int
    frequent: dict[bytes, int]
    tail_tokens: list[int]
    tail_kinds: list[int]


def count_words(docs: DataFrame, path: str) -> tuple[DataFrame, Statistics]:
    """The table of all training words (word: binary, c), and what the model keeps of it.

    The driver gets a histogram of the counts on a scale of sixteenths of a doubling, and the words
    above a cut that at most FREQUENT words reach.
    """
    train = docs.where(~held_out())
    counts = stored(train.select("text").mapInArrow(tidy(_count), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), f"{path}/counts")
    documents = train.count()
    level = F.floor(F.log2("c") * 16).cast("int")
    sums = counts.groupBy(_tail_column().alias("tail"), level.alias("level")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    tokens, kinds = [sum(r["c"] for r in sums if r["tail"] == t) for t in range(TAILS)], [sum(r["n"] for r in sums if r["tail"] == t) for t in range(TAILS)]
    cut, held = None, 0
    for at in sorted({r["level"] for r in sums}, reverse=True):
        held += sum(r["n"] for r in sums if r["level"] == at)
        if held > FREQUENT:
            break
        cut = at
    top = [] if cut is None else counts.where(level >= cut).collect()
    frequent = {bytes(r["word"]): r["c"] for r in sorted(top, key=lambda r: (-r["c"], bytes(r["word"])))}
    stats = Statistics(sum(tokens) + documents, sum(kinds) + bool(documents), documents, frequent, tokens, kinds)
    named = list(vocabulary(stats))
    for w, t in zip(named, tails_of(pa.array(named, pa.binary())).tolist(), strict=True):
        stats.tail_tokens[t] -= frequent[w]
        stats.tail_kinds[t] -= 1
    return counts, stats


def vocabulary(stats: Statistics) -> dict[bytes, int]:
    return {w: i + 1 for i, w in enumerate(list(stats.frequent)[: VOCABULARY - 1])}


@dataclass
class Network:
    """inputs: vector of each symbol (words, then tails); w and u: gate weights of input and state; wc, bc, wv, bv: output weights and biases of classes and words."""

    inputs: np.ndarray
    w: np.ndarray
    u: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    wv: np.ndarray
    bv: np.ndarray
    moments: dict = field(default_factory=dict)

    @staticmethod
    def fresh(counts: np.ndarray, tails: np.ndarray, hidden: int = HIDDEN, seed: int = 11) -> Network:
        """Biases at the unigram law of ``counts`` (VOCABULARY) and ``tails``, so that training starts from it."""
        rng = np.random.default_rng(seed)
        c = (counts + 1.0).reshape(CLASSES, CLASS)
        mass = np.concatenate([c.sum(1), tails + 1.0])
        gates = lambda: (rng.normal(0, 1, (3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        return Network(
            rng.normal(0, 0.3, (VOCABULARY + TAILS, hidden)).astype(np.float32), gates(), gates(), np.zeros((CLASSES + TAILS, hidden), np.float32), np.log(mass / mass.sum()).astype(np.float32),
            np.zeros((CLASSES, CLASS, hidden), np.float32), np.log(c / c.sum(1, keepdims=True)).astype(np.float32),
        )

    @staticmethod
    def of(stats: Statistics) -> Network:
        counts = np.zeros(VOCABULARY)
        counts[END] = stats.documents
        for w, i in vocabulary(stats).items():
            counts[i] = stats.frequent[w]
        return Network.fresh(counts, np.array(stats.tail_tokens, float))

    @property
    def hidden(self) -> int:
        return self.u.shape[1]

    def halved(self) -> tuple[np.ndarray, np.ndarray]:
        """w and u as ``step`` takes them: with half of the rows of the sigmoid gates, since a sigmoid is a tanh of half its argument."""
        half = np.where(np.arange(3 * self.hidden) < 2 * self.hidden, 0.5, 1).astype(self.u.dtype)[:, None]
        return self.w * half, self.u * half

    @staticmethod
    def step(h: np.ndarray, gx: np.ndarray, u: np.ndarray, out: np.ndarray | None = None, tape: list | None = None) -> np.ndarray:
        """States (units x lanes) after one symbol of each lane; ``gx`` is w @ inputs of it, w and ``u`` those of ``halved``."""
        k = len(h)
        g = u @ h
        zr = g[: 2 * k]
        zr += gx[: 2 * k]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        n = zr[k:] * g[2 * k :]
        n += gx[2 * k :]
        np.tanh(n, out=n)
        if tape is not None:
            tape.append((zr, n, g[2 * k :]))
        out = np.subtract(h, n, out=out)
        out *= zr[:k]
        out += n
        return out

    @staticmethod
    def _softmax(h: np.ndarray, own: np.ndarray, spans: list[tuple[int, int, int]], w: np.ndarray, bias: np.ndarray, out: np.ndarray, n: int, grads: tuple | None) -> None:
        """Adds to ``out`` the log of the softmax of w[c] @ row + bias[c] at kind ``own`` % kinds, for the rows of ``h`` in each span (start, end, c).

        Spans lie end to end; ``own`` counts the kinds of all c on. With ``grads``: also puts there
        gradients of weights and biases, zero so far, and adds to those of states, a share of ``n`` each.
        Spans go together through one buffer that stays in a core's cache. Biases aren't added to each
        logit: exp of them scales the small factors of the products, unless they are too large for it.
        """
        kinds, k = w.shape[1:]
        buffer, back = np.empty(ROWS * kinds, h.dtype), np.empty((ROWS, k), h.dtype)
        wide = np.abs(bias).max() > 20
        scale = np.ones_like(bias) if wide else np.exp(bias)
        out += np.take(bias, own)
        if grads is not None:
            dw, db, dh = grads
            scaled = w * scale[..., None]
        groups: list[list[tuple[int, int, int]]] = []
        for start, end, c in spans:
            for a in range(start, end, ROWS):
                b = min(a + ROWS, end)
                if not groups or b - groups[-1][0][0] > ROWS:
                    groups.append([])
                groups[-1].append((a, b, c))
        for group in groups:
            a, b = group[0][0], group[-1][1]
            flat, at = buffer[: (b - a) * kinds], np.arange(0, (b - a) * kinds, kinds) + own[a:b] % kinds
            e, total = flat.reshape(b - a, kinds), np.empty(b - a, h.dtype)
            for x, y, c in group:
                np.matmul(h[x:y], w[c].T, out=e[x - a : y - a])
                if wide:
                    e[x - a : y - a] += bias[c]
            mine = flat[at]
            if wide:
                mine -= np.take(bias, own[a:b])
            out[a:b] += mine
            if e.max() > 30:
                top = e.max(1)
                e -= top[:, None]
                out[a:b] -= top
            np.exp(e, out=e)
            for x, y, c in group:
                np.matmul(e[x - a : y - a], scale[c], out=total[x - a : y - a])
            out[a:b] -= np.log(total)
            if grads is None:
                continue
            flat[at] -= total / np.take(scale, own[a:b])
            share = 1 / (total * n)
            rows = h[a:b] * share[:, None]
            for x, y, c in group:
                x, y = x - a, y - a
                dw[c] += e[x:y].T @ rows[x:y]
                db[c] += share[x:y] @ e[x:y]
                np.matmul(e[x:y], scaled[c], out=back[x:y])
            dh[a:b] += back[: b - a] * share[:, None]
        if grads is not None:
            dw *= scale[..., None]
            db *= scale

    def log_likelihood(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> np.ndarray:
        """Natural log probabilities of target symbols after ``states`` (units x targets). With ``grads``: also puts there the gradients of their mean's negative, those of the states as "h"."""
        n = len(targets)
        order = np.argsort(targets.astype(np.uint16 if VOCABULARY + TAILS <= 1 << 16 else np.int64), kind="stable")
        t = targets[order].astype(np.int64)
        kind = np.where(t < VOCABULARY, t // CLASS, CLASSES + t - VOCABULARY)
        h, out = np.take(states.T, order, axis=0), np.zeros(n)
        bounds = np.searchsorted(t, np.arange(CLASSES + 1) * CLASS).tolist()
        words = slice(0, bounds[-1])
        spans = [(a, b, c) for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if a < b]
        dc = dv = None
        if grads is not None:
            grads |= {name: np.zeros_like(getattr(self, name)) for name in ("wc", "bc", "wv", "bv")} | {"h": np.zeros_like(h)}
            dc, dv = (grads["wc"][None], grads["bc"][None], grads["h"]), (grads["wv"], grads["bv"], grads["h"])
        self._softmax(h, kind, [(0, n, 0)], self.wc[None], self.bc[None], out, n, dc)
        self._softmax(h[words], t[words], spans, self.wv, self.bv, out[words], n, dv)
        back = np.empty_like(out)
        back[order] = out
        if grads is not None:
            dh = np.empty_like(h)
            dh[order] = grads["h"]
            grads["h"] = dh.T
        return back

    def train_window(self, h: np.ndarray, symbols: np.ndarray, targets: np.ndarray, first: np.ndarray, rate: float) -> tuple[np.ndarray, float]:
        """One update over a window (steps x lanes); ``first`` marks inputs that begin a document and so a state of zeros."""
        steps, lanes = symbols.shape
        k, flat, begins = self.hidden, symbols.ravel(), [np.flatnonzero(f) for f in first]
        own = np.take(self.inputs, flat, axis=0).reshape(steps, lanes, k)
        # What a step reads and writes lies together.
        w, u = self.halved()
        gx = w @ own.transpose(0, 2, 1)
        tape: list = []
        hs, states = np.empty((steps + 1, k, lanes), h.dtype), np.empty((steps, lanes, k), h.dtype)
        hs[0] = h
        for t in range(steps):
            if len(begins[t]):
                hs[t][:, begins[t]] = 0
            states[t] = self.step(hs[t], gx[t], u, hs[t + 1], tape).T
        grads: dict = {}
        loss = -self.log_likelihood(states.reshape(-1, k).T, targets.ravel(), grads).mean()
        dout = grads.pop("h").T.reshape(steps, lanes, k)
        # By step: slopes of the candidate's part that the state has, of both gates, and of the candidate. The first three are those of u, the last three those of w.
        slopes, turned = np.empty((steps, 4 * k, lanes), gx.dtype), np.concatenate([self.u[2 * k :], self.u[: 2 * k]]).T
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            (zr, n, g), s = tape[t], slopes[t]
            d = np.add(dh, dout[t].T, order="C")
            rest = 1 - zr
            dn = np.multiply(rest[:k], d, out=s[3 * k :])
            bend = n * n
            np.subtract(1, bend, out=bend)
            dn *= bend
            np.multiply(dn, zr[k:], out=s[:k])
            np.multiply(dn, g, out=s[2 * k : 3 * k])
            dz = np.subtract(hs[t], n, out=s[k : 2 * k])
            dz *= d
            rest *= zr
            s[k : 3 * k] *= rest
            dh = turned @ s[: 3 * k]
            d *= zr[:k]
            dh += d
            if len(begins[t]):
                dh[:, begins[t]] = 0
        du, dx = (slopes[:, : 3 * k] @ hs[:-1].transpose(0, 2, 1)).sum(0), slopes[:, k:]
        grads |= {"u": np.concatenate([du[k:], du[:k]]), "w": (dx @ own).sum(0), "inputs": np.zeros_like(self.inputs)}
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        at = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
        grads["inputs"][ordered[at]] = np.add.reduceat(np.take((dx.transpose(0, 2, 1) @ self.w).reshape(-1, k), order, axis=0), at, axis=0)
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        self._adam(grads, rate / norm if norm > 1 else rate)
        return hs[-1], float(loss)

    def _adam(self, grads: dict, rate: float) -> None:
        t = self.moments["t"] = self.moments.get("t", 0) + 1
        scale = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for name, g in grads.items():
            # Ten times the mean of gradients, a hundred times that of their squares.
            m, v = self.moments.setdefault(name, (np.zeros(g.size, g.dtype), np.zeros(g.size, g.dtype)))
            g, own = g.reshape(-1), getattr(self, name).reshape(-1)
            for a in range(0, g.size, 1 << 14):  # each piece stays in a core's cache
                part, mean, square = g[a : a + (1 << 14)], m[a : a + (1 << 14)], v[a : a + (1 << 14)]
                mean *= 0.9
                mean += part
                square *= 0.99
                part *= part
                square += part
                np.sqrt(square, out=part)
                part += 1e-7
                np.divide(mean, part, out=part)
                part *= scale
                own[a : a + (1 << 14)] -= part

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each symbol stream, whose end is its only END: windows of steps, the state carried on.

        Documents are dealt to lanes of about equal length, one after another, so many go side by side
        to the end.
        """
        out = np.zeros(len(texts))
        if not texts:
            return out
        # Longest first, each to the lane with least to do.
        lanes = [(0, i) for i in range(min(LANES, len(texts)))]
        dealt: list[list[int]] = [[] for _ in lanes]
        for j in np.argsort([-len(x) for x in texts], kind="stable").tolist():
            size, i = lanes[0]
            dealt[i].append(j)
            heapq.heapreplace(lanes, (size + len(texts[j]), i))
        sizes = np.zeros(len(dealt), np.int64)
        for size, i in lanes:
            sizes[i] = size
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        names = np.array([j for i in order for j in dealt[i]])
        at_doc = np.concatenate([[0], np.cumsum([len(dealt[i]) for i in order])[:-1]]) - 1  # the document that each lane is in
        streams = [np.concatenate([texts[j] for j in dealt[i]]) for i in order]
        h, before, sums = np.zeros((self.hidden, len(order)), np.float32), np.full(len(order), END), np.zeros(len(texts))
        w, u = self.halved()
        room = np.empty((2, WINDOW * len(order), self.hidden), np.float32)
        for at in range(0, int(sizes[0]), WINDOW):
            live, steps = int((sizes > at).sum()), min(WINDOW, int(sizes[0]) - at)
            block = np.zeros((steps, live), np.int32)
            for j in range(live):
                part = streams[j][at : at + steps]
                block[: len(part), j] = part
            inputs = np.concatenate([before[None, :live], block[:-1]])
            first = inputs == END
            on = at + np.arange(steps)[:, None] < sizes[None, :live]  # a prefix of the lanes at every step
            first &= on
            docs = at_doc[:live] + np.cumsum(first, 0)
            bounds = np.concatenate([[0], np.cumsum(on.sum(1))])
            own, states = room[:, : bounds[-1]]
            np.take(self.inputs, inputs[on], axis=0, out=own, mode="clip")
            for t in range(steps):
                a, b = bounds[t], bounds[t + 1]
                h = h[:, : b - a]
                if len(begins := np.flatnonzero(first[t])):
                    h[:, begins] = 0
                h = self.step(h, w @ own[a:b].T, u)
                states[a:b] = h.T
            before, at_doc = block[-1], docs[-1]
            sums += np.bincount(docs[on], self.log_likelihood(states.T, block[on]), len(texts))
        out[names] = sums
        return out


_WEIGHTS = ("inputs", "w", "u", "wc", "bc", "wv", "bv")


def learn(net: Network, streams: Iterator[np.ndarray], rate: float, lanes: int = TRAIN_LANES) -> int:
    """One pass of ``net`` over ``streams``, symbols of whole documents with their ends; returns their number.

    About BLOCK symbols at a time are cut into ``lanes`` parts of equal length that are read side by
    side, from window to window. What doesn't fill them up waits for the next block; the last block is
    filled up from its own start. A part that begins inside a document starts from a state of zeros.
    """
    seen, waiting, size = 0, [], 0

    def run(stream: np.ndarray, before: int, lanes: int) -> None:
        steps = len(stream) // lanes
        target = stream.reshape(lanes, steps).T
        symbols = np.concatenate([np.array([before], stream.dtype), stream[:-1]]).reshape(lanes, steps).T
        first = symbols == END
        h = np.zeros((net.hidden, lanes), np.float32)
        for at in range(0, steps, STEPS):
            h, _ = net.train_window(h, symbols[at : at + STEPS], target[at : at + STEPS], first[at : at + STEPS], rate)

    before = END
    for s in streams:
        waiting.append(s)
        size += len(s)
        seen += len(s)
        if size >= BLOCK:
            whole = np.concatenate(waiting)
            n = size // lanes * lanes
            run(whole[:n], before, lanes)
            before, waiting, size = int(whole[n - 1]), [whole[n:]], size - n
    if size:
        lanes = max(1, min(lanes, size // STEPS))
        run(np.resize(np.concatenate(waiting), -(-size // lanes) * lanes), before, lanes)
    net.moments = {}
    return seen


_SUM = pa.schema([("symbols", pa.int64()), ("weights", pa.binary())])


def _sum_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    symbols, total = 0, None
    for b in batches:
        for n, w in zip(b.column(0), b.column(1), strict=True):
            w = np.frombuffer(w.as_buffer(), np.float64)
            symbols, total = symbols + n.as_py(), w.copy() if total is None else total + w
    if total is not None:
        yield pa.RecordBatch.from_pydict({"symbols": [symbols], "weights": [total.tobytes()]}, schema=_SUM)


def _streams(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for b in batches:
        for s in b.column(column):
            yield np.frombuffer(s.as_buffer(), np.uint16)


def learn_rows(encoded: DataFrame, net: Network, path: str) -> int:
    """Trains ``net`` on all training rows of ``encoded``, and returns the number of symbols learned.

    In each round tasks start from the same weights, each learns from its own rows, and the mean of
    their weights, by symbols learned, is the next start. Weights are summed in steps, so few of them
    reach the driver at any number of tasks.
    """
    spark, seen, dealt = encoded.sparkSession, 0, 0
    place = F.pmod(F.xxhash64("rid", "n_tokens"), F.lit(sum(ROUNDS)))
    for i, share in enumerate(ROUNDS):
        shared = spark.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=RATE / (1 + i)) -> Iterator[pa.RecordBatch]:
            keep_memory()
            own = Network(*(getattr(shared.value, k).copy() for k in _WEIGHTS))
            n = learn(own, _streams(batches), rate)
            if n:
                weights = np.concatenate([getattr(own, k).ravel() for k in _WEIGHTS]).astype(np.float64) * n
                yield pa.RecordBatch.from_pydict({"symbols": [n], "weights": [weights.tobytes()]}, schema=_SUM)

        rows = encoded.where(~F.col("held_out") & (place >= dealt) & (place < dealt + share)).select("symbols")
        sums = stored(rows.mapInArrow(tidy(run), "symbols long, weights binary"), f"{path}/weights{i}")
        dealt += share
        left = sums.count()
        while left > 16:
            left = int(np.ceil(np.sqrt(left)))
            sums = sums.repartition(left).mapInArrow(tidy(_sum_of), "symbols long, weights binary")
        parts = sums.collect()  # 16 at most
        n, at = sum(p["symbols"] for p in parts), 0
        if n:
            mean = sum(np.frombuffer(p["weights"], np.float64) for p in parts) / n
            for k in _WEIGHTS:
                old = getattr(net, k)
                setattr(net, k, mean[at : at + old.size].reshape(old.shape).astype(np.float32))
                at += old.size
        seen += n
    return seen


_RARE = pa.struct([("word", pa.binary()), ("times", pa.int64())])
_ENCODED_DDL = "doc_id long, rid long, held_out boolean, n_tokens long, n_known long, base double, tail double, symbols binary, rare array<struct<word: binary, times: bigint>>"
_SCORED_DDL = "doc_id long, rid long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _encode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = shared.value
        frequent = pa.array(list(stats.frequent), pa.binary())
        logs = np.log10(np.array([stats.documents, *stats.frequent.values()], float) + 1)  # by index; the end first
        tail_log = np.log10(np.array(stats.tail_tokens, float) + np.array(stats.tail_kinds, float) + 1)
        total_log, known_end = np.log10(stats.tokens + stats.kinds + 1.0), int(stats.documents > 0)
        for b in batches:
            every, n = split_words(b.column(3))
            coded = every.dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            found = pc.fill_null(pc.index_in(words, value_set=frequent), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1  # 0: not frequent
            named = (found > 0) & (found < VOCABULARY)
            kind = tails_of(words)
            symbol = np.where(named, found, VOCABULARY + kind).astype(np.uint16)
            log = np.where(found > 0, logs[found], 0.0)
            far = np.where(named, 0.0, log - tail_log[kind])
            ends = np.cumsum(n)
            owner = np.repeat(np.arange(len(n)), n)
            total = lambda per_word, owner=owner, codes=codes, n=n: np.bincount(owner, per_word[codes], len(n))
            symbols = np.insert(symbol[codes], ends, END).astype("<u2")
            bounds = (2 * np.concatenate([[0], ends + np.arange(1, len(n) + 1)])).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(symbols.tobytes())])
            rare = np.flatnonzero((found == 0)[codes])
            pair, times = np.unique(owner[rare] * np.int64(max(len(words), 1)) + codes[rare], return_counts=True)
            offsets = np.searchsorted(pair // max(len(words), 1), np.arange(len(n) + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([words.take(pa.array(pair % max(len(words), 1))), pa.array(times, pa.int64())], fields=list(_RARE))
            columns = [
                b.column(0), b.column(1), b.column(2), pa.array(n + 1, pa.int64()), pa.array((total((found > 0).astype(float)) + known_end).astype(np.int64)),
                pa.array(total(log) + logs[END] - (n + 1) * total_log), pa.array(total(far)), packed, pa.ListArray.from_arrays(pa.array(offsets), values),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "held_out", "n_tokens", "n_known", "base", "tail", "symbols", "rare"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        net = shared.value

        def flush(rows: list[pa.RecordBatch], streams: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nat, at = net.score(streams) / np.log(10), 0
            for b in rows:
                score = nat[at : at + len(b)] + b.column(6).to_numpy()
                at += len(b)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(score)], names=["doc_id", "rid", "held_out", "n_tokens", "n_known", "base", "score"])

        rows, streams, size = [], [], 0
        for b in batches:
            rows.append(b)
            streams += _streams([b], 7)
            size += sum(map(len, streams[-len(b) :])) if len(b) else 0
            if size >= AT_ONCE:
                yield from flush(rows, streams)
                rows, streams, size = [], [], 0
        yield from flush(rows, streams)

    return run


def trained(rows: DataFrame, path: str) -> tuple[DataFrame, Statistics, DataFrame, Network]:
    """From ``rows`` (doc_id, text): the table of training words, its statistics, all rows as symbols, and the network."""
    spark = rows.sparkSession
    counts, stats = count_words(rows, path)
    known = spark.sparkContext.broadcast(stats)  # FREQUENT words at most
    keyed = rows.select("doc_id", F.monotonically_increasing_id().alias("rid"), held_out().alias("held_out"), "text")
    encoded = stored(keyed.mapInArrow(tidy(_encode(known)), _ENCODED_DDL), f"{path}/encoded")
    net = Network.of(stats)
    learn_rows(encoded, net, path)
    return counts, stats, encoded, net


def scored(counts: DataFrame, stats: Statistics, encoded: DataFrame, net: Network, path: str) -> DataFrame:
    """The scores of what ``trained`` returns."""
    shared = encoded.sparkSession.sparkContext.broadcast(net)
    streams = encoded.select("doc_id", "rid", "held_out", "n_tokens", "n_known", "base", "tail", "symbols")
    rows = stored(streams.mapInArrow(tidy(_score(shared)), _SCORED_DDL), f"{path}/scored")
    rare = encoded.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.times").join(counts.hint("shuffle_hash"), "word")  # neither side is sorted
    rare = rare.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_log"), F.sum("times").alias("_known"))
    more = F.coalesce("_log", F.lit(0.0))
    return rows.join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(stats.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text is the end alone. A very long text is one row of symbols, trained on and
    scored whole. Without training rows every count is zero: the base is 0 for each token, and the
    network is the even law. Repeated rows are each scored, and equally. No rows give no scores.
    """
    path = path or scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(*trained(rows, path), path)


def language_model_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``score_documents`` over all of ``docs``, with the module's parameters."""
    return score_documents(docs)
