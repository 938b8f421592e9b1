"""Public tokenizers over whole texts, with a cache of words.

The tokenizer of ``word_bpe_49k.json`` drops white space before it merges, so the ids of a text
are those of its white-space separated words, one after another. In words of plain letters and
marks after them, letters and marks go to the library's BPE model as the two runs that its encoder
makes of them; all other words go through the whole encoder. Either way the ids are the library's;
the cache only spares repeating them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"

#: Letters that have one code point in lower case and that normalization leaves alone, and marks that
#: the tokenizer keeps as one run after them.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?*$%&#|()-"
_PLAIN = f"^[{_LETTERS}]+[{re.escape(_MARKS)}]*$"
_WORD = re.compile(f"[{_LETTERS}]+")
#: Bytes of text that are encoded at once.
_AT_ONCE = 8 << 20


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level BPE: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(0x100 + i) for i, b in enumerate(rest)}}


class WordEncoder:
    """Ids of texts as little-endian unsigned 16- or 32-bit integers (``dtype``).

    Words of the last ``most`` that were new are remembered, and of the ``most`` before them those
    that came again, which bounds the memory and keeps frequent words.
    """

    def __init__(self, path: str | None = None, most: int = 200_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or tokenizer_path())
        self.model = self.whole.model
        n = self.whole.get_vocab_size()
        self.dtype = "<u2" if n <= 1 << 16 else "<u4"
        self.width = int(self.dtype[-1])
        self.packed = [i.to_bytes(self.width, "little") for i in range(n)]
        self.letters, self.most, self.known, self.older, self.marks = _byte_letters(), most, {}, {}, {"": b""}

    def _run(self, run: str) -> bytes:
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(run)])

    def word(self, word: str) -> bytes:
        """The ids of a word that ``known`` doesn't hold: lower-case letters alone, or whatever isn't plain."""
        if (out := self.older.get(word)) is None:
            if _WORD.fullmatch(word):
                out = self._run(word)
            else:
                out = b"".join([self.packed[i] for i in self.whole.encode(word, add_special_tokens=False).ids])
            if len(word) > 200:
                return out
        if len(self.known) >= self.most:
            self.older, self.known = self.known, {}
        self.known[word] = out
        return out

    def _words(self, words: pa.Array) -> list[bytes]:
        """Packed ids of distinct words. Those that differ in case or in marks at the end share their letters' ids."""
        plain = pc.match_substring_regex(words, _PLAIN)
        letters = pc.utf8_rtrim(words, _MARKS)
        size = pc.utf8_length(letters).to_numpy(zero_copy_only=False)
        core = pc.if_else(plain, pc.utf8_lower(letters), words).dictionary_encode()
        get, known = self.known.get, []
        for w in core.dictionary.to_pylist():
            if (p := get(w)) is None:
                p = self.word(w) if w else b""
                get = self.known.get  # a full cache is exchanged
            known.append(p)
        out = [known[i] for i in core.indices.to_numpy(zero_copy_only=False).tolist()]
        marked = np.flatnonzero(plain.to_numpy(zero_copy_only=False) & (pc.utf8_length(words).to_numpy(zero_copy_only=False) > size))
        for i, w, n in zip(marked.tolist(), words.take(pa.array(marked)).to_pylist(), size[marked].tolist(), strict=True):
            mark = w[n:]
            if (end := self.marks.get(mark)) is None:
                end = self._run(mark)
                if len(self.marks) < 10_000 and len(mark) < 100:
                    self.marks[mark] = end
            out[i] += end
        return out

    def column(self, texts: pa.Array, end: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds) of runs of rows of ``texts``; the ids of row first + i are ids[bounds[i] : bounds[i + 1]].

        Words are told apart by Arrow, so each is looked up once for a run. Nulls are empty texts.
        With ``end``, each row's ids end with it.
        """
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0)
        first = 0
        while first < len(texts):
            limit = (size[first - 1] if first else 0) + _AT_ONCE
            stop = max(first + 1, int(np.searchsorted(size, limit, side="right")))
            yield first, *self._run_of_rows(texts.slice(first, stop - first), end)
            first = stop

    def _run_of_rows(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(texts)
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        packed = self._words(coded.dictionary)
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        blob, starts = np.frombuffer(b"".join(packed), self.dtype), np.cumsum(lengths) - lengths
        at = coded.indices.to_numpy(zero_copy_only=False)
        own = lengths[at]
        ends = np.cumsum(own)
        ids = blob[np.repeat(starts[at] - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        if end is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], end), bounds + np.arange(len(bounds))

    def text(self, text: str | None) -> bytes:
        """Packed ids of one text."""
        return b"".join(ids.tobytes() for _, ids, _ in self.column(pa.array([text], pa.large_string())))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """One for each Python worker."""
    key = path or tokenizer_path()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(key)
    return _ENCODERS[key]
