"""Text functions as Spark columns: tokens, stems, keys, cleaning, references.

All of them are built-in expressions, so they run inside the JVM and take part in optimisation.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that a stem loses, longest first.
SUFFIXES = ["ations", "ation", "ness", "ment", "ance", "ence", "ible", "able", "ing", "ers", "est", "ity", "ies", "ied", "ive", "ous", "ful", "ant", "ent", "ed", "er", "es", "ly", "s"]
# Spellings of romanised Arabic that share a key, applied in this order.
SPELLINGS = [
    ("ph", "f"), ("kh", "k"), ("gh", "g"), ("dh", "d"), ("th", "t"), ("sh", "s"), ("ch", "k"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("aa", "a"),
    ("ee", "i"), ("oo", "u"), ("ou", "u"), ("ei", "i"), ("ai", "i"), ("ay", "i"), ("ya", "i"), ("y", "i"), ("w", "u"), ("j", "g"),
]
# Words that an alignment audit doesn't compare.
AUDIT_STOP_WORDS = (
    "the and of to a in is it you that he was for on are with as his they be at have this from or had by but not what all were we when "
    "your there so if who them then would will their him has our said which do did no an my us"
).split()
#: Default English stop words: Spark's own list. Every function that uses them takes a list instead.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now "
    "i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't "
    "haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would"
).split()
# Fixed formats.
CITATION = r"\[(\d+):(\d+)\]"
PAGE_FOOTER = r"^\d+\s+out\s+of\s+\d+$"
FOOTNOTE_LINE = r"^\d{1,3}\s+[A-Z]"
REPETITION = r"(?i)^\(REPEATED"
GLUED_NOTE = r"(?<=[A-Za-z])\d{1,3}(?=[\s.,;:!?'‘’\"\)\]]|$)"
COMMENTARY_BUDGET = 12_000
CUT_NOTE = "\n\n[commentary truncated for length]"


def stop_words_from(path: str) -> list[str]:
    """A stop-word list from a text file, words divided by white space: for a corpus that needs another list than the default."""
    with open(path, encoding="utf-8") as f:
        return sorted(set(f.read().lower().split()))


def tokens(text: Column) -> Column:
    """Words of letters and apostrophes, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def _then(value: Column, step: Callable[[Column], Column]) -> Column:
    """``step`` of ``value``, which is worked out once however often the step names it."""
    return F.transform(F.array(value), step)[0]


def stem(word: Column) -> Column:
    """A light suffix-stripping stem.

    The prefix of the suffix pattern is lazy, so of all suffixes that leave three letters the longest
    goes; it is applied twice for stacked suffixes.
    """
    size, strip = F.length, f"^(.{{3,}}?)(?:{'|'.join(SUFFIXES)})$"
    but = lambda w, n: F.substring(w, F.lit(1), size(w) - n)
    w = _then(word, lambda w: F.when((size(w) > 5) & w.endswith("ly"), but(w, 2)).otherwise(w))
    w = _then(w, lambda w: F.when((size(w) > 3) & w.rlike("[^aeiou]y$"), F.concat(but(w, 1), F.lit("i"))).otherwise(w))
    w = F.regexp_replace(F.regexp_replace(w, strip, "$1"), strip, "$1")
    w = _then(w, lambda w: F.when((size(w) > 3) & w.endswith("e"), but(w, 1)).otherwise(w))
    return _then(w, lambda w: F.when(w.rlike(r"^..+([^aeioulsz])\1$"), but(w, 1)).otherwise(w))


def content_terms(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Tokens of a query that say something: three letters or more and no stop word."""
    return F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(stop_words))


def vector_terms(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Terms of the TF-IDF layer: words of two letters or more of any script without stop words, then pairs of neighbours."""
    # A long list of literals is looked up as a set.
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda t: ~t.isin(stop_words))
    return with_pairs(words)


def with_pairs(words: Column) -> Column:
    """``words`` and then each word with the one after it."""
    n = F.size(words)
    left = F.when(n > 1, F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    right = F.when(n > 1, F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b)))


def words_of(text: Column) -> Column:
    """Split at white space; no empty words."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def spelling_key(word: Column) -> Column:
    """A key that spellings of one romanised name share: digraphs folded, doubles collapsed, inner vowels dropped."""
    w = F.replace(F.lower(word), F.lit("'"), F.lit(""))
    for a, b in SPELLINGS:
        w = F.replace(w, F.lit(a), F.lit(b))
    w = F.regexp_replace(w, r"(.)\1+", "$1")
    w = F.when((F.length(w) > 2) & w.endswith("h"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    w = F.when(F.length(w) > 3, F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, F.lit(2), F.length(w)), "[aeiou]", ""))).otherwise(w)
    return F.when(w == "", F.lower(word)).otherwise(w)


def content_bag(text: Column, stop_words: list[str] = AUDIT_STOP_WORDS) -> Column:
    """Distinct words of an alignment audit: over two letters, no stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(stop_words)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the size of the smaller bag; 0 if either is empty or null."""
    small = F.least(F.size(a), F.size(b))
    return F.coalesce(F.when(small > 0, F.size(F.array_intersect(a, b)) / small), F.lit(0.0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_furniture(line: Column, page_header: str | None = None) -> Column:
    """Whether a line is page furniture: blank, the page header (how its lines begin), a page footer, a footnote, a repetition note."""
    s = stripped(line)
    header = s.startswith(page_header) if page_header else F.lit(False)
    return (s == "") | header | s.rlike(PAGE_FOOTER) | s.rlike(FOOTNOTE_LINE) | s.rlike(REPETITION)


def without_furniture(text: Column, page_header: str | None = None) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_furniture(x, page_header)), "\n")


def latin_lines(text: Column) -> Column:
    """Lines with two Latin letters side by side."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[A-Za-z]{2,}"))


def clean(text: Column, keep_citations: bool = False) -> Column:
    """Latin lines as one line: citations (unless kept) and glued footnote numbers go, space is evened out."""
    t = stripped(F.array_join(latin_lines(text), " "))
    if not keep_citations:
        t = stripped(F.regexp_replace(t, r"\[\d+:\d+\]", ""))
    t = F.regexp_replace(t, GLUED_NOTE, "")
    t = stripped(F.regexp_replace(t, r"\s+", " "))
    t = F.regexp_replace(t, r"\s+([.,;:!?])", "$1")
    return F.regexp_replace(t, r"^[ .]+|[ .]+$", "")


def citations(text: Column) -> Column:
    """array<struct<chapter, verse>> of the [chapter:verse] marks in order."""
    pattern = F.lit(CITATION)
    return F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda c, v: F.struct(c.cast("int").alias("chapter"), v.cast("int").alias("verse")))


def header_range(header: Column) -> Column:
    """struct<first, last>: least and largest number of a section header; nulls without numbers."""
    n = F.transform(F.regexp_extract_all(header, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    return F.struct(F.array_min(n).alias("first"), F.array_max(n).alias("last"))


def ref_parts(ref: Column) -> Column:
    """struct<chapter, verse> of "chapter:verse"; nulls where it isn't one."""
    p = F.split(ref, ":")
    return F.struct(p.getItem(0).try_cast("int").alias("chapter"), F.try_element_at(p, F.lit(2)).try_cast("int").alias("verse"))


def without_opening(text: Column, chapter: Column, verse: Column, opening: Column) -> Column:
    """A first verse, of any chapter but the first, without the opening formula; byte order marks and outer space go."""
    strip = lambda c: stripped(F.regexp_replace(c, "^\\x{FEFF}+", ""))
    t, o = strip(text), strip(opening)
    return F.when((verse == 1) & (chapter != 1) & (F.length(o) > 0) & F.startswith(t, o), strip(F.substring(t, F.length(o) + 1, F.length(t)))).otherwise(t)


def within_budget(commentary: Column, budget: int = COMMENTARY_BUDGET) -> Column:
    """The commentary for a prompt: cut with a note if it is too long, a placeholder if there is none."""
    c = F.coalesce(commentary, F.lit(""))
    return F.when(c == "", "(no commentary available)").when(F.length(c) > budget, F.concat(F.left(c, F.lit(budget)), F.lit(CUT_NOTE))).otherwise(c)


def replace_word(text: Column, word: str, by: str) -> Column:
    """Whole-word replacement that ignores case."""
    return F.regexp_replace(text, rf"(?i)\b{re.escape(word)}\b", by.replace("\\", r"\\").replace("$", r"\$"))


def client_key(forwarded: Column, peer: Column, trusted_hops: int = 1) -> Column:
    """Who a request is from: the entry that the outermost trusted proxy wrote, counted from the right; else the socket's peer."""
    peer = F.coalesce(peer, F.lit("unknown"))
    if trusted_hops <= 0:
        return peer
    parts = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(parts)
    return F.when(n == 0, peer).otherwise(F.try_element_at(parts, F.greatest(n - trusted_hops + 1, F.lit(1))))


def origins(text: str) -> list[str]:
    """Entries of a comma-separated list."""
    return [p for x in text.split(",") if (p := x.strip())]
