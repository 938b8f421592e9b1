"""Arabic script as Spark columns: folding of marks and letter forms, and peeling of particles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words_of

# Letter forms that are one letter for search, marks that go, ranges of the script.
FOLDED = "ٱأإآؤئىة"
FOLDS_TO = "ااااوييه"
MARKS = "[\\u064B-\\u065F\\u0640\\u06D6-\\u06ED\\u08F0-\\u08FF]"
SCRIPT = "[\\u0600-\\u06FF\\u0750-\\u077F\\u08A0-\\u08FF]"
DAGGER_ALEF, ALEF = "ٰ", "ا"
# Particles that are no search terms.
PARTICLES = "الي هذا هذه ذلك تلك الذي التي الذين كان اذا لكن حتي هؤلاء اولئك عليه اليه ولا وما".split()
LEAST_TERM = 3


def normalized(text: Column, dagger_as_alef: bool = True) -> Column:
    """One reading of ``text``: dagger alef as a letter or as a mark, marks removed, letter forms folded."""
    t = F.replace(text, F.lit(DAGGER_ALEF), F.lit(ALEF if dagger_as_alef else ""))
    return F.translate(F.regexp_replace(t, MARKS, ""), FOLDED, FOLDS_TO)


def readings(text: Column) -> Column:
    """Both readings, once if they agree."""
    return F.array_distinct(F.array(normalized(text), normalized(text, False)))


def has_script(text: Column) -> Column:
    return text.rlike(SCRIPT)


def _peeled(t: Column, kind: Column) -> Column:
    """``t`` without one particle at its front: 0 vocative, 1 a conjunction, 2 a preposition, 3 the article."""
    n = F.length(t)
    rest = lambda k: F.substring(t, F.lit(k + 1), n)
    return (
        F.when((kind == 0) & (n > 4) & t.startswith("يا"), rest(2))
        .when((kind == 1) & (n > 3) & t.rlike("^[وف]"), rest(1))
        .when((kind == 2) & (n > 3) & t.rlike("^[بكل]"), rest(1))
        .when((kind == 3) & (n > 3) & t.startswith("ال"), rest(2))
        .otherwise(t)
    )


def variants(token: Column) -> Column:
    """``token`` and the forms left as particles are peeled off its front, each of over three letters also without a last alef."""
    start = F.struct(token.alias("t"), F.array(token).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        t = _peeled(acc["t"], i % 4)
        return F.struct(t.alias("t"), F.array_union(acc["out"], F.array(t)).alias("out"))

    forms = F.aggregate(F.sequence(F.lit(0), F.lit(11)), start, step, lambda acc: acc["out"])
    short = F.transform(F.filter(forms, lambda f: (F.length(f) > 3) & f.endswith(ALEF)), lambda f: F.substring(f, F.lit(1), F.length(f) - 1))
    return F.array_union(forms, short)


def passage_forms(text: Column) -> Column:
    """All variants of all words of both readings."""
    words = F.flatten(F.transform(readings(F.coalesce(text, F.lit(""))), words_of))
    return F.array_distinct(F.flatten(F.transform(words, variants)))


def query_terms(query: Column) -> Column:
    """Terms of a query in Arabic script, each as the array of its two readings.

    Only words in the script count; words under three letters and particles say nothing. Words of the
    two readings belong together by position, so readings of different word counts give no terms.
    """
    a, b = words_of(normalized(query)), words_of(normalized(query, False))
    stop = F.array(*map(F.lit, PARTICLES))
    pairs = F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias("a"), b.alias("b"))).otherwise(F.array().cast("array<struct<a: string, b: string>>"))
    kept = F.filter(pairs, lambda p: (F.length(p["a"]) >= LEAST_TERM) & has_script(p["a"]) & ~F.array_contains(stop, p["a"]))
    return F.transform(kept, lambda p: F.array_distinct(F.filter(F.array(p["a"], p["b"]), lambda x: x != "")))
