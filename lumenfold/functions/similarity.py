"""Similarity of spellings: the matching-blocks ratio of the standard library, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import spelling_key


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matches / total length; not symmetric, so the order of arguments matters."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def likelihood(word: Column, candidate: Column, surface: Column, frequency: Column) -> Column:
    """How likely ``candidate`` is what ``word`` meant: surface similarity, raised by an equal key, an equal first letter, and, slightly, by frequency."""
    return (
        surface
        + F.when(spelling_key(word) == spelling_key(candidate), 0.15).otherwise(0.0)
        + F.when(F.substring(word, 1, 1) == F.substring(candidate, 1, 1), 0.05).otherwise(0.0)
        + F.least(F.coalesce(frequency, F.lit(0)), F.lit(200)) / 200 * 0.04
    )
