"""Similarity of two texts held in one row."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from convqa.functions.text import tokens, words_loose


def word_overlap(a: str | Column, b: str | Column) -> Column:
    """Shared distinct words over the smaller word set; 0 when either side has no words."""
    left, right = words_loose(a), words_loose(b)
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller).otherwise(F.lit(0.0))


def dice(a: str | Column, b: str | Column) -> Column:
    """Multiset token overlap: twice the shared tokens over all tokens."""
    return dice_tokens(tokens(a), tokens(b))


def dice_tokens(left: Column, right: Column) -> Column:
    def numbered(bag: Column) -> Column:
        """Number repeated tokens, so that set intersection counts multiplicities."""
        ordered = F.array_sort(bag)
        return F.transform(ordered, lambda t, i: F.concat(t, F.lit(" "), (i - F.array_position(ordered, t)).cast("string")))

    total = F.size(left) + F.size(right)
    shared = F.size(F.array_intersect(numbered(left), numbered(right)))
    return (
        F.when(total == 0, F.lit(1.0))
        .when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0))
        .otherwise(F.lit(2.0) * shared / total)
    )


@F.pandas_udf(DoubleType())
def verbatim_ratio(original: pd.Series, rewritten: pd.Series) -> pd.Series:
    """Sequence-matcher ratio of two texts after collapsing white space."""
    def ratio(a: str, b: str) -> float:
        left, right = (re.sub(r"\s+", " ", t or "").strip() for t in (a, b))
        return difflib.SequenceMatcher(None, left, right).ratio()

    return pd.Series([ratio(a, b) for a, b in zip(original, rewritten)])


def is_verbatim(original: str | Column, rewritten: str | Column, minimum: float = 0.85) -> Column:
    return verbatim_ratio(original, rewritten) >= minimum
