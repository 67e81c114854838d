"""Ratcliff-Obershelp similarity (difflib's ratio, argument order kept) as an Arrow function of distinct pairs."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=1 << 16)
def letter_mask(text: str) -> int:
    """A bit for each letter that the text has (letters 64 apart share one)."""
    mask = 0
    for c in text:
        mask |= 1 << (ord(c) & 63)
    return mask


def measured(terms) -> list[tuple[str, int, int]]:
    """Terms with their lengths and letters, for reachable()."""
    return [(t, len(t), letter_mask(t)) for t in terms]


def reachable(text: str, terms: list[tuple[str, int, int]], least: float) -> list[str]:
    """The terms whose lengths and letters allow a ratio of `least` with a text."""
    n, x = len(text), letter_mask(text)
    return [t for t, size, y in terms if n + size - max(abs(n - size), (x ^ y).bit_count()) >= least * (n + size) - 1e-9]


def ratio_from(a: str, b: str, least: float) -> float:
    """ratio(a, b) if it is `least` or more; a smaller one may be 0. Lengths and letters that only one side has bound it,
    so most pairs are not matched."""
    size = len(a) + len(b)
    if not size:
        return 1.0
    x, y = letter_mask(a), letter_mask(b)
    if min(2 * min(len(a), len(b)), size - (x ^ y).bit_count()) < least * size - 1e-9:
        return 0.0
    return ratio(a, b)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where either side is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")
