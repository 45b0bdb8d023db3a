"""String similarity (X1, X2) as Arrow-batched pandas UDFs.

Used only on small candidate sets (distinct vendor strings within a block, distinct
categories against a 33-row taxonomy), never on raw row pairs.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _lcs_len(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyrö 2004)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    v = (1 << len(a)) - 1
    full = v
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def indel_ratio(a: str, b: str) -> float:
    """0-100 normalised indel similarity: 100 * 2 * LCS / (len a + len b)."""
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    return 100.0 * 2 * _lcs_len(a, b) / total


def token_sort(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio_py(a: str, b: str) -> float:
    return indel_ratio(token_sort(a), token_sort(b))


def sequence_ratio_py(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sequence_ratio_py(x, y) for x, y in zip(a, b)],
                     dtype="float64")


@F.pandas_udf(DoubleType())
def _token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_sort_ratio_py(x, y) for x, y in zip(a, b)],
                     dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio in [0, 1]; equal strings short-cut to 1 in SQL. Where one string holds the other,
    the shorter one is the whole match (from 200 characters on, difflib passes over frequent ones)."""
    n, m = F.char_length(a), F.char_length(b)
    held = (F.greatest(n, m) < 200) & (F.least(n, m) > 0) & (F.contains(a, b) | F.contains(b, a))
    # Spark evaluates the Python column for every row: what is known goes there as NULL
    return F.when(a == b, F.lit(1.0)).when(held, 2.0 * F.least(n, m) / (n + m)).otherwise(
        _sequence_ratio(F.when(~held, a), F.when(~held, b)))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0-100 indel similarity of the whitespace tokens sorted and re-joined.

    Sorting the tokens is done in SQL (``array_sort(split(...))``); only the LCS
    runs in Python, and equal sorted strings short-cut to 100 without Python."""
    sa = F.array_join(F.array_sort(F.filter(F.split(F.trim(a), r"\s+"), lambda t: t != "")), " ")
    sb = F.array_join(F.array_sort(F.filter(F.split(F.trim(b), r"\s+"), lambda t: t != "")), " ")
    return F.when(sa == sb, F.lit(100.0)).otherwise(_token_sort_ratio(sa, sb))
