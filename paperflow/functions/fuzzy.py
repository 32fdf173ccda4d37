"""Ratcliff-Obershelp similarity, which Spark lacks, as Arrow-batched functions on folded texts.

Callers match distinct texts and try exact containment first; bounds in numpy (similar.py) choose what a ratio is computed for."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .similar import best_window as seeded_window
from .text import fold


def _ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def ratio(a: Column, b: Column) -> Column:
    """Ratio of two folded texts; 0 if either is empty or null."""

    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_ratio(i or "", j or "") for i, j in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(a, b)


def similarity(a: Column, b: Column) -> Column:
    return ratio(fold(a), fold(b))


def best_window(needle: str, text: str, threshold: float, parts: int, floor: float = 0.0) -> float:
    """The best ratio of needle with windows of text, its length and a step longer; stops at the threshold. Windows that can't
    reach the floor are passed over, so below it the result is a lower bound; they are found by seeds if the floor is the threshold."""
    if floor >= threshold:
        return seeded_window(needle, text, threshold, parts)
    if not needle or not text:
        return 0.0
    if needle in text:
        return 1.0
    n = len(needle)
    if len(text) < n:
        return SequenceMatcher(None, needle, text).ratio()
    step, best = max(1, n // parts), 0.0
    for at in range(0, len(text) - n + 1, step):
        matcher = SequenceMatcher(None, needle, text[at : at + n + step])
        hopeful = lambda bound: bound > best and bound >= floor  # noqa: B023, E731
        if hopeful(matcher.real_quick_ratio()) and hopeful(matcher.quick_ratio()):
            best = max(best, matcher.ratio())
        if best >= threshold:
            break
    return best


def fuzzy_window(needle: Column, text: Column, threshold: float = 0.80, parts: int = 6) -> Column:
    """Best window ratio of a folded needle in a folded text, a lower bound where it is under the threshold; containment is
    decided by the built-in first."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([best_window(x or "", y or "", threshold, parts, threshold) for x, y in zip(a, b, strict=True)], dtype=float)

    inside = (needle != "") & text.contains(needle)
    score = F.pandas_udf(run, "double")(needle, F.when(inside, needle).otherwise(text))  # batches skip the texts already decided
    return F.when(inside, 1.0).otherwise(score)
