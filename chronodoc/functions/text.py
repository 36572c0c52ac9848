"""Analyzers: functions from a text column to an array of terms."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Analyzer = Callable[[Column], Column]
SEPARATORS = r"[^\p{L}\p{M}\p{N}]+"


def default_analyzer(text: Column) -> Column:
    """Terms in order: maximal runs of letters, marks and numbers of the lower-cased text. Null stays null."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def stopword_analyzer(words: Iterable[str]) -> Analyzer:
    """The default analyzer without the given words; repeated other terms stay repeated."""
    stop = sorted(set(words))
    if not stop:
        return default_analyzer
    return lambda text: F.filter(default_analyzer(text), lambda t: ~t.isin(stop))
