"""Comparisons of two texts that no expression has; pandas UDFs over Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def _ratio(a, b) -> float:
    return (1.0 if not b else 0.0) if not a else difflib.SequenceMatcher(None, a, b).ratio()


def lines_in_order(got: str, want: str) -> float:
    """The share of lines that come again in their order, near enough."""
    left, mine = [x.strip() for x in got.split("\n") if x.strip()], [x.strip() for x in want.split("\n") if x.strip()]
    at = hits = 0
    for line in mine:
        k = next((i for i in range(at, len(left)) if difflib.SequenceMatcher(None, line, left[i]).ratio() > 0.6), None)
        if k is not None:
            hits, at = hits + 1, k + 1
    return hits / len(mine) if mine else 1.0


@F.pandas_udf(DoubleType())
def _accuracy(got: pd.Series, want: pd.Series) -> pd.Series:
    return pd.Series([0.5 * _ratio(w, g) + 0.3 * _ratio(w.split(), g.split()) + 0.2 * lines_in_order(g, w) for g, w in zip(got.fillna(""), want.fillna(""))])


def recognition_accuracy(got: Column, want: Column) -> Column:
    """Characters, words and order of lines, weighed .5, .3, .2."""
    return _accuracy(got, want)


@F.pandas_udf(StringType())
def _diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), "a", "b", lineterm="")) for x, y in zip(a, b)])


def unified_diff(a: Column, b: Column) -> Column:
    """Empty where the texts are equal, which is decided without Python."""
    differ = ~a.eqNullSafe(b)
    return F.when(differ, _diff(F.when(differ, a), F.when(differ, b))).otherwise("")


@F.pandas_udf(StringType())
def _composed(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFC", n))


def safe_filename(name: Column) -> Column:
    wide = name.rlike(r"[^\x00-\x7f]")
    n = F.when(wide, _composed(F.when(wide, name))).otherwise(name)
    return F.regexp_replace(F.regexp_replace(n, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", "")
