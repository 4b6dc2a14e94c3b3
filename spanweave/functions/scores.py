"""Scores that fold a list step by step."""

from __future__ import annotations

from math import sqrt

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def merged_score(values: list[float] | None) -> float | None:
    """Merge a list to one score.

    Again and again the neighbours whose larger-to-smaller ratio is least (the
    first such pair) give way to their geometric mean.  Zeros count as the
    worst ratio; an empty list has no score.
    """
    if values is None or len(values) == 0:
        return None
    v = [float(x) for x in values]
    while len(v) > 1:
        ratios = [max(a, b) / min(a, b) if min(a, b) > 0 else float("inf") for a, b in zip(v, v[1:])]
        i = ratios.index(min(ratios))
        v[i : i + 2] = [sqrt(v[i] * v[i + 1])]
    return v[0]


@F.pandas_udf(DoubleType())
def score(lists: pd.Series) -> pd.Series:
    return lists.map(merged_score)
