"""Running aggregates over long sorted sequences, in bins.

A window over a whole chromosome would be one task.  Here each key's rows fall
into bins of the position; one small table has an aggregate per bin, its running
value before each bin is carried in, and the window itself only spans a bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

BIN = 1 << 16
#: Bins of interval joins: near the intervals' lengths, so that few that don't meet share one.
JOIN_BIN = 1 << 11


def before(df: DataFrame, keys: Sequence[str], pos: str, order: Sequence, values: dict[str, tuple[str, Column]], bin_size: int = BIN, kept: DataFrame | None = None) -> DataFrame:
    """Add, per row, aggregates over all earlier rows of its key.

    ``values`` maps a new column to ("max" or "sum", expression).  ``order``
    sorts rows and must begin with ``pos``.  Nothing before a row gives null for
    a maximum and 0 for a sum.  The rows are written once, as they are read twice:
    for the bins' aggregates and for the windows; ``kept`` is ``df`` with ``_bin``
    where the caller has written it.
    """
    binned = written(df.withColumn("_bin", F.floor(F.col(pos) / bin_size))) if kept is None else kept
    fold = {"max": F.max, "sum": F.sum}
    per_bin = binned.groupBy(*keys, "_bin").agg(*[fold[how](x).alias(f"_c_{n}") for n, (how, x) in values.items()])
    line = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bin.select(*keys, "_bin", *[fold[how](f"_c_{n}").over(line).alias(f"_c_{n}") for n, (how, _) in values.items()])
    near = Window.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.join(carry, [*keys, "_bin"])
    for n, (how, x) in values.items():
        own = fold[how](x).over(near)
        if how == "max":
            out = out.withColumn(n, F.greatest(own, F.col(f"_c_{n}")))
        else:
            out = out.withColumn(n, F.coalesce(own, F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
    return out.drop("_bin", *[f"_c_{n}" for n in values])


def runs(df: DataFrame, keys: Sequence[str], pos: str, merge: int, order: Sequence[str], bin_size: int = BIN) -> DataFrame:
    """Add ``_bin`` and ``_own``: the bin of each row, and how many runs have begun in it up to the row.

    A run ends where the next position lies over ``merge`` away; 0 is the run that an
    earlier bin began.  ``order`` sorts rows and must begin with ``pos``.
    """
    binned = written(df.withColumn("_bin", F.floor(F.col(pos) / bin_size)))
    line = Window.partitionBy(*keys).orderBy("_bin")
    carry = binned.groupBy(*keys, "_bin").agg(F.max(pos).alias("_top")).select(*keys, "_bin", F.lag("_top").over(line).alias("_far"))
    near = Window.partitionBy(*keys, "_bin").orderBy(*order)
    last = F.coalesce(F.lag(pos).over(near), F.col("_far"))
    out = binned.join(carry, [*keys, "_bin"]).withColumn("_open", (last.isNull() | (F.col(pos) > last + merge)).cast("int"))
    return out.withColumn("_own", F.sum("_open").over(near)).drop("_far", "_open")


def run_ids(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of :func:`runs`, or groups of them, with ``_no``: the bin that began the run, and its number there.

    ``rows`` is a written table, as it is read twice; each bin's last run is carried to
    the bins that it reaches into.
    """
    line = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    began = lambda: F.struct(F.col("_bin"), F.col("_own"))
    per_bin = rows.groupBy(*keys, "_bin").agg(F.max("_own").alias("_own"))
    carry = per_bin.select(*keys, "_bin", F.last(F.when(F.col("_own") > 0, began()), True).over(line).alias("_before"))
    return rows.join(carry, [*keys, "_bin"]).withColumn("_no", F.when(F.col("_own") > 0, began()).otherwise(F.col("_before"))).drop("_bin", "_own", "_before")
