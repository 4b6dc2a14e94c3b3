"""Transcripts: regions, filters, votes, abundances and matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as A
from .intervals import islands, overlap_join


def compacted(exons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Directly adjacent exons of a chain as one: ``keys, start, end``."""
    return islands(exons, keys, "start", "end", 0).select(*keys, "start", "end")


def with_regions(transcripts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``region_start, region_end``: the union of overlapping transcripts."""
    regions = islands(transcripts, keys, "start", "end", -1).select(*keys, F.col("start").alias("region_start"), F.col("end").alias("region_end"))
    return overlap_join(transcripts, regions, keys, ("start", "end"), ("region_start", "region_end"))


def passing(
    series: DataFrame,
    keys: Sequence[str],
    percent: float = 0.0,
    mean_filter: float = 4.0,
    score_filter: float = 3.0,
    region_mean: float = 5.5,
    base_length: int = 200,
    per_exon: int = 50,
    single_coverage: float = 20.0,
    single_length: int = 300,
) -> DataFrame:
    """Add ``passes`` to transcript series with regions.

    ``series`` has ``region_start, sample_id, mean, score, length, n_exons,
    guided, barred``.  Guided transcripts pass.  Others need a mean of
    ``percent`` of their region's largest, a mean or score over ``mean_filter``,
    a score over ``score_filter``, a region over ``region_mean``, the length for
    their exons, no bar, and if single the stricter limits.  The region's
    largest mean is a grouped table that is joined back, so regions of any size
    are fine.
    """
    by = [*keys, "region_start", "sample_id"]
    top = series.groupBy(*by).agg(F.max("mean").alias("_top"))
    s = series.join(top, by)
    long_enough = F.col("length") >= base_length + per_exon * F.col("n_exons")
    single = (F.col("n_exons") > 1) | ((F.col("mean") > single_coverage) & (F.col("length") >= single_length))
    own = (
        (F.col("mean") >= F.col("_top") * percent / 100.0)
        & ((F.col("mean") > mean_filter) | (F.col("score") > mean_filter))
        & (F.col("score") > score_filter)
        & (F.col("_top") > region_mean)
        & long_enough & ~F.col("barred") & single
    )
    return s.withColumn("passes", F.col("guided") | own).drop("_top")


def voted(series: DataFrame, n_ids: int, id_cols: Sequence[str], low_percent: int = 30) -> DataFrame:
    """Transcripts whose passing samples are over ``low_percent`` of all (whole percents)."""
    votes = series.groupBy(*id_cols).agg(F.sum(F.col("passes").cast("int")).alias("votes"))
    return votes.where(F.floor(F.col("votes") * 100 / n_ids) > low_percent)


def abundances(series: DataFrame, libraries: DataFrame) -> DataFrame:
    """Add ``fpkm`` and ``reads`` from ``mapped`` and ``read_length`` per sample."""
    joined = series.join(libraries, "sample_id")
    return joined.withColumn("fpkm", A.fpkm(F.col("mean"), F.col("read_length"), F.col("mapped"))).withColumn(
        "reads", A.read_count(F.col("mean"), F.col("length"), F.col("read_length"))
    )


def matrix(rows: DataFrame, by: Sequence[str], value: str, samples: Sequence[int], prefix: str = "s") -> DataFrame:
    """One column per sample with the sum of ``value``, 0 where there is none.

    Conditional sums over named samples: no pass to find them out.
    """
    return rows.groupBy(*by).agg(*[F.sum(F.when(F.col("sample_id") == s, F.col(value)).otherwise(0)).alias(f"{prefix}{s}") for s in samples])


def combined(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weighted mean over samples: weights add up, means by weight."""
    return series.groupBy(*by).agg((F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"), F.sum("weight").alias("weight"))


def modes(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All most frequent values of each key: ``keys, value, n``."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    return counts.join(top, [*keys, "n"]).select(*keys, value, "n")


def common_value(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value, the smallest of equals."""
    return modes(rows, keys, value).groupBy(*keys).agg(F.min(value).alias(value), F.max("n").alias("n"))
