"""What speaks for the arcs on both sides of an exon: reads across it and pairs around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import coverage, overlap_join
from .pairs import paired


def crossing_reads(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, exon_id, sample_id, crossing``: reads that hold the exon between two others.

    ``sets`` has ``exon_ids`` (sorted), ``sample_id`` and a count ``n``.
    """
    inner = sets.where(F.size("exon_ids") > 2).select(*keys, "sample_id", "n", F.explode(F.slice("exon_ids", 2, F.size("exon_ids") - 2)).alias("exon_id"))
    return inner.groupBy(*keys, "exon_id", "sample_id").agg(F.sum("n").alias("crossing"))


def spanning_pairs(mates: DataFrame, exons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, exon_id, sample_id, spanning``: pairs with the exon between their mates.

    ``mates`` has the sorted sets ``near`` and ``far`` of the two mates; only pairs
    of which one ends before the other begins count.  The mate's own last (or
    first) exon counts if the mate holds another one.  Pairs are added up along
    the line first, so no pair meets each exon that it spans.
    """
    end, start = F.element_at("near", -1), F.get("far", F.lit(0))
    gaps = mates.where(end < start).select(
        *keys, "sample_id", F.when(F.size("near") > 1, end).otherwise(end + 1).alias("left"), F.when(F.size("far") > 1, start).otherwise(start - 1).alias("right")
    )
    return spanned(gaps, exons, keys)


def between_mates(touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, sample_id, left, right``: the stretches between mates that :func:`spanning_pairs` counts.

    ``touched`` has ``qname, read_id, left, right`` and the sorted ``exon_ids`` of every
    read; mates only need their outer exons of each other, so no set is sent to its mate.
    """
    ends = touched.select(
        "qname", "sample_id", *keys, "read_id", "left", "right", F.get("exon_ids", F.lit(0)).alias("first"), F.element_at("exon_ids", -1).alias("last"), (F.size("exon_ids") > 1).alias("many")
    )
    met = paired(ends, ["first", "many"]).where("last < mate_first")
    left, right = F.col("last") + (~F.col("many")).cast("int"), F.col("mate_first") - (~F.col("mate_many")).cast("int")
    return met.select(*keys, "sample_id", left.alias("left"), right.alias("right"))


def spanned(gaps: DataFrame, exons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, exon_id, sample_id, spanning``: how many ``gaps`` (``left, right``) hold each exon's start."""
    depth = coverage(gaps.where(F.col("left") <= F.col("right")), [*keys, "sample_id"])
    hit = overlap_join(exons.select(*keys, "exon_id").distinct(), depth, keys, ("exon_id", "exon_id"), ("start", "end"))
    return hit.select(*keys, "exon_id", "sample_id", F.col("depth").alias("spanning"))


def evidence_index(sets: DataFrame, mates: DataFrame, exons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both counts for each exon and sample that has one of them: ``keys, exon_id, sample_id, crossing, spanning``."""
    return counted_together(crossing_reads(sets, keys), spanning_pairs(mates, exons, keys), keys)


def counted_together(crossing: DataFrame, spanning: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`evidence_index` of both counts."""
    by = [*keys, "exon_id", "sample_id"]
    both = crossing.join(spanning, by, "full")
    return both.select(*by, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("crossing", "spanning")])
