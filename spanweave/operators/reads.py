"""From alignment records to reads, segments, junctions and boundaries.

Records have ``read_id, sample_id, chrom, pos`` (1-based)``, mapq, flag, cigar,
qname, xs, seq_len``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from .tables import written

KEYS = ["chrom", "strand"]


def usable(records: DataFrame, max_intron: int = 1_000_000, min_inner: int = 3, min_mapq: int = 1) -> DataFrame:
    """Mapped primary records without an over-long skip or a tiny inner match."""
    ops = F.col("_ops")
    n = F.size(ops)
    long_skip = F.exists(ops, lambda o: (o["op"] == "N") & (o["n"] > max_intron))
    inner = F.filter(ops, lambda o, i: (i > 0) & (i < n - 1) & (o["op"] == "M") & (o["n"] < min_inner))
    flags = F.col("flag").bitwiseAND(F.lit(A.SECONDARY | A.UNMAPPED)) == 0
    mapped = records.where(flags & (F.col("mapq") >= min_mapq)).select("*", F.explode(F.array(A.cigar_ops(F.col("cigar")))).alias("_ops"))
    return mapped.where(~long_skip & (F.size(inner) == 0)).drop("_ops")


def stranded(records: DataFrame, library: str = "fr-firststrand") -> DataFrame:
    """Set ``strand`` from the flags; records whose XS tag says otherwise go."""
    strand = F.coalesce(A.strand_from_flags(F.col("flag"), library), F.col("xs"))
    return records.withColumn("strand", strand).where(F.col("strand").isNotNull() & (F.col("xs").isNull() | (F.col("xs") == F.col("strand"))))


def with_segments(records: DataFrame, min_intron: int = 5) -> DataFrame:
    """Add ``segments``; records that align nowhere go."""
    # a generated column: the filter and later steps use it without folding the CIGAR again
    out = records.select("*", F.explode(F.array(A.segments(F.col("cigar"), F.col("pos"), min_intron))).alias("segments"))
    return out.where(F.size("segments") > 0)


#: Distinct CIGARs that may be broadcast with what follows from them (some tens of MB).
MOST_SHAPES = 100_000


def usable_segments(records: DataFrame, max_intron: int = 1_000_000, min_inner: int = 3, min_mapq: int = 1, min_intron: int = 5) -> DataFrame:
    """:func:`usable` records with their :func:`segments <with_segments>`.

    Each distinct CIGAR is folded once, from position 0, and its stretches are moved
    to each record; with more than ``MOST_SHAPES`` of them each record is folded.
    """
    flags = F.col("flag").bitwiseAND(F.lit(A.SECONDARY | A.UNMAPPED)) == 0
    held = records.where(flags & (F.col("mapq") >= min_mapq) & F.col("cigar").isNotNull())
    ops = held.select("cigar").distinct().select("cigar", F.explode(F.array(A.cigar_ops(F.col("cigar")))).alias("_ops"))
    n = F.size("_ops")
    long_skip = F.exists("_ops", lambda o: (o["op"] == "N") & (o["n"] > max_intron))
    inner = F.exists(F.filter("_ops", lambda o, i: (i > 0) & (i < n - 1)), lambda o: (o["op"] == "M") & (o["n"] < min_inner))
    shapes = written(ops.where(~long_skip & ~inner).select("cigar", A.segments(F.col("cigar"), F.lit(0), min_intron).alias("_shape")).where(F.size("_shape") > 0))
    if shapes.count() > MOST_SHAPES:
        return with_segments(usable(records, max_intron, min_inner, min_mapq), min_intron)
    moved = F.transform("_shape", lambda s: F.struct((s["left"] + F.col("pos")).alias("left"), (s["right"] + F.col("pos")).alias("right")))
    return held.join(F.broadcast(shapes), "cigar").select(*records.columns, moved.alias("segments"))


def exploded_segments(reads: DataFrame, before: bool = False) -> DataFrame:
    """One row per aligned stretch, numbered from 0; ``before`` adds ``prev_right``, the end of the read's stretch before."""
    rows = reads.select("read_id", "sample_id", *KEYS, *["segments"] * before, F.posexplode("segments").alias("seg_no", "_s"))
    prev = [F.get("segments", F.col("seg_no") - 1)["right"].alias("prev_right")] if before else []
    return rows.select("read_id", "sample_id", *KEYS, "seg_no", F.col("_s.left").alias("left"), F.col("_s.right").alias("right"), *prev)


def collapsed(reads: DataFrame) -> DataFrame:
    """Equal alignments of a sample as one row with their number."""
    return reads.groupBy(*KEYS, "segments", "sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("read_id").alias("first_read"), F.max("mapq").alias("mapq")
    )


def junctions(reads: DataFrame, min_anchor: int = 10) -> DataFrame:
    """Introns with their supporting reads per sample."""
    gaps = reads.select("sample_id", *KEYS, F.explode(A.anchored_introns(F.col("segments"), min_anchor)).alias("_j"))
    return gaps.groupBy(*KEYS, F.col("_j.left").alias("jl"), F.col("_j.right").alias("jr"), "sample_id").agg(F.count(F.lit(1)).alias("n"))


def junction_cuts(reads: DataFrame, min_anchor: int = 10) -> DataFrame:
    """``pos``, the first base behind each end of an intron, without repeats."""
    found = reads.select(*KEYS, F.explode(A.anchored_introns(F.col("segments"), min_anchor)).alias("_j"))
    return found.select(*KEYS, F.explode(F.array(F.col("_j.left"), F.col("_j.right") + 1)).alias("pos")).distinct()


def supported_junctions(per_sample: DataFrame, n_samples: int, min_coverage: int = 1, low_percent: int = 30) -> DataFrame:
    """Junctions that hold against their siblings at both ends.

    With over one sample, two supporting samples and ``low_percent`` of all are
    needed.  A count of 3 or less falls to a sibling over 10 and over 8 times as
    large; a junction falls with its end if all junctions there sum to less than
    ``min_coverage``.  It stays if one of its two ends lets it.
    """
    all_n = per_sample.groupBy(*KEYS, "jl", "jr").agg(F.sum("n").alias("n"), F.countDistinct("sample_id").alias("samples"))

    def holds(end: str) -> F.Column:
        w = Window.partitionBy(*KEYS, end)
        top, total = F.max("n").over(w), F.sum("n").over(w)
        few = F.lit(n_samples > 1) & ((F.col("samples") < 2) | (F.floor(F.col("samples") * 100 / n_samples) < low_percent))
        weak = (F.col("n") <= 3) & (top > 10) & (top > 8 * F.col("n"))
        return ~(few | weak | (total < min_coverage))

    return all_n.withColumn("holds_left", holds("jl")).withColumn("holds_right", holds("jr")).withColumn("valid", F.col("holds_left") | F.col("holds_right"))


def boundaries(reads: DataFrame, min_anchor: int = 10) -> DataFrame:
    """Stretch ends: ``kind`` START or END, position, and whether a splice proves it."""
    # plain columns of one stretch and its read's ends: no array is walked for each stretch
    size = lambda s: s["right"] - s["left"] + 1
    held = reads.select("sample_id", *KEYS, "segments", F.size("segments").alias("_n"))
    held = held.select("*", (size(F.get("segments", F.lit(0))) < min_anchor).alias("_first"), (size(F.get("segments", F.col("_n") - 1)) < min_anchor).alias("_last"))
    at = held.select("sample_id", *KEYS, "_n", "_first", "_last", F.posexplode("segments").alias("_i", "_s"))
    proven = lambda i: (i >= 0) & (i < F.col("_n") - 1) & ~((i == 0) & F.col("_first")) & ~((i == F.col("_n") - 2) & F.col("_last"))
    start = F.struct(F.lit("START").alias("kind"), F.col("_s.left").alias("pos"), proven(F.col("_i") - 1).alias("evidence"))
    end = F.struct(F.lit("END").alias("kind"), F.col("_s.right").alias("pos"), proven(F.col("_i")).alias("evidence"))
    return at.select("sample_id", *KEYS, F.explode(F.array(start, end)).alias("_b")).select("sample_id", *KEYS, "_b.kind", "_b.pos", "_b.evidence")


def boundary_counts(reads: DataFrame, min_anchor: int = 10) -> DataFrame:
    """:func:`boundaries` counted by position and sample; ``evidence`` if any of them has it."""
    found = boundaries(reads, min_anchor)
    return found.groupBy(*KEYS, "kind", "pos", "sample_id").agg(F.max("evidence").alias("evidence"), F.count(F.lit(1)).alias("n"))


def library_totals(records: DataFrame) -> DataFrame:
    """Mapped reads and mean read length of each sample."""
    mapped = ~A.has_flag(F.col("flag"), A.UNMAPPED)
    return records.where(mapped).groupBy("sample_id").agg(F.count(F.lit(1)).alias("mapped"), F.avg("seq_len").alias("read_length"))


def merged(*inputs: DataFrame) -> DataFrame:
    """Records of several inputs in one order: by chromosome, position, then input.

    Ranges of positions are dealt to tasks and each is ordered on its own.
    """
    out = None
    for no, df in enumerate(inputs):
        df = df.withColumn("input_no", F.lit(no))
        out = df if out is None else out.unionByName(df)
    return out.orderBy("chrom", "pos", "input_no")
