"""Reads of libraries that don't tell strands: islands per strand, and which of them count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import islands, overlap_join
from .running import JOIN_BIN
from .tables import written


def routed(reads: DataFrame, join: int = 5, bin_size: int = JOIN_BIN) -> DataFrame:
    """A row for each read and strand that it is counted on: ``read_id, sample_id, chrom, strand, xs, left, right``.

    ``reads`` has ``read_id, sample_id, chrom, xs, segments``.  A read with a splice
    and no ``xs`` goes.  One without either belongs to the strand whose island of
    reads with ``xs`` it begins in, and to both if it begins in none or in both.
    All islands are known before any read is routed; reads that no island holds
    don't make any for others.
    """
    spans = reads.select(
        "read_id", "sample_id", "chrom", "xs", F.get("segments", F.lit(0))["left"].alias("left"),
        F.element_at("segments", -1)["right"].alias("right"), (F.size("segments") > 1).alias("spliced"),
    )
    spans = written(spans.where(F.col("xs").isNotNull() | ~F.col("spliced")).drop("spliced"))
    signed = spans.where("xs is not null")
    held = islands(signed.withColumnRenamed("xs", "strand"), ["chrom", "strand"], join=join).select("chrom", "strand", "start", "end")
    loose = spans.where("xs is null")
    # few positions stand for many reads
    at = loose.select("chrom", "left").distinct()
    met = overlap_join(at, held, ["chrom"], ("left", "left"), ("start", "end"), bin_size)
    met = met.groupBy("chrom", "left").agg(F.max(F.col("strand") == "+").alias("plus"), F.max(F.col("strand") == "-").alias("minus"))
    plus, minus = F.coalesce("plus", F.lit(False)), F.coalesce("minus", F.lit(False))
    strands = F.when(plus & ~minus, F.array(F.lit("+"))).when(minus & ~plus, F.array(F.lit("-"))).otherwise(F.array(F.lit("+"), F.lit("-")))
    cols = ["read_id", "sample_id", "chrom", "strand", "xs", "left", "right"]
    both = loose.join(met, ["chrom", "left"], "left").withColumn("strand", F.explode(strands))
    return signed.withColumn("strand", F.col("xs")).select(*cols).unionByName(both.select(*cols))


def judged_islands(reads: DataFrame, join: int = 5, bin_size: int = JOIN_BIN) -> DataFrame:
    """Islands of :func:`routed` reads: ``chrom, strand, start, end, n, evidence, discouraged, kept``.

    ``evidence``: a read whose ``xs`` is the island's strand begins in it, apart from
    one that opens it (of reads that begin together, one with ``xs`` comes first).
    ``discouraged``: a read of the other strand begins in it.  An island goes if it
    is discouraged and has no evidence.
    """
    keys = ["chrom", "strand"]
    found = written(islands(reads, keys, join=join))
    signs = reads.where("xs is not null").groupBy("chrom", "xs", "left").agg(F.count(F.lit(1)).alias("m"))
    hit = overlap_join(found, signs, ["chrom"], ("start", "end"), ("left", "left"), bin_size)
    own = F.col("xs") == F.col("strand")
    opens = F.max(F.when(own & (F.col("left") == F.col("start")), 1).otherwise(0))
    seen = hit.groupBy(*keys, "start").agg(
        (F.sum(F.when(own, F.col("m")).otherwise(0)) - opens > 0).alias("evidence"), F.max(~own).alias("discouraged")
    )
    out = found.join(seen, [*keys, "start"], "left")
    evidence, discouraged = (F.coalesce(c, F.lit(False)) for c in ("evidence", "discouraged"))
    return out.select(*keys, "start", "end", "n", evidence.alias("evidence"), discouraged.alias("discouraged"), (evidence | ~discouraged).alias("kept"))
