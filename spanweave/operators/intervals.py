"""Operators over closed intervals on a line (a chromosome and strand)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .running import BIN, JOIN_BIN, before, run_ids, runs
from .tables import written


def islands(df: DataFrame, keys: Sequence[str], left: str = "left", right: str = "right", join: int = 5, bin_size: int = BIN) -> DataFrame:
    """Blocks of intervals: ``keys, start, end, n``.

    A block ends where the next interval begins over ``join`` + 1 behind its
    farthest end; -1 joins only intervals that share a position.
    """
    marked = before(df.select(*keys, left, right), keys, left, [left, right], {"_border": ("max", F.col(right)), "_seen": ("sum", F.lit(1))}, bin_size)
    marked = written(marked.withColumn("_bin", F.floor(F.col(left) / bin_size)))
    opens = F.col("_border").isNull() | (F.col(left) > F.col("_border") + 1 + join)
    # what stands before the next block's first row ends this one: only first rows are sorted again
    first = marked.where(opens).select(*keys, "_bin", F.col(left).alias("start"), F.struct("_border", "_seen").alias("_stop"))
    whole = marked.groupBy(*keys).agg(F.struct(F.max(right).alias("_border"), F.count(F.lit(1)).alias("_seen")).alias("_whole"))
    per_bin = first.groupBy(*keys, "_bin").agg(F.min_by("_stop", "start").alias("_head"))
    line = Window.partitionBy(*keys).orderBy("_bin")
    per_bin = per_bin.select(*keys, "_bin", F.lead("_head").over(line).alias("_later"))
    near = Window.partitionBy(*keys, "_bin").orderBy("start")
    first = first.withColumn("_next", F.lead("_stop").over(near)).join(per_bin, [*keys, "_bin"]).join(whole, list(keys))
    stop = F.coalesce("_next", "_later", "_whole")
    return first.select(*keys, "start", stop["_border"].alias("end"), (stop["_seen"] - F.col("_stop._seen")).alias("n"))


def coverage(df: DataFrame, keys: Sequence[str], left: str = "left", right: str = "right", bin_size: int = BIN) -> DataFrame:
    """Stretches of constant depth above zero: ``keys, start, end, depth``.

    Starts count up, the position after each end counts down; equal positions
    are added up before anything is sorted.
    """
    up = df.select(*keys, F.col(left).alias("pos"), F.lit(1).alias("step"))
    down = df.select(*keys, (F.col(right) + 1).alias("pos"), F.lit(-1).alias("step"))
    events = up.unionByName(down).groupBy(*keys, "pos").agg(F.sum("step").alias("step")).where("step <> 0")
    events = written(events.withColumn("_bin", F.floor(F.col("pos") / bin_size)))
    depth = before(events, keys, "pos", ["pos"], {"_d": ("sum", F.col("step")), "_last": ("max", F.col("pos"))}, bin_size, events)
    return depth.where("_d > 0").select(*keys, F.col("_last").alias("start"), (F.col("pos") - 1).alias("end"), F.col("_d").alias("depth"))


def covered_stretches(df: DataFrame, keys: Sequence[str], least: int = 1, join: int = 5, bin_size: int = BIN) -> DataFrame:
    """Raw exons: stretches of depth ``least`` or more, joined over short gaps.

    Two stretches join if the next begins less than ``join`` after the last end.
    """
    if least == 1:
        # what is covered at all ends where the next interval begins ``join`` behind all before it: nothing is added up
        rows = df.select(*keys, "left", "right", F.floor(F.col("left") / bin_size).alias("_bin"))
        tops = written(rows.groupBy(*keys, "_bin").agg(F.max("right").alias("_top")))
        line = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        carry = tops.select(*keys, "_bin", F.max("_top").over(line).alias("_far"))
        near = Window.partitionBy(*keys, "_bin").orderBy("left").rowsBetween(Window.unboundedPreceding, -1)
        apart = lambda c: F.col(c).isNull() | (F.col("left") >= F.col(c) + join)
        first = rows.withColumn("_own", F.max("right").over(near)).where(apart("_own")).join(carry, [*keys, "_bin"]).where(apart("_far"))
        gaps = first.select(*keys, "_bin", F.col("left").alias("start"), F.greatest("_own", "_far").alias("_stop"))
        gaps = written(gaps)
        # what stands before the next one's first row ends this one; it only grows along the line, so a bin's least is its first
        heads = gaps.groupBy(*keys, "_bin").agg(F.min("_stop").alias("_head"))
        heads = heads.select(*keys, "_bin", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_bin")).alias("_later"))
        gaps = gaps.withColumn("_next", F.lead("_stop").over(Window.partitionBy(*keys, "_bin").orderBy("start")))
        whole = tops.groupBy(*keys).agg(F.max("_top").alias("_whole"))
        return gaps.join(heads, [*keys, "_bin"]).join(whole, list(keys)).select(*keys, "start", F.coalesce("_next", "_later", "_whole").alias("end"))
    deep = coverage(df, keys, bin_size=bin_size).where(F.col("depth") >= least)
    return islands(deep, keys, "start", "end", join - 2, bin_size).select(*keys, "start", "end")


def cut_at(exons: DataFrame, cuts: DataFrame, keys: Sequence[str], bin_size: int = JOIN_BIN) -> DataFrame:
    """Cut intervals at positions: ``keys, start, end`` pieces.

    ``cuts`` has ``pos``, the first base behind a cut.  The pieces of an
    interval tile it.
    """
    inside = overlap_join(
        exons.select(*keys, "start", "end"), cuts.select(*keys, "pos", F.col("pos").alias("pos_end")), keys,
        ("start", "end"), ("pos", "pos_end"), bin_size,
    ).where("pos > start").select(*keys, "start", "end", "pos")
    heads = exons.select(*keys, "start", "end", F.col("start").alias("pos"))
    w = Window.partitionBy(*keys, "start", "end").orderBy("pos")
    # dealt by interval, which serves the distinct rows and the window alike
    pieces = heads.unionByName(inside).repartition(*keys, "start", "end").distinct().withColumn("_next", F.lead("pos").over(w))
    return pieces.select(*keys, F.col("pos").alias("start"), F.coalesce(F.col("_next") - 1, F.col("end")).alias("end"))


def overlap_join(
    a: DataFrame, b: DataFrame, keys: Sequence[str], a_cols: tuple[str, str], b_cols: tuple[str, str], bin_size: int = JOIN_BIN
) -> DataFrame:
    """All pairs of rows whose closed intervals share a position.

    An equi-join on keys and bin: both sides are listed in each bin that they
    touch, and a pair counts in the bin of its first shared position only.
    """

    def binned(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.where(F.col(lo) <= F.col(hi)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor(F.col(hi) / bin_size))))

    (al, ar), (bl, br) = a_cols, b_cols
    joined = binned(a, al, ar).join(binned(b, bl, br), [*keys, "_bin"])
    meet = (F.col(al) <= F.col(br)) & (F.col(bl) <= F.col(ar))
    return joined.where(meet & (F.floor(F.greatest(al, bl) / bin_size) == F.col("_bin"))).drop("_bin")


def nearest(points: DataFrame, marks: DataFrame, keys: Sequence[str], most: int, bin_size: int = BIN) -> DataFrame:
    """Each point's nearest mark within ``most``; ties go to the upper one.

    ``points`` and ``marks`` have ``pos``; adds ``mark`` (null if none is near).
    A join on keys and bin with the marks listed in the bins they can serve.
    """
    reach = marks.select(*keys, F.col("pos").alias("mark")).distinct()
    reach = reach.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("mark") - most) / bin_size), F.floor((F.col("mark") + most) / bin_size))))
    held = points.select(*keys, "pos").distinct().withColumn("_bin", F.floor(F.col("pos") / bin_size))
    close = held.join(reach, [*keys, "_bin"]).where(F.abs(F.col("pos") - F.col("mark")) <= most)
    best = close.groupBy(*keys, "pos").agg(F.max_by("mark", F.struct(-F.abs(F.col("pos") - F.col("mark")), "mark")).alias("mark"))
    return points.join(best, [*keys, "pos"], "left")


def position_groups(marks: DataFrame, keys: Sequence[str], n_samples: int, merge: int = 1, least_percent: int = 30, bin_size: int = BIN) -> DataFrame:
    """Linear groups of boundary positions with enough evidence.

    ``marks`` has ``pos, sample_id, evidence``, and ``n`` if its rows are counted.  A group ends where the next
    position is over ``merge`` away; it stays if any mark has evidence and its
    samples are ``least_percent`` of all (whole percents).
    """
    # samples are rows throughout: sets of them would be sorted and not hashed
    at = marks.groupBy(*keys, "pos", "sample_id").agg(F.max("evidence").alias("evidence"), (F.sum("n") if "n" in marks.columns else F.count(F.lit(1))).alias("n"))
    at = runs(at, keys, "pos", merge, ["pos", "sample_id"], bin_size)
    fold = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.max("evidence").alias("evidence")]
    at = at.withColumns({"start": F.col("pos"), "end": F.col("pos")})
    pieces = run_ids(written(at.groupBy(*keys, "_bin", "_own", "sample_id").agg(*fold)), keys)
    found = pieces.groupBy(*keys, "_no", "sample_id").agg(*fold).groupBy(*keys, "_no").agg(*fold, F.count("sample_id").cast("int").alias("n_samples"))
    enough = F.floor(F.col("n_samples") * 100 / n_samples) >= least_percent
    return found.where(F.col("evidence") & enough).drop("_no", "evidence")


def without_nested(spans: DataFrame, inner: DataFrame, keys: Sequence[str], bin_size: int = BIN) -> DataFrame:
    """Drop rows with a gap that strictly holds a row at least as strong.

    ``spans`` has ``id, start, end, gaps, flow, score``; gaps are structs of
    left and right.  ``inner`` is the table of rows that may lie in gaps.
    """
    gaps = spans.select(*keys, F.col("id").alias("_id"), F.col("flow").alias("_flow"), F.col("score").alias("_score"), F.explode("gaps").alias("_g"))
    gaps = gaps.select(*keys, "_id", "_flow", "_score", F.col("_g.left").alias("_l"), F.col("_g.right").alias("_r"))
    held = inner.select(*keys, "id", "start", "end", "flow", "score")
    hit = overlap_join(gaps, held, keys, ("_l", "_r"), ("start", "end"), bin_size)
    hit = hit.where("id <> _id and start >= _l and end <= _r and flow >= _flow and score >= _score")
    return spans.join(hit.select(F.col("_id").alias("id")).distinct(), "id", "left_anti")


def away_from(points: DataFrame, fixed: DataFrame, keys: Sequence[str], most: int, bin_size: int = BIN) -> DataFrame:
    """Points with no fixed position within ``most``."""
    return nearest(points, fixed, keys, most, bin_size).where("mark is null").drop("mark")
