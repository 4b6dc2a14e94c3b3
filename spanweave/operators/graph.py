"""Graphs as tables: components, reduction, splice graphs and their pruning.

Every operator is a plan of joins and aggregations over ``nodes`` and ``arcs``;
loops write each round's table to the shared folder, so that a round costs one
plan and a lost executor one read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import reachable
from .tables import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the ends of undirected edges ``a, b``.

    The component is its smallest node.  Each round gives a node the least label
    of itself, its neighbours and its label's label, until nothing changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").toDF("a", "b").distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("l")).select(F.col("a").alias("node"), F.least("a", "l").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nxt = labels.join(seen, labels["node"] == seen["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("_old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        nxt = nxt.join(jump, "label").select("node", F.least("label", "far").alias("label"), "_old")
        nxt = written(nxt)
        changed = nxt.where("label <> _old").limit(1).count()
        labels = nxt.drop("_old")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def reduced(arcs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Without arcs a to c for which there are a to b and b to c."""
    first = arcs.select(*keys, "a", F.col("b").alias("_m"))
    second = arcs.select(*keys, F.col("a").alias("_m"), "b")
    two = first.join(second, [*keys, "_m"]).select(*keys, "a", "b")
    return arcs.join(two, [*keys, "a", "b"], "left_anti")


def splice_graph(atom_counts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs with counts from exon sets: ``exon_ids, sample_id, n``."""
    rows = atom_counts.select(*keys, "sample_id", "exon_ids", "n")
    nodes = rows.select(*keys, "sample_id", F.explode("exon_ids").alias("exon_id"), "n").groupBy(*keys, "exon_id", "sample_id").agg(F.sum("n").alias("n"))
    m = F.size("exon_ids")
    steps = F.arrays_zip(F.slice("exon_ids", 1, m - 1).alias("a"), F.slice("exon_ids", 2, m - 1).alias("b"))
    arcs = rows.where(m > 1).select(*keys, "sample_id", F.explode(steps).alias("_s"), "n")
    arcs = arcs.groupBy(*keys, F.col("_s.a").alias("a"), F.col("_s.b").alias("b"), "sample_id").agg(F.sum("n").alias("n"))
    return nodes, arcs


def linked(touched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, a, a_end, b, sample_id, n, bases``: how often each exon comes before each next one, null behind a read's last.

    ``touched`` has the reads' sorted ``exons``.  A read has one row per exon it touches, so
    sums over ``b`` are the exons' reads and bases, and rows with ``b`` are the arcs.
    """
    zipped = F.arrays_zip(F.col("exons"), F.slice(F.col("exons.exon_id"), 2, F.size("exons")).alias("b"))
    rows = touched.select(*keys, "sample_id", F.explode(zipped).alias("_s"))
    rows = rows.select(*keys, "sample_id", F.col("_s.exons.exon_id").alias("a"), F.col("_s.exons.exon_end").alias("a_end"), F.col("_s.b").alias("b"), F.col("_s.exons.bases").alias("bases"))
    return rows.groupBy(*keys, "a", "a_end", "b", "sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bases").alias("bases"))


def linked_nodes(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, start, end, sample_id, n, bases`` of the exons of :func:`linked`."""
    by = [*keys, F.col("a").alias("start"), F.col("a_end").alias("end"), "sample_id"]
    return links.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bases").alias("bases"))


def end_arcs(nodes: DataFrame, arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arcs from the source to nodes without an in-arc, and from those without an out-arc to the drain."""
    own = nodes.select(*keys, "exon_id").distinct()
    starts = own.join(arcs.select(*keys, F.col("b").alias("exon_id")).distinct(), [*keys, "exon_id"], "left_anti")
    ends = own.join(arcs.select(*keys, F.col("a").alias("exon_id")).distinct(), [*keys, "exon_id"], "left_anti")
    return starts.withColumn("kind", F.lit("source")).unionByName(ends.withColumn("kind", F.lit("drain")))


def small_junctions(arcs: DataFrame, nodes: DataFrame, keys: Sequence[str], n_samples: int, high_percent: int = 60) -> DataFrame:
    """Arcs whose two nodes both carry 2 w^2 + 18 or more, by a high vote.

    ``arcs`` has ``a, b, sample_id, n``, ``nodes`` has ``exon_id, sample_id, n``;
    a node without a row for the sample counts 0.
    """
    at = lambda c: nodes.select(*keys, F.col("exon_id").alias(c), "sample_id", F.col("n").alias(f"n_{c}"))
    seen = arcs.join(at("a"), [*keys, "a", "sample_id"], "left").join(at("b"), [*keys, "b", "sample_id"], "left")
    limit = 2 * F.col("n") * F.col("n") + 18
    hit = (F.coalesce("n_a", F.lit(0)) >= limit) & (F.coalesce("n_b", F.lit(0)) >= limit)
    votes = seen.groupBy(*keys, "a", "b").agg(F.sum(hit.cast("int")).alias("votes"))
    return votes.where(F.floor(F.col("votes") * 100 / n_samples) >= high_percent)


def without_dead_ends(arcs: DataFrame, sources: DataFrame, drains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arcs on some path from a source to a drain."""
    ahead = reachable(arcs, sources, keys)
    back = reachable(arcs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")), drains, keys)
    live = ahead.join(back, [*keys, "node"])
    at = lambda c: live.select(*keys, F.col("node").alias(c))
    return arcs.join(at("a"), [*keys, "a"], "left_semi").join(at("b"), [*keys, "b"], "left_semi").select(*arcs.columns)


def contained_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs ``inner, outer`` of exon sets where one is a stretch of the other.

    ``bins`` has ``exon_ids`` (sorted, without repeats) and no repeated rows.
    The outer set is listed at each of its exons and meets the sets that begin
    there, so only sets with a shared exon are held against each other.
    """
    outer = bins.select(*keys, F.col("exon_ids").alias("outer"), F.posexplode("exon_ids").alias("_at", "_first"))
    inner = bins.select(*keys, F.col("exon_ids").alias("inner"), F.get("exon_ids", F.lit(0)).alias("_first"))
    met = outer.join(inner, [*keys, "_first"]).where(F.size("inner") < F.size("outer"))
    return met.where(F.slice("outer", F.col("_at") + 1, F.size("inner")) == F.col("inner")).select(*keys, "inner", "outer")


def overlapping_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs ``left, right`` where a real suffix of one is a real prefix of the other."""
    left = bins.select(*keys, F.col("exon_ids").alias("left"), F.posexplode("exon_ids").alias("_at", "_first")).where("_at > 0")
    right = bins.select(*keys, F.col("exon_ids").alias("right"), F.get("exon_ids", F.lit(0)).alias("_first"))
    shared = F.size("left") - F.col("_at")
    met = left.join(right, [*keys, "_first"]).where(shared < F.size("right"))
    return met.where(F.slice("left", F.col("_at") + 1, shared) == F.slice("right", 1, shared)).select(*keys, "left", "right")


def heaviest_arcs(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each node's heaviest out-arc per sample, the nearest of equals."""
    best = F.max_by(F.struct("b", "n"), F.struct(F.col("n"), -F.col("b"))).alias("_x")
    return arcs.groupBy(*keys, "a", "sample_id").agg(best).select(*keys, "a", "sample_id", "_x.b", "_x.n")


def unary_arcs(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arcs that are the only one out of their start and the only one into their end."""
    own = arcs.select(*keys, "a", "b").distinct()
    out = own.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("_o")).where("_o = 1")
    into = own.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("_i")).where("_i = 1")
    return own.join(out, [*keys, "a"], "left_semi").join(into, [*keys, "b"], "left_semi").select(*keys, "a", "b")


def reduced_containment(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pairs ``inner, outer`` between which no third set stands."""
    step = held.select(*keys, F.col("inner").alias("outer"), F.col("outer").alias("_far"))
    through = held.join(step, [*keys, "outer"]).select(*keys, "inner", F.col("_far").alias("outer")).distinct()
    return held.join(through, [*keys, "inner", "outer"], "left_anti").select(*keys, "inner", "outer")


def split_bins(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``exon_ids, exon_id, left, right``: each set up to and from each inner exon, which both sides hold."""
    inner = F.slice("exon_ids", 2, F.size("exon_ids") - 2)
    cut = bins.where(F.size("exon_ids") > 2).select(*keys, "exon_ids", F.explode(inner).alias("exon_id"))
    sides = (F.filter("exon_ids", lambda x: x <= F.col("exon_id")), F.filter("exon_ids", lambda x: x >= F.col("exon_id")))
    return cut.select(*keys, "exon_ids", "exon_id", sides[0].alias("left"), sides[1].alias("right"))


def guided_arcs(arcs: DataFrame, keys: Sequence[str], sample: int) -> DataFrame:
    """Arcs (rows of all samples) that have a count in ``sample``."""
    own = arcs.where((F.col("sample_id") == sample) & (F.col("n") > 0)).select(*keys, "a", "b").distinct()
    return arcs.join(own, [*keys, "a", "b"], "left_semi")


def neighbour_capacities(arcs: DataFrame, means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``capacity`` of arcs between exons that adjoin.

    ``arcs`` has ``a, b, a_end, sample_id, n``, ``means`` has ``start, sample_id,
    mean``.  An arc takes of each exon's coverage the share that it has of that
    exon's arcs on this side, and never more than its own count.
    """
    by = [*keys, "sample_id"]
    outs = arcs.groupBy(*by, "a").agg(F.sum("n").alias("_out"))
    ins = arcs.groupBy(*by, "b").agg(F.sum("n").alias("_in"))
    at = lambda c: means.select(*by, F.col("start").alias(c), F.col("mean").alias(f"_{c}"))
    near = arcs.where(F.col("a_end") + 1 == F.col("b")).join(outs, [*by, "a"]).join(ins, [*by, "b"])
    near = near.join(at("a"), [*by, "a"]).join(at("b"), [*by, "b"])
    share = F.least(F.col("_a") * F.col("n") / F.col("_out"), F.col("_b") * F.col("n") / F.col("_in"), F.col("n").cast("double"))
    return near.select(*by, "a", "b", "n", share.alias("capacity"))


def _degrees(arcs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, a, b, a_end`` of every arc with its start's out-degree and its end's in-degree."""
    own = written(arcs.select(*keys, "a", "b", "a_end").distinct())
    n_out = own.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("n_out"))
    n_in = own.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n_in"))
    return own.join(n_out, [*keys, "a"]).join(n_in, [*keys, "b"])


def _each_sample(rows: DataFrame, samples: Sequence[int]) -> DataFrame:
    return rows.withColumn("sample_id", F.explode(F.array(*map(F.lit, samples))))


def low_boundaries(arcs: DataFrame, means: DataFrame, keys: Sequence[str], samples: Sequence[int], high_percent: int = 60) -> DataFrame:
    """Junctions that are the only way on from an exon, or into one, with coverage of 10 w^2 + 10 there.

    ``w`` is the arc's count, 0 where a sample has none.  ``to_drain`` and
    ``to_source`` tell which of its exons is left without a way.
    """
    by = [*keys, "sample_id"]
    each = _each_sample(_degrees(arcs, keys).where(F.col("a_end") + 1 != F.col("b")), samples)
    at = lambda c: means.select(*by, F.col("start").alias(c), F.col("mean").alias(f"_{c}"))
    seen = each.join(arcs.select(*by, "a", "b", "n"), [*by, "a", "b"], "left").join(at("a"), [*by, "a"], "left").join(at("b"), [*by, "b"], "left")
    w = F.coalesce("n", F.lit(0))
    hit = ((F.col("n_out") == 1) & (F.col("_a") >= 10 * w * w + 10)) | ((F.col("n_in") == 1) & (F.col("_b") >= 10 * w * w + 10))
    votes = seen.groupBy(*keys, "a", "b", "n_out", "n_in").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("votes"))
    out = votes.where(F.floor(F.col("votes") * 100 / len(samples)) >= high_percent)
    return out.select(*keys, "a", "b", "votes", (F.col("n_out") == 1).alias("to_drain"), (F.col("n_in") == 1).alias("to_source"))


def retained_introns(
    means: DataFrame, arcs: DataFrame, nodes: DataFrame, keys: Sequence[str], samples: Sequence[int], low_percent: int = 30
) -> DataFrame:
    """Exons ``m`` that adjoin ``a`` and ``b``, their only neighbours, where a direct arc from ``a`` to ``b`` is stronger.

    A sample votes for removal if it has no reads in ``m``, or has the direct arc
    and ``m`` has under 45 reads and 30 % of its coverage, or 2 reads at most.
    """
    by = [*keys, "sample_id"]
    own = written(_degrees(arcs, keys).where(F.col("a_end") + 1 == F.col("b")))
    into = own.where("n_in = 1").select(*keys, "a", F.col("b").alias("m"))
    on = own.where("n_out = 1").select(*keys, F.col("a").alias("m"), "b")
    middle = into.join(on, [*keys, "m"]).join(arcs.select(*keys, "a", "b").distinct(), [*keys, "a", "b"], "left_semi")
    each = _each_sample(middle, samples).join(arcs.select(*by, "a", "b", F.col("n").alias("_direct")), [*by, "a", "b"], "left")
    each = each.join(nodes.select(*by, F.col("exon_id").alias("m"), "n"), [*by, "m"], "left")
    each = each.join(means.select(*by, F.col("start").alias("m"), "mean"), [*by, "m"], "left")
    thin = ((F.col("n") < 45) & (F.col("mean") * 100 / F.col("_direct") < 30)) | (F.col("n") <= 2)
    hit = F.col("n").isNull() | (F.col("_direct").isNotNull() & thin)
    votes = each.groupBy(*keys, "a", "m", "b").agg(F.sum(F.when(hit, 1).otherwise(0)).alias("votes"))
    return votes.where(F.floor(F.col("votes") * 100 / len(samples)) >= low_percent)
