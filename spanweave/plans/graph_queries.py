"""Queries over splice graphs with coverage: scaling, reductions, set operations, count rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, pairs, quantify
from ..operators.tables import written
from .fixtures import SAMPLES
from .queries import ATOMS, BINS, KEYS, PAIRS, STEPS, _bins, _joined, _touched, aligned, query

MEANS = """
, means as (select chrom, strand, start, "end", sample_id,
    cast(sum(least("right", "end") - greatest("left", start) + 1) as double) / ("end" - start + 1) as mean
    from hits group by chrom, strand, start, "end", sample_id)
"""


def _coverage_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean coverage of exons per sample, arcs with their reads and ``a_end``, and the reads of exons."""
    links = written(graph.linked(_touched(spark, d), KEYS))
    nodes = written(graph.linked_nodes(links, KEYS))
    means = nodes.select(*KEYS, "start", "end", "sample_id", (F.col("bases") / (F.col("end") - F.col("start") + 1)).alias("mean"))
    arcs = links.where("b is not null").select(*KEYS, "a", "a_end", "b", "sample_id", "n")
    return means, arcs, nodes.select(*KEYS, F.col("start").alias("exon_id"), "sample_id", "n")


def _spread(samples) -> str:
    return ", ".join(f"round(coalesce(sum(case when sample_id = {s} then value end), 0), 6) as s{s}" for s in samples)


@query(aligned(STEPS + MEANS + f"""
select chrom, kind, strand, start, "end", {_spread(SAMPLES)} from (
  select chrom, 'Exon' as kind, strand, start, "end", sample_id, mean as value from means union all
  select r.chrom, 'Splice', r.strand, p."end", r.b, r.sample_id, cast(r.n as double)
    from arcs r join parts p on p.chrom = r.chrom and p.strand = r.strand and p.start = r.a)
group by chrom, kind, strand, start, "end" """))
def exon_count_rows(spark, d):
    """A row for each exon (mean coverage) and each splice (reads), a column for each sample."""
    means, arcs, _ = _coverage_graph(spark, d)
    exons = means.select("chrom", F.lit("Exon").alias("kind"), "strand", "start", "end", "sample_id", F.col("mean").alias("value"))
    splices = arcs.select("chrom", F.lit("Splice").alias("kind"), "strand", F.col("a_end").alias("start"), F.col("b").alias("end"), "sample_id", F.col("n").cast("double").alias("value"))
    by = ["chrom", "kind", "strand", "start", "end"]
    wide = quantify.matrix(exons.unionByName(splices), by, "value", SAMPLES)
    return wide.select(*by, *[F.round(F.col(f"s{s}"), 6).alias(f"s{s}") for s in SAMPLES])


@query(aligned(STEPS + MEANS + """
, outs as (select chrom, strand, a, sample_id, sum(n) as total from arcs group by all),
ins as (select chrom, strand, b, sample_id, sum(n) as total from arcs group by all)
select r.chrom, r.strand, r.a, r.b, r.sample_id, r.n,
  round(least(x.mean * r.n / o.total, y.mean * r.n / i.total, cast(r.n as double)), 6) as capacity
from arcs r join means x on x.chrom = r.chrom and x.strand = r.strand and x.start = r.a and x.sample_id = r.sample_id and x."end" + 1 = r.b
  join means y on y.chrom = r.chrom and y.strand = r.strand and y.start = r.b and y.sample_id = r.sample_id
  join outs o on o.chrom = r.chrom and o.strand = r.strand and o.a = r.a and o.sample_id = r.sample_id
  join ins i on i.chrom = r.chrom and i.strand = r.strand and i.b = r.b and i.sample_id = r.sample_id"""))
def neighbour_scaling(spark, d):
    """Arcs between adjoining exons, held to their share of both exons' coverage."""
    means, arcs, _ = _coverage_graph(spark, d)
    scaled = graph.neighbour_capacities(arcs, means, KEYS)
    return scaled.select(*KEYS, "a", "b", "sample_id", "n", F.round("capacity", 6).alias("capacity"))


@query(aligned(BINS + """
, held as (select i.chrom, i.strand, array_to_string(i.e, ',') as "inner", array_to_string(o.e, ',') as "outer"
  from bins i join bins o on o.chrom = i.chrom and o.strand = i.strand and len(i.e) < len(o.e) and list_contains(o.e, i.e[1])
  where o.e[list_position(o.e, i.e[1]):list_position(o.e, i.e[1]) + len(i.e) - 1] = i.e),
through as (select distinct x.chrom, x.strand, x."inner", y."outer" from held x join held y on y.chrom = x.chrom and y.strand = x.strand and y."inner" = x."outer")
select * from held except all select * from through"""))
def smallest_containers(spark, d):
    """Exon sets with the sets that hold them, without those that hold another holder."""
    held = written(graph.contained_bins(_bins(spark, d), KEYS))
    return graph.reduced_containment(held, KEYS).select(*KEYS, _joined("inner"), _joined("outer"))


@query(aligned(BINS + """
, cuts as (select chrom, strand, e, unnest(e[2:len(e) - 1]) as exon_id from bins where len(e) > 2)
select chrom, strand, array_to_string(e, ',') as exon_ids, exon_id, array_to_string(list_filter(e, lambda x: x <= exon_id), ',') as "left",
  array_to_string(list_filter(e, lambda x: x >= exon_id), ',') as "right" from cuts"""))
def bin_splits(spark, d):
    """Both sides of each exon set at each of its inner exons."""
    return graph.split_bins(_bins(spark, d), KEYS).select(*KEYS, _joined("exon_ids"), "exon_id", _joined("left"), _joined("right"))


@query(aligned(STEPS + "select * from arcs r where exists (select 1 from arcs g where g.chrom = r.chrom and g.strand = r.strand and g.a = r.a and g.b = r.b and g.sample_id = 0)"))
def guiding_sample_arcs(spark, d):
    """Arcs that carry reads of the guiding sample, with the counts of all samples."""
    _, arcs, _ = _coverage_graph(spark, d)
    return graph.guided_arcs(arcs, KEYS, SAMPLES[0]).select(*KEYS, "a", "b", "sample_id", "n")


MATES = ATOMS + PAIRS[PAIRS.index(", "):] + """
select p.qname, p.sample_id, p.chrom, p.strand, p.read_id, p.mate_read_id,
  array_to_string(list_sort(list_distinct(list_concat(x.e, y.e))), ',') as exon_ids, not list_has_any(x.e, y.e) as disjoint
from pair p
  join (select read_id, list_transform(string_split(exon_ids, ','), lambda z: cast(z as bigint)) as e from atoms) x on x.read_id = p.read_id
  join (select read_id, list_transform(string_split(exon_ids, ','), lambda z: cast(z as bigint)) as e from atoms) y on y.read_id = p.mate_read_id"""


@query(aligned(MATES))
def mate_exon_sets(spark, d):
    """The exons that both mates of a pair touch together, and whether the mates share none."""
    ids = _touched(spark, d, "qname").withColumn("exon_ids", F.col("exons.exon_id"))
    met = pairs.paired(ids.drop("exons"), ["exon_ids"])
    own, mate = F.col("exon_ids"), F.col("mate_exon_ids")
    out = met.withColumn("disjoint", ~F.arrays_overlap(own, mate)).withColumn("exon_ids", F.array_sort(F.array_union(own, mate)))
    return out.select("qname", "sample_id", *KEYS, "read_id", "mate_read_id", _joined("exon_ids"), "disjoint")


DEGREES = STEPS + MEANS + """
, own as (select distinct r.chrom, r.strand, r.a, r.b, p."end" as a_end from arcs r join parts p on p.chrom = r.chrom and p.strand = r.strand and p.start = r.a),
degrees as (select *, count(*) over (partition by chrom, strand, a) as n_out, count(*) over (partition by chrom, strand, b) as n_in from own),
each as (select g.*, s.sample_id from degrees g cross join (select unnest([0, 1, 2]) as sample_id) s)
"""


@query(aligned(DEGREES + """
select chrom, strand, a, b, votes, n_out = 1 as to_drain, n_in = 1 as to_source from (
  select e.chrom, e.strand, e.a, e.b, e.n_out, e.n_in, cast(sum(case when
      (e.n_out = 1 and coalesce(x.mean, 0) >= 10 * coalesce(r.n, 0) * coalesce(r.n, 0) + 10) or
      (e.n_in = 1 and coalesce(y.mean, 0) >= 10 * coalesce(r.n, 0) * coalesce(r.n, 0) + 10) then 1 else 0 end) as bigint) as votes
  from each e left join arcs r on r.chrom = e.chrom and r.strand = e.strand and r.a = e.a and r.b = e.b and r.sample_id = e.sample_id
    left join means x on x.chrom = e.chrom and x.strand = e.strand and x.start = e.a and x.sample_id = e.sample_id
    left join means y on y.chrom = e.chrom and y.strand = e.strand and y.start = e.b and y.sample_id = e.sample_id
  where e.a_end + 1 <> e.b group by all) where votes * 100 // 3 >= 60"""))
def prune_low_boundary(spark, d):
    """Lone junctions beside far deeper exons, by a high vote."""
    means, arcs, _ = _coverage_graph(spark, d)
    return graph.low_boundaries(arcs, means, KEYS, SAMPLES)


@query(aligned(DEGREES + """
, middle as (select x.chrom, x.strand, x.a, x.b as m, y.b from degrees x join degrees y on y.chrom = x.chrom and y.strand = x.strand and y.a = x.b
  where x.a_end + 1 = x.b and y.a_end + 1 = y.b and x.n_in = 1 and y.n_out = 1),
votes as (
  select i.chrom, i.strand, i.a, i.m, i.b, cast(sum(case when v.n is null then 1
      when r.n is not null and ((v.n < 45 and e.mean * 100 / r.n < 30) or v.n <= 2) then 1 else 0 end) as bigint) as votes
  from middle i join own o on o.chrom = i.chrom and o.strand = i.strand and o.a = i.a and o.b = i.b
    cross join (select unnest([0, 1, 2]) as sample_id) s
    left join arcs r on r.chrom = i.chrom and r.strand = i.strand and r.a = i.a and r.b = i.b and r.sample_id = s.sample_id
    left join nodes v on v.chrom = i.chrom and v.strand = i.strand and v.exon_id = i.m and v.sample_id = s.sample_id
    left join means e on e.chrom = i.chrom and e.strand = i.strand and e.start = i.m and e.sample_id = s.sample_id
  group by all)
select * from votes where votes * 100 // 3 >= 30"""))
def prune_retained_intron(spark, d):
    """Exons that fill the gap of a direct splice and are thin beside it, by a low vote."""
    return graph.retained_introns(*_coverage_graph(spark, d), KEYS, SAMPLES)
