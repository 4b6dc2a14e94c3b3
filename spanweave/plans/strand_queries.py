"""Queries over reads without a known strand, and over what speaks for an exon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, pairs, reads, strands
from ..operators.tables import written
from . import fixtures
from .queries import ATOMS, KEYS, PAIRS, _cut_reads, aligned, query

ROUTED = """
, spans as materialized (
  select s.read_id, s.sample_id, s.chrom, a.xs, min(s."left") as "left", max(s."right") as "right", count(*) > 1 as spliced
  from segs s join alignments a on a.read_id = s.read_id group by all),
signed_marks as (
  select *, case when max("right") over w + 6 >= "left" then 0 else 1 end as opens from spans where xs is not null
  window w as (partition by chrom, xs order by "left", "right", read_id rows between unbounded preceding and 1 preceding)),
signed as materialized (
  select chrom, xs as strand, min("left") as start, max("right") as "end" from (
    select *, sum(opens) over (partition by chrom, xs order by "left", "right", read_id) as no from signed_marks) group by chrom, xs, no),
met as (
  select r.read_id, bool_or(i.strand = '+') as plus, bool_or(i.strand = '-') as minus
  from spans r join signed i on i.chrom = r.chrom and r."left" >= i.start and r."left" <= i."end" where r.xs is null and not r.spliced group by all),
routed as materialized (
  select read_id, sample_id, chrom, xs as strand, xs, "left", "right" from spans where xs is not null union all
  select r.read_id, r.sample_id, r.chrom, t.strand, r.xs, r."left", r."right"
  from spans r left join met m on m.read_id = r.read_id cross join (select unnest(['+', '-']) as strand) t
  where r.xs is null and not r.spliced and case t.strand
    when '+' then coalesce(m.plus, false) or not coalesce(m.minus, false) else coalesce(m.minus, false) or not coalesce(m.plus, false) end)
"""


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return written(strands.routed(reads.usable_segments(fixtures.alignments(spark, d))))


@query(aligned(ROUTED + 'select read_id, sample_id, chrom, strand, "left", "right" from routed'))
def unstranded_routing(spark, d):
    """Each read of an unstranded library on the strand, or strands, that it is counted on."""
    return _routed(spark, d).select("read_id", "sample_id", "chrom", "strand", "left", "right")


@query(aligned(ROUTED + """
, marked_routes as (
  select *, case when max("right") over w + 6 >= "left" then 0 else 1 end as opens from routed
  window w as (partition by chrom, strand order by "left", "right", read_id rows between unbounded preceding and 1 preceding)),
found as materialized (
  select chrom, strand, min("left") as start, max("right") as "end", count(*) as n,
    count(*) filter (where xs = strand) as own, cast(coalesce(bool_or(xs = strand and "left" = first_left), false) as int) as opened
  from (select *, min("left") over (partition by chrom, strand, no) as first_left from (
    select *, sum(opens) over (partition by chrom, strand order by "left", "right", read_id) as no from marked_routes))
  group by chrom, strand, no),
against as (
  select distinct f.chrom, f.strand, f.start from found f join spans r on r.chrom = f.chrom and r."left" >= f.start and r."left" <= f."end" and r.xs <> f.strand)
select f.chrom, f.strand, f.start, f."end", f.n, own - opened > 0 as evidence, a.start is not null as discouraged, own - opened > 0 or a.start is null as kept
from found f left join against a on a.chrom = f.chrom and a.strand = f.strand and a.start = f.start"""))
def strand_islands(spark, d):
    """Islands of both strands, and whether the reads that begin in them let them stay."""
    return strands.judged_islands(_routed(spark, d))


@query(aligned(ATOMS + PAIRS[PAIRS.index(", "):] + """
, sets as materialized (select read_id, sample_id, chrom, strand, list_transform(string_split(exon_ids, ','), lambda z: cast(z as bigint)) as e from atoms),
across as (select chrom, strand, exon_id, sample_id, count(*) as n from (
  select chrom, strand, sample_id, unnest(e[2:len(e) - 1]) as exon_id from sets where len(e) > 2) group by all),
around as (
  select p.chrom, p.strand, p.sample_id, case when len(x.e) > 1 then x.e[len(x.e)] else x.e[len(x.e)] + 1 end as lo, case when len(y.e) > 1 then y.e[1] else y.e[1] - 1 end as hi
  from pair p join sets x on x.read_id = p.read_id join sets y on y.read_id = p.mate_read_id where x.e[len(x.e)] < y.e[1]),
spanned as (
  select x.chrom, x.strand, x.start as exon_id, g.sample_id, count(*) as n from (select distinct chrom, strand, start from parts) x
  join around g on g.chrom = x.chrom and g.strand = x.strand and x.start >= g.lo and x.start <= g.hi group by all)
select coalesce(c.chrom, s.chrom) as chrom, coalesce(c.strand, s.strand) as strand, coalesce(c.exon_id, s.exon_id) as exon_id, coalesce(c.sample_id, s.sample_id) as sample_id,
  cast(coalesce(c.n, 0) as bigint) as crossing, cast(coalesce(s.n, 0) as bigint) as spanning
from across c full join spanned s on s.chrom = c.chrom and s.strand = c.strand and s.exon_id = c.exon_id and s.sample_id = c.sample_id"""))
def exon_evidence(spark, d):
    """Reads across each exon and pairs around it, per sample."""
    parts, found = _cut_reads(spark, d, "qname")
    ids = written(pairs.touched_exons(found, parts).withColumn("exon_ids", F.col("exons.exon_id")).drop("exons"))
    crossing = evidence.crossing_reads(ids.withColumn("n", F.lit(1)), KEYS)
    spanning = evidence.spanned(evidence.between_mates(ids, KEYS), parts.select(*KEYS, F.col("start").alias("exon_id")), KEYS)
    return evidence.counted_together(crossing, spanning, KEYS)
