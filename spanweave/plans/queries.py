"""One query per operator over the alignment views, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alignment as A
from ..operators import asof, graph, intervals, pairs, quantify, reads
from ..operators.tables import written
from ..sources import text
from ..streaming import blocks
from . import fixtures
from .fixtures import ALIGNMENTS, FIXED, SAMPLES, TRANSCRIPTS

KEYS = ["chrom", "strand"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def aligned(sql: str) -> str:
    return f"with {ALIGNMENTS}{sql}"


def transcribed(sql: str) -> str:
    return f"with {TRANSCRIPTS}{sql}"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return reads.usable_segments(fixtures.alignments(spark, d))


@query(aligned("select read_id, sample_id, chrom, strand, pos, cigar from usable"))
def read_filter(spark, d):
    return reads.usable(fixtures.alignments(spark, d)).select("read_id", "sample_id", *KEYS, "pos", "cigar")


@query(aligned('select read_id, sample_id, chrom, strand, seg_no, "left", "right" from segs'))
def segments_explode(spark, d):
    return reads.exploded_segments(_segments(spark, d))


@query(aligned("""
select read_id, chrom, s as strand from (
  select *, case when flag & 1 = 1 and flag & 128 <> 0 then case when flag & 16 = 0 then '+' else '-' end
            else case when flag & 16 <> 0 then '+' else '-' end end as s from usable)
where xs is null or xs = s"""))
def strand_route(spark, d):
    return reads.stranded(reads.usable(fixtures.alignments(spark, d)).drop("strand")).select("read_id", "chrom", "strand")


@query(aligned("""
select chrom, strand, sample_id, blocks, count(*) as n, min(read_id) as first_read from (
  select read_id, chrom, strand, sample_id, string_agg("left" || '-' || "right", ',' order by seg_no) as blocks from segs group by all)
group by chrom, strand, sample_id, blocks"""))
def dup_collapse(spark, d):
    blocks = F.array_join(F.transform("segments", lambda s: F.concat_ws("-", s["left"].cast("string"), s["right"].cast("string"))), ",")
    return reads.collapsed(_segments(spark, d)).select(*KEYS, "sample_id", blocks.alias("blocks"), "n", "first_read")


@query(aligned("select chrom, strand, cast(jl as bigint) as jl, cast(jr as bigint) as jr, sample_id, n from juncs"))
def junction_counts(spark, d):
    return reads.junctions(_segments(spark, d))


@query(aligned("""
, tot as (select chrom, strand, jl, jr, cast(sum(n) as bigint) as n, count(distinct sample_id) as samples from juncs group by all),
w as (select *, max(n) over (partition by chrom, strand, jl) as ml, sum(n) over (partition by chrom, strand, jl) as sl,
             max(n) over (partition by chrom, strand, jr) as mr, sum(n) over (partition by chrom, strand, jr) as sr from tot),
h as (select *, samples < 2 or samples * 100 // 3 < 30 as few from w)
select chrom, strand, cast(jl as bigint) as jl, cast(jr as bigint) as jr, n, samples,
  not (few or (n <= 3 and ml > 10 and ml > 8 * n) or sl < 1) or not (few or (n <= 3 and mr > 10 and mr > 8 * n) or sr < 1) as valid
from h"""))
def junction_support(spark, d):
    found = reads.supported_junctions(reads.junctions(_segments(spark, d)), len(SAMPLES))
    return found.select(*KEYS, "jl", "jr", "n", "samples", "valid")


@query(aligned("select sample_id, count(*) as mapped, avg(seq_len) as read_length from alignments where flag & 4 = 0 group by all"))
def library_totals(spark, d):
    return reads.library_totals(fixtures.alignments(spark, d))


ISLANDS = """
, m as (select *, max("right") over (partition by chrom, strand order by "left", "right", read_id rows between unbounded preceding and 1 preceding) as border from plain),
k as (select *, sum(case when border is null or "left" > border + 6 then 1 else 0 end) over (partition by chrom, strand order by "left", "right", read_id) as no from m)
"""


@query(aligned(ISLANDS + 'select chrom, strand, min("left") as start, max("right") as "end", count(*) as n from k group by chrom, strand, no'))
def block_islands(spark, d):
    return intervals.islands(fixtures.plain(spark, d), KEYS)


SWEEP = """
, ev as (select chrom, strand, pos, cast(sum(step) as bigint) as step from (
    select chrom, strand, "left" as pos, 1 as step from {0} union all select chrom, strand, "right" + 1, -1 from {0}) group by all having sum(step) <> 0),
cov as (select chrom, strand, pos as start, lead(pos) over w - 1 as "end", cast(sum(step) over w as bigint) as depth from ev window w as (partition by chrom, strand order by pos)),
deep as (select * from cov where depth > 0)
"""
RAW = """
, dm as (select *, max("end") over (partition by chrom, strand order by start rows between unbounded preceding and 1 preceding) as border from deep),
dk as (select *, sum(case when border is null or start - border >= 5 then 1 else 0 end) over (partition by chrom, strand order by start) as no from dm),
exons as materialized (select chrom, strand, min(start) as start, max("end") as "end" from dk group by chrom, strand, no)
"""


@query(aligned(SWEEP.format("plain") + 'select chrom, strand, start, "end", depth from deep'))
def coverage_sweep(spark, d):
    return intervals.coverage(fixtures.plain(spark, d), KEYS)


@query(aligned(SWEEP.format("segs") + RAW + "select * from exons"))
def raw_exons(spark, d):
    return intervals.covered_stretches(reads.exploded_segments(_segments(spark, d)), KEYS)


CUTS = """
, cut as (select distinct chrom, strand, jl as pos from juncs union select distinct chrom, strand, jr + 1 from juncs),
points as (select chrom, strand, start, "end", start as pos from exons union
  select e.chrom, e.strand, e.start, e."end", c.pos from exons e join cut c on c.chrom = e.chrom and c.strand = e.strand and c.pos > e.start and c.pos <= e."end"),
parts as materialized (select chrom, strand, pos as start, coalesce(lead(pos) over (partition by chrom, strand, start order by pos) - 1, "end") as "end" from points)
"""


def _cut_reads(spark: SparkSession, d: str, *also: str) -> tuple[DataFrame, DataFrame]:
    """Exon pieces cut at junction ends, and the reads with their aligned stretches."""
    found = written(_segments(spark, d).select("read_id", "sample_id", *KEYS, *also, "segments"))
    exons = written(intervals.covered_stretches(reads.exploded_segments(found), KEYS))
    return written(intervals.cut_at(exons, reads.junction_cuts(found), KEYS)), found


def _pieces(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Exon pieces cut at junction ends, and the aligned stretches."""
    parts, found = _cut_reads(spark, d)
    return parts, reads.exploded_segments(found, before=True)


PIECES = SWEEP.format("segs") + RAW + CUTS


@query(aligned(PIECES + "select * from parts"))
def exon_segments(spark, d):
    return _pieces(spark, d)[0]


HITS = PIECES + """
, hits as materialized (select s.read_id, s.sample_id, s.seg_no, s."left", s."right", p.* from segs s join parts p
  on p.chrom = s.chrom and p.strand = s.strand and s."left" <= p."end" and p.start <= s."right")
"""


@query(aligned(HITS + 'select read_id, seg_no, chrom, strand, start, "end" from hits'))
def segment_exon_join(spark, d):
    parts, segs = _pieces(spark, d)
    return intervals.overlap_join(segs, parts, KEYS, ("left", "right"), ("start", "end")).select("read_id", "seg_no", *KEYS, "start", "end")


COVER = """select chrom, strand, start, "end", sample_id, count(distinct read_id) as n_reads,
  cast(sum(least("right", "end") - greatest("left", start) + 1) as bigint) as bases,
  round(cast(sum(least("right", "end") - greatest("left", start) + 1) as double) / ("end" - start + 1), 6) as mean_coverage
from hits group by chrom, strand, start, "end", sample_id"""


def _n_reads() -> F.Column:
    """Reads of a piece: a stretch doesn't count if the read's stretch before touches the piece as well."""
    return F.sum(F.when(F.col("prev_right") >= F.col("start"), 0).otherwise(1))


@query(aligned(HITS + COVER))
def exon_coverage(spark, d):
    """Coverage of every exon piece per sample: the flagship."""
    parts, segs = _pieces(spark, d)
    hit = intervals.overlap_join(segs, parts, KEYS, ("left", "right"), ("start", "end"))
    bases = F.sum(F.least("right", "end") - F.greatest("left", "start") + 1)
    out = hit.groupBy(*KEYS, "start", "end", "sample_id").agg(_n_reads().alias("n_reads"), bases.alias("bases"))
    return out.withColumn("mean_coverage", F.round(F.col("bases") / (F.col("end") - F.col("start") + 1), 6))


@query(aligned(HITS + """
select chrom, strand, start, "end", cast(max(depth) as bigint) as max_depth, cast(min(depth) as bigint) as min_depth,
  cast(sum(depth * n) as bigint) as bases, cast(sum(case when depth = 0 then n else 0 end) as bigint) as uncovered
from (
  select p.chrom, p.strand, p.start, p."end", c.depth, least(c."end", p."end") - greatest(c.start, p.start) + 1 as n
  from parts p join (select * from cov where "end" is not null) c on c.chrom = p.chrom and c.strand = p.strand and c.start <= p."end" and p.start <= c."end")
group by all having max(depth) > 0"""))
def node_statistics(spark, d):
    """Depth statistics of every covered exon piece over its coverage runs."""
    parts, segs = _pieces(spark, d)
    runs = intervals.coverage(segs, KEYS).select(*KEYS, F.col("start").alias("rs"), F.col("end").alias("re"), "depth")
    hit = intervals.overlap_join(parts, runs, KEYS, ("start", "end"), ("rs", "re"))
    n = F.least("re", "end") - F.greatest("rs", "start") + 1
    out = hit.groupBy(*KEYS, "start", "end").agg(
        F.max("depth").alias("max_depth"), F.min("depth").alias("low"), F.sum(F.col("depth") * n).alias("bases"), F.sum(n).alias("covered")
    )
    length = F.col("end") - F.col("start") + 1
    return out.select(
        *KEYS, "start", "end", "max_depth", F.when(F.col("covered") < length, F.lit(0)).otherwise(F.col("low")).cast("bigint").alias("min_depth"),
        "bases", (length - F.col("covered")).alias("uncovered"),
    )


BOUNDS = """
, ends as (
  select chrom, strand, sample_id, read_id, seg_no, 'START' as kind, "left" as pos from segs union all
  select chrom, strand, sample_id, read_id, seg_no, 'END', "right" from segs),
proven as (
  select read_id, jl - 1 as pos, 'END' as kind from gaps where jr is not null and not (seg_no = 0 and len < 10) and not (seg_no = n_segs - 2 and next_len < 10) union
  select read_id, jr + 1, 'START' from gaps where jr is not null and not (seg_no = 0 and len < 10) and not (seg_no = n_segs - 2 and next_len < 10)),
marks as materialized (select e.*, p.read_id is not null as evidence from ends e left join proven p on p.read_id = e.read_id and p.kind = e.kind and p.pos = e.pos)
"""
GROUPS = BOUNDS + """
, o as (select *, lag(pos) over (partition by chrom, strand, kind order by pos) as prev from (select distinct chrom, strand, kind, pos from marks)),
g as (select *, sum(case when prev is null or pos > prev + 1 then 1 else 0 end) over (partition by chrom, strand, kind order by pos) as no from o),
groups as materialized (
  select chrom, strand, kind, min(pos) as start, max(pos) as "end", count(*) as n, cast(count(distinct sample_id) as int) as n_samples
  from marks join g using (chrom, strand, kind, pos) group by chrom, strand, kind, no
  having bool_or(evidence) and count(distinct sample_id) * 100 // 3 >= 30)
"""


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return intervals.position_groups(reads.boundaries(_segments(spark, d)), [*KEYS, "kind"], len(SAMPLES))


@query(aligned(GROUPS + "select * from groups"))
def boundary_groups(spark, d):
    return _groups(spark, d)


CENTRES = GROUPS + FIXED + """
, c as materialized (select distinct chrom, strand, kind, cast(floor((start + "end") / 2.0) as bigint) as mark from groups)
"""


def _centres(spark: SparkSession, d: str, marks: DataFrame | None = None) -> DataFrame:
    """Clustered boundaries, from counted marks if there are such."""
    found = _groups(spark, d) if marks is None else intervals.position_groups(marks, [*KEYS, "kind"], len(SAMPLES))
    return found.select(*KEYS, "kind", F.floor((F.col("start") + F.col("end")) / 2).alias("pos")).distinct()


@query(aligned(CENTRES + """
, p as (select distinct chrom, strand, kind, pos from marks),
d as (
  select p.*, case when c1.mark is null or p.pos - c2.mark < c1.mark - p.pos then c2.mark else c1.mark end as near_c,
    case when f1.mark is null or p.pos - f2.mark < f1.mark - p.pos then f2.mark else f1.mark end as near_f
  from p asof left join c c1 on c1.chrom = p.chrom and c1.strand = p.strand and c1.kind = p.kind and p.pos <= c1.mark
    asof left join c c2 on c2.chrom = p.chrom and c2.strand = p.strand and c2.kind = p.kind and p.pos > c2.mark
    asof left join fixed f1 on f1.chrom = p.chrom and f1.strand = p.strand and f1.kind = p.kind and p.pos <= f1.mark
    asof left join fixed f2 on f2.chrom = p.chrom and f2.strand = p.strand and f2.kind = p.kind and p.pos > f2.mark)
select chrom, strand, kind, pos, case when abs(near_c - pos) <= 3 then near_c when abs(near_f - pos) <= 3 then near_f else -1 end as mark from d"""))
def nearest_boundary(spark, d):
    """Each stretch end's clustered boundary, or an annotated one where none is near, or -1."""
    counted = written(reads.boundary_counts(_segments(spark, d)))
    marks = counted.select(*KEYS, "kind", "pos").distinct()
    found = asof.nearest_mark(marks, _centres(spark, d, counted), fixtures.fixed_boundaries(spark, d), [*KEYS, "kind"], 3)
    return found.select(*KEYS, "kind", "pos", F.coalesce("mark", F.lit(-1)).alias("mark"))


PAIRS = """
, span as (select read_id, chrom, strand, sample_id, min("left") as "left", max("right") as "right" from segs group by all),
named as (select s.*, a.qname from span s join alignments a using (read_id)),
seq as (select *, row_number() over w as no, lead(read_id) over w as mate_read_id, lead("left") over w as mate_left, lead("right") over w as mate_right
  from named window w as (partition by qname, sample_id, s_chrom, s_strand order by "left", "right", read_id)),
pair as (select * from seq where no % 2 = 1 and mate_read_id is not null),
classed as (select *, case when mate_right <= "right" then 'nested' when mate_left <= "right" then 'overlapping' when mate_left = "right" + 1 then 'touching' else 'distant' end as class,
  greatest(mate_left - "right" - 1, 0) as gap from pair)
""".replace("select s.*, a.qname", "select s.*, s.chrom as s_chrom, s.strand as s_strand, a.qname")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.mates(_segments(spark, d))


@query(aligned(PAIRS + 'select qname, sample_id, chrom, strand, read_id, "left", "right", mate_read_id, mate_left, mate_right from pair'))
def mate_pairs(spark, d):
    return _pairs(spark, d)


@query(aligned(PAIRS + "select chrom, strand, class, count(*) as n, cast(sum(gap) as bigint) as gaps from classed group by all"))
def pair_classes(spark, d):
    return pairs.pair_classes(_pairs(spark, d)).groupBy(*KEYS, "class").agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("gaps"))


@query(aligned(PAIRS + "select chrom, strand, sample_id, count(*) as n_pairs, round(avg(gap), 6) as mean_gap from classed where class in ('touching', 'distant') group by all"))
def insert_size(spark, d):
    return pairs.insert_sizes(_pairs(spark, d)).withColumn("mean_gap", F.round("mean_gap", 6))


ATOMS = HITS + """
, atoms as materialized (select read_id, sample_id, chrom, strand, string_agg(distinct cast(start as varchar), ',' order by cast(start as varchar)) as x,
    array_to_string(list_sort(list_distinct(list(start))), ',') as exon_ids, min("left") as "left", max("right") as "right" from hits group by read_id, sample_id, chrom, strand)
""".replace("string_agg(distinct cast(start as varchar), ',' order by cast(start as varchar)) as x,\n    ", "")


def _touched(spark: SparkSession, d: str, *also: str) -> DataFrame:
    """Reads with the exon pieces that they touch."""
    parts, found = _cut_reads(spark, d, *also)
    return pairs.touched_exons(found, parts)


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    return _touched(spark, d).withColumn("exon_ids", F.col("exons.exon_id")).drop("exons")


@query(aligned(ATOMS + 'select chrom, strand, exon_ids, "left", "right", sample_id, count(*) as n from atoms group by all'))
def atom_counts(spark, d):
    ids = F.array_join(F.col("exon_ids").cast("array<string>"), ",")
    return pairs.fragments(_atoms(spark, d)).withColumn("exon_ids", ids)


@query(aligned(ATOMS + """
select chrom, strand, exon_ids, sample_id, kind, pos, count(*) as n from (
  select chrom, strand, exon_ids, sample_id, 'left' as kind, "left" as pos from atoms union all
  select chrom, strand, exon_ids, sample_id, 'right', "right" from atoms) group by all"""))
def atom_histograms(spark, d):
    ids = F.array_join(F.col("exon_ids").cast("array<string>"), ",")
    # few fragments repeat, so reads are counted by their ends at once
    return pairs.end_histograms(_atoms(spark, d).withColumn("n", F.lit(1))).withColumn("exon_ids", ids)


@query(aligned("""
, bad as (select distinct g.read_id from gaps g left join (
    select chrom, strand, jl, jr from juncs group by all having sum(n) >= 2) v
  on v.chrom = g.chrom and v.strand = g.strand and v.jl = g.jl and v.jr = g.jr where g.jr is not null and v.jl is null)
select s.read_id, seg_no, chrom, strand, "left", "right" from segs s anti join bad b on b.read_id = s.read_id"""))
def proven_reads(spark, d):
    found = _segments(spark, d)
    valid = reads.junctions(found).groupBy(*KEYS, "jl", "jr").agg(F.sum("n").alias("n")).where("n >= 2")
    return pairs.without_unproven(reads.exploded_segments(found), valid).select("read_id", "seg_no", *KEYS, "left", "right")


STEPS = ATOMS + """
, steps as (select chrom, strand, sample_id, unnest(list_zip(e[1:len(e)-1], e[2:len(e)])) as s from (
    select chrom, strand, sample_id, list_transform(string_split(exon_ids, ','), lambda z: cast(z as bigint)) as e from atoms)),
arcs as materialized (select chrom, strand, s[1] as a, s[2] as b, sample_id, count(*) as n from steps group by all),
nodes as materialized (select chrom, strand, exon_id, sample_id, count(*) as n from (
    select chrom, strand, sample_id, cast(unnest(string_split(exon_ids, ',')) as bigint) as exon_id from atoms) group by all)
"""


def _linked(touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and arcs of the splice graph."""
    links = written(graph.linked(touched, KEYS))
    nodes = graph.linked_nodes(links, KEYS).select(*KEYS, F.col("start").alias("exon_id"), "sample_id", "n")
    return nodes, links.where("b is not null").select(*KEYS, "a", "b", "sample_id", "n")


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return _linked(_touched(spark, d))


@query(aligned(STEPS + "select chrom, strand, a, b, sample_id, n from arcs"))
def splice_graph_basic(spark, d):
    return _graph(spark, d)[1]


@query(aligned(STEPS + """
select chrom, strand, exon_id, 'source' as kind from (select distinct chrom, strand, exon_id from nodes) x
  where not exists (select 1 from arcs where arcs.chrom = x.chrom and arcs.strand = x.strand and arcs.b = x.exon_id) union all
select chrom, strand, exon_id, 'drain' from (select distinct chrom, strand, exon_id from nodes) x
  where not exists (select 1 from arcs where arcs.chrom = x.chrom and arcs.strand = x.strand and arcs.a = x.exon_id)"""))
def source_drain_arcs(spark, d):
    nodes, arcs = _graph(spark, d)
    return graph.end_arcs(nodes, arcs, KEYS)


@query(aligned(STEPS + """
select chrom, strand, a, b, votes from (
  select r.chrom, r.strand, r.a, r.b, cast(sum(case when coalesce(x.n, 0) >= 2 * r.n * r.n + 18 and coalesce(y.n, 0) >= 2 * r.n * r.n + 18 then 1 else 0 end) as bigint) as votes
  from arcs r left join nodes x on x.chrom = r.chrom and x.strand = r.strand and x.exon_id = r.a and x.sample_id = r.sample_id
  left join nodes y on y.chrom = r.chrom and y.strand = r.strand and y.exon_id = r.b and y.sample_id = r.sample_id group by all)
where votes * 100 // 3 >= 60"""))
def prune_small_junction(spark, d):
    nodes, arcs = _graph(spark, d)
    return graph.small_junctions(arcs, nodes, KEYS, len(SAMPLES))


@query(aligned(STEPS + """
, e as (select distinct chrom, strand, a, b from arcs)
select chrom, strand, a, b from e where not exists (
  select 1 from e x join e y on x.chrom = y.chrom and x.strand = y.strand and x.b = y.a
  where x.chrom = e.chrom and x.strand = e.strand and x.a = e.a and y.b = e.b)"""))
def transitive_reduction(spark, d):
    arcs = _graph(spark, d)[1].select(*KEYS, "a", "b").distinct()
    return graph.reduced(arcs, KEYS)


@query(None)  # a recursive walk in SQL doesn't end on the whole table; held against brute force in tests
def components(spark, d):
    """Suppliers and parts linked by line items."""
    rows = fixtures.table(spark, d, "lineitem").where("l_suppkey is not null and l_partkey is not null")
    return graph.components(rows.select(F.col("l_suppkey").alias("a"), (F.lit(1_000_000_000_000) + F.col("l_partkey")).alias("b")))


@query(transcribed('select id, chrom, region_start, region_end from tx_regions'))
def region_merge(spark, d):
    return quantify.with_regions(fixtures.transcripts(spark, d), ["chrom"]).select("id", "chrom", "region_start", "region_end")


PASSING = """
, s as (select s.*, r.region_start from series s join tx_regions r on r.id = s.id and r.chrom = s.chrom),
t as (select *, max(mean) over (partition by chrom, region_start, sample_id) as top from s),
p as (select *, guided or (mean >= top * 10 / 100.0::double and (mean > 4 or score > 4) and score > 3 and top > 5.5 and length >= 200 + 50 * n_exons and not barred
  and (n_exons > 1 or (mean > 20 and length >= 300))) as passes from t)
"""


def _passing(spark: SparkSession, d: str) -> DataFrame:
    with_region = quantify.with_regions(written(fixtures.transcripts(spark, d).drop("exons")), ["chrom"])
    return quantify.passing(written(fixtures.sampled(with_region)), ["chrom"], percent=10.0)


@query(transcribed(PASSING + "select id, sample_id, region_start, passes from p"))
def region_maxima_filter(spark, d):
    return _passing(spark, d).select("id", "sample_id", "region_start", "passes")


@query(transcribed(PASSING + "select id, chrom, cast(sum(cast(passes as int)) as bigint) as votes from p group by all having sum(cast(passes as int)) * 100 // 3 > 30"))
def vote_consensus(spark, d):
    return quantify.voted(_passing(spark, d), len(SAMPLES), ["id", "chrom"])


NESTED = """
, tg as (select id, chrom, "end" + 1 as gl, lead(start) over (partition by id order by start) - 1 as gr from tx_exons),
killed as (select distinct i.id from transcripts i join tg on tg.id = i.id and tg.gr is not null join transcripts j
  on j.chrom = i.chrom and j.n_exons > 1 and j.id <> i.id and j.start >= tg.gl and j."end" <= tg.gr and j.flow >= i.flow and j.score >= i.score)
select id from transcripts where id not in (select id from killed)"""


@query(transcribed(NESTED))
def nested_filter(spark, d):
    t = fixtures.transcripts(spark, d)
    exons = F.transform("exons", lambda x: F.struct(x["start"].alias("left"), x["end"].alias("right")))
    t = t.withColumn("gaps", A.introns(exons))
    return intervals.without_nested(t, t.where("n_exons > 1"), ["chrom"]).select("id")


LIBS = ", libs as (select cast(l_linenumber % 3 as int) as sample_id, count(*) as mapped, avg(cast(l_quantity as bigint)) as read_length from lineitem group by all)"


@query(transcribed(LIBS + """
select id, sample_id, round(mean / (2 * read_length) / mapped * 1e9, 6) as fpkm,
  cast(case when mean > 0 then greatest(floor(mean * length / (2 * read_length)), 1) else floor(mean * length / (2 * read_length)) end as bigint) as reads
from series join libs using (sample_id)"""))
def fpkm(spark, d):
    libs = reads.library_totals(fixtures.alignments(spark, d))
    return quantify.abundances(fixtures.series(spark, d), libs).select("id", "sample_id", F.round("fpkm", 6).alias("fpkm"), "reads")


@query(transcribed(LIBS + """
, c as (select gene, id, length, sample_id, cast(case when mean > 0 then greatest(floor(mean * length / (2 * read_length)), 1) else 0 end as bigint) as reads
  from series join libs using (sample_id))
select gene, id, length, cast(sum(case when sample_id = 0 then reads else 0 end) as bigint) as s0, cast(sum(case when sample_id = 1 then reads else 0 end) as bigint) as s1,
  cast(sum(case when sample_id = 2 then reads else 0 end) as bigint) as s2 from c group by all"""))
def count_matrix(spark, d):
    libs = reads.library_totals(fixtures.alignments(spark, d))
    rows = quantify.abundances(fixtures.series(spark, d), libs)
    return quantify.matrix(rows, ["gene", "id", "length"], "reads", SAMPLES)


@query(aligned(HITS + """
, c as (select chrom, strand, start, "end", sample_id, count(distinct read_id) as n from hits group by all),
m as (select chrom, strand, start, "end", max(n) as top from c group by all)
select chrom, strand, start, "end", 'Exon' as feature,
  cast(sum(case when sample_id = 0 then top - n else 0 end) as bigint) as s0, cast(sum(case when sample_id = 1 then top - n else 0 end) as bigint) as s1,
  cast(sum(case when sample_id = 2 then top - n else 0 end) as bigint) as s2
from c join m using (chrom, strand, start, "end") group by all"""))
def error_matrix(spark, d):
    """How far each sample falls behind the best one, per exon piece."""
    parts, segs = _pieces(spark, d)
    hit = intervals.overlap_join(segs, parts, KEYS, ("left", "right"), ("start", "end"))
    by = [*KEYS, "start", "end"]
    counts = hit.groupBy(*by, "sample_id").agg(_n_reads().alias("n"))
    short = counts.withColumn("error", F.max("n").over(Window.partitionBy(*by)) - F.col("n"))
    return quantify.matrix(short.withColumn("feature", F.lit("Exon")), [*by, "feature"], "error", SAMPLES)


@query(transcribed("""
select chrom, gene, round(sum(mean * w) / sum(w), 6) as mean, cast(sum(w) as bigint) as weight from (
  select *, length as w from series) group by all"""))
def weighted_means(spark, d):
    rows = fixtures.series(spark, d).withColumn("weight", F.col("length"))
    return quantify.combined(rows, ["chrom", "gene"]).withColumn("mean", F.round("mean", 6))


@query(aligned("""
, c as (select chrom, strand, seq_len, count(*) as n from alignments group by all),
m as (select chrom, strand, max(n) as n from c group by all)
select chrom, strand, min(seq_len) as seq_len, n from c join m using (chrom, strand, n) group by all"""))
def common_read_length(spark, d):
    return quantify.common_value(fixtures.alignments(spark, d), KEYS, "seq_len")


@query("""
with x as (select p_partkey as id, 'g' || (p_partkey % 100) as gene, 't' || (p_partkey // 3) as tx, p_partkey * 400 as s, p_partkey * 400 + p_size + 49 as e from part where p_size % 5 <> 0)
select 'p' as chrom, '+' as strand, tx as transcript_id, min(gene) as gene_id, min(s) as start, max(e) as "end", count(*) as n_exons,
  string_agg(s || '-' || e, ',' order by s) as exons from x group by tx""")
def gtf_attributes(spark, d):
    """Annotation lines made of the parts, read as GTF and grouped."""
    p = fixtures.table(spark, d, "part")
    s, e = (F.col("p_partkey") * 400).cast("string"), (F.col("p_partkey") * 400 + F.col("p_size") + 49).cast("string")
    kind = F.when(F.col("p_size") % 5 == 0, "CDS").otherwise("exon")
    flip = F.col("p_partkey") % 11 == 0
    names = F.format_string('gene_id "g%d"; transcript_id "t%d"; note "x"', F.col("p_partkey") % 100, F.floor(F.col("p_partkey") / 3))
    line = F.concat_ws("\t", F.lit("p"), F.lit("db"), kind, F.when(flip, e).otherwise(s), F.when(flip, s).otherwise(e), F.lit("."), F.lit("+"), F.lit("."), names)
    found = text.guide_transcripts(text.gtf_exons(p.select(line.alias("value"))))
    blocks = F.array_join(F.transform("exons", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("chrom", "strand", "transcript_id", "gene_id", "start", "end", F.size("exons").cast("bigint").alias("n_exons"), blocks.alias("exons"))


@query("""
with m as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minute then 1 else 0 end as opens from events window w as (partition by user_id order by ts)),
k as (select *, sum(opens) over (partition by user_id order by ts, event_id) as no from m)
select user_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n from k group by user_id, no""")
def event_blocks(spark, d):
    return blocks.event_blocks(fixtures.table(spark, d, "events"))


BINS = ATOMS + """
, bins as (select distinct chrom, strand, list_transform(string_split(exon_ids, ','), lambda z: cast(z as bigint)) as e from atoms)
"""


def _bins(spark: SparkSession, d: str) -> DataFrame:
    return _atoms(spark, d).select(*KEYS, "exon_ids").distinct()


def _joined(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(aligned(BINS + """
select i.chrom, i.strand, array_to_string(i.e, ',') as "inner", array_to_string(o.e, ',') as "outer"
from bins i join bins o on o.chrom = i.chrom and o.strand = i.strand and len(i.e) < len(o.e) and list_contains(o.e, i.e[1])
where o.e[list_position(o.e, i.e[1]):list_position(o.e, i.e[1]) + len(i.e) - 1] = i.e"""))
def bin_containment(spark, d):
    return graph.contained_bins(_bins(spark, d), KEYS).select(*KEYS, _joined("inner"), _joined("outer"))


@query(aligned(BINS + """
select l.chrom, l.strand, array_to_string(l.e, ',') as "left", array_to_string(r.e, ',') as "right"
from bins l join bins r on l.chrom = r.chrom and l.strand = r.strand and list_position(l.e, r.e[1]) > 1
where len(l.e) - list_position(l.e, r.e[1]) + 1 < len(r.e)
  and l.e[list_position(l.e, r.e[1]):len(l.e)] = r.e[1:len(l.e) - list_position(l.e, r.e[1]) + 1]"""))
def bin_overlap(spark, d):
    return graph.overlapping_bins(_bins(spark, d), KEYS).select(*KEYS, _joined("left"), _joined("right"))


@query(aligned(STEPS + """
select chrom, strand, a, sample_id, b, n from (
  select *, row_number() over (partition by chrom, strand, a, sample_id order by n desc, b) as rk from arcs) where rk = 1"""))
def heaviest_arc(spark, d):
    return graph.heaviest_arcs(_graph(spark, d)[1], KEYS)


@query(aligned(STEPS + """
, own as (select distinct chrom, strand, a, b from arcs)
select chrom, strand, a, b from (
  select *, count(*) over (partition by chrom, strand, a) as o, count(*) over (partition by chrom, strand, b) as i from own) where o = 1 and i = 1"""))
def unary_chain_arcs(spark, d):
    return graph.unary_arcs(_graph(spark, d)[1], KEYS)


@query(aligned(BOUNDS + """
, p as (select distinct chrom, strand, kind, pos from marks)
select p.* from p where not exists (
  select 1 from part where p.pos between p_partkey * 400 + 9 and p_partkey * 400 + 11)"""))
def boundaries_off_known(spark, d):
    """Boundaries that no annotated one, one position to either side, explains."""
    marks = reads.boundaries(_segments(spark, d)).select(*KEYS, "kind", "pos").distinct()
    known = fixtures.table(spark, d, "part").select(F.lit(0).alias("k"), (F.col("p_partkey") * 400 + 10).alias("pos"))
    return intervals.away_from(marks.withColumn("k", F.lit(0)), known, ["k"], 1).select(*KEYS, "kind", "pos")


@query(transcribed("""
, whole as (
  select chrom, id, 0 as no, chrom || chr(9) || 'spanweave' || chr(9) || 'transcript' || chr(9) || start || chr(9) || "end" || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9)
    || 'gene_id "g' || gene || '"; transcript_id "t' || id || '"; FPKM "' || printf('%.6f', flow::double) || '"; cov "' || printf('%.6f', mean) || '";' as value from transcripts),
parts as (
  select chrom, id, row_number() over (partition by id order by start) as no, chrom || chr(9) || 'spanweave' || chr(9) || 'exon' || chr(9) || start || chr(9) || "end" || chr(9) || '.' || chr(9) || '+'
    || chr(9) || '.' || chr(9) || 'gene_id "g' || gene || '"; transcript_id "t' || id || '";' as value from tx_exons)
select value from whole union all select value from parts"""))
def gtf_output(spark, d):
    """Every transcript and exon as a GTF line."""
    t = fixtures.transcripts(spark, d).select(
        "chrom", F.lit("+").alias("strand"), F.format_string("g%d", "gene").alias("gene_id"), F.format_string("t%d", "id").alias("transcript_id"),
        F.col("flow").alias("fpkm"), F.col("mean").alias("cov"), "exons",
    )
    return text.gtf_lines(t).select("value")
