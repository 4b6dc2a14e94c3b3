"""Alignment-shaped views of the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = (0, 1, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as an alignment record."""
    q = F.col("l_quantity").cast("bigint")
    half = F.floor((q + 1) / 2)
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    kind = F.col("l_partkey") % 4
    text = lambda *a: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in a])
    cigar = (
        F.when(kind == 0, text(half, "M", 20 + F.col("l_suppkey") % 3, "N", q - half + 1, "M"))
        .when(kind == 1, text("3S", q, "M"))
        .when(kind == 2, text(q, "M2I5M1D4M"))
        .otherwise(text(q, "M", 2 + F.col("l_suppkey") % 4, "N7M"))
    )
    first = F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(128)
    back = F.when(F.col("l_orderkey") % 2 == 1, 16).otherwise(0)
    flag = F.when(F.col("l_suppkey") % 17 == 0, 256).otherwise(1 + first + back)
    return table(spark, sf_dir, "lineitem").select(
        ((((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 20000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")) * 64 + q).cast("bigint").alias("read_id"),
        (F.col("l_linenumber") % 3).cast("int").alias("sample_id"),
        F.col("l_returnflag").alias("chrom"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
        (F.col("l_partkey") * 400 + days % 97).cast("bigint").alias("pos"),
        F.when(F.col("l_suppkey") % 13 == 0, 0).otherwise(60).alias("mapq"),
        flag.cast("int").alias("flag"),
        cigar.alias("cigar"),
        F.col("l_orderkey").cast("string").alias("qname"),
        F.when(F.col("l_suppkey") % 5 != 0, F.when(F.col("l_linestatus") == "O", "+").otherwise("-")).alias("xs"),
        q.cast("int").alias("seq_len"),
    )


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as closed intervals without gaps."""
    a = alignments(spark, sf_dir)
    return a.select("read_id", "sample_id", "chrom", "strand", F.col("pos").alias("left"), (F.col("pos") + F.col("seq_len") - 1).alias("right"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a transcript: its lines are exons."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    start = (F.col("o_custkey") * 2000 + F.col("l_linenumber") * 300).cast("bigint")
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_orderkey").cast("bigint").alias("id"), F.col("o_orderstatus").alias("chrom"),
        F.struct(start.alias("start"), (start + 49 + 2 * F.col("l_quantity").cast("bigint")).alias("end")).alias("exon"),
        F.col("l_quantity").cast("bigint").alias("q"), (F.col("o_custkey") % 50).cast("bigint").alias("gene"),
    )
    out = rows.groupBy("id", "chrom", "gene").agg(F.array_sort(F.collect_list("exon")).alias("exons"), F.sum("q").alias("flow"), F.max("q").alias("top"))
    length = F.aggregate("exons", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"] + 1)
    return out.select(
        "id", "chrom", "gene", "exons", "flow", F.get("exons", F.lit(0))["start"].alias("start"), F.element_at("exons", -1)["end"].alias("end"),
        F.size("exons").alias("n_exons"), length.alias("length"), (F.col("flow") / 4.0).alias("mean"), (F.col("top") / 5.0).alias("score"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three samples of each transcript; each sample sees another share of it."""
    return sampled(transcripts(spark, sf_dir))


def sampled(found: DataFrame) -> DataFrame:
    """A row of each transcript for each sample."""
    t = found.select("*", F.explode(F.array(*map(F.lit, SAMPLES))).alias("sample_id"))
    share = F.element_at(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25)), ((F.col("id") + F.col("sample_id")) % 3 + 1).cast("int"))
    return t.withColumn("mean", F.col("mean") * share).withColumn("score", F.col("score") * share).withColumn("guided", F.col("id") % 40 == 0).withColumn(
        "barred", F.col("id") % 31 == 0
    )


ALIGNMENTS = """
raw as (
  select *, cast(l_quantity as bigint) as q, cast(floor((cast(l_quantity as bigint) + 1) / 2) as bigint) as half from lineitem),
alignments as materialized (
  select (((l_orderkey * 8 + l_linenumber) * 20000 + l_partkey) * 1000 + l_suppkey) * 64 + q as read_id, cast(l_linenumber % 3 as int) as sample_id, l_returnflag as chrom,
    case when l_linestatus = 'O' then '+' else '-' end as strand,
    l_partkey * 400 + (cast(l_shipdate as date) - date '1992-01-01') % 97 as pos,
    case when l_suppkey % 13 = 0 then 0 else 60 end as mapq,
    cast(case when l_suppkey % 17 = 0 then 256 else 1 + case when l_linenumber % 2 = 1 then 64 else 128 end + case when l_orderkey % 2 = 1 then 16 else 0 end end as int) as flag,
    case l_partkey % 4
      when 0 then half || 'M' || (20 + l_suppkey % 3) || 'N' || (q - half + 1) || 'M'
      when 1 then '3S' || q || 'M'
      when 2 then q || 'M2I5M1D4M'
      else q || 'M' || (2 + l_suppkey % 4) || 'N7M' end as cigar,
    cast(l_orderkey as varchar) as qname,
    case when l_suppkey % 5 <> 0 then case when l_linestatus = 'O' then '+' else '-' end end as xs,
    cast(q as int) as seq_len
  from raw),
plain as (
  select read_id, sample_id, chrom, strand, pos as "left", pos + seq_len - 1 as "right" from alignments),
ops as materialized (
  select *, cast(regexp_extract(tok, '^[0-9]+') as bigint) as n, right(tok, 1) as op from (
    select *, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) as tok,
      unnest(range(1, len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) + 1)) as no from alignments)),
bad_ops as (
  select distinct read_id from (select *, max(no) over (partition by read_id) as last from ops)
  where (op = 'N' and n > 1000000) or (op = 'M' and n < 3 and no > 1 and no < last)),
usable as materialized (
  select a.* from alignments a anti join bad_ops b on b.read_id = a.read_id where a.flag & 260 = 0 and a.mapq >= 1),
pieces as (
  select read_id, sample_id, chrom, strand, s as "left", s + n - 1 as "right", no from (
    select *, pos + coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then n else 0 end)
      over (partition by read_id order by no rows between unbounded preceding and 1 preceding), 0) as s from ops)
  where op in ('M', 'D', '=', 'X')),
marked as (
  select *, sum(case when prev is null or "left" - prev >= 5 then 1 else 0 end) over (partition by read_id order by no) as grp from (
    select *, lag("right") over (partition by read_id order by no) as prev from pieces)),
segs as materialized (
  select read_id, sample_id, chrom, strand, cast(grp - 1 as int) as seg_no, cast(min("left") as bigint) as "left", cast(max("right") as bigint) as "right"
  from marked m semi join usable u on u.read_id = m.read_id group by all),
gaps as materialized (
  select *, "right" + 1 as jl, lead("left") over (partition by read_id order by seg_no) - 1 as jr,
    "right" - "left" + 1 as len, lead("right" - "left" + 1) over (partition by read_id order by seg_no) as next_len,
    count(*) over (partition by read_id) as n_segs from segs),
juncs as materialized (
  select chrom, strand, jl, jr, sample_id, count(*) as n from gaps
  where jr is not null and not (seg_no = 0 and len < 10) and not (seg_no = n_segs - 2 and next_len < 10)
  group by all)
"""

TRANSCRIPTS = """
tx_exons as materialized (
  select l_orderkey as id, o_orderstatus as chrom, o_custkey % 50 as gene, o_custkey * 2000 + l_linenumber * 300 as start,
    o_custkey * 2000 + l_linenumber * 300 + 49 + 2 * cast(l_quantity as bigint) as "end", cast(l_quantity as bigint) as q
  from lineitem join orders on l_orderkey = o_orderkey),
transcripts as materialized (
  select id, chrom, gene, min(start) as start, max("end") as "end", count(*) as n_exons, cast(sum("end" - start + 1) as bigint) as length,
    cast(sum(q) as bigint) as flow, sum(q) / 4.0::double as mean, max(q) / 5.0::double as score
  from tx_exons group by all),
series as materialized (
  select t.* exclude (mean, score), s.sample_id, t.mean * share as mean, t.score * share as score, id % 40 = 0 as guided, id % 31 = 0 as barred
  from (select t.*, unnest([0, 1, 2]) as sample_id from transcripts t) x
  join transcripts t using (id, chrom)
  cross join lateral (select x.sample_id, [1.0::double, 0.5::double, 0.25::double][(x.id + x.sample_id) % 3 + 1] as share) s),
tx_marked as (
  select *, case when max("end") over (partition by chrom order by start, "end", id rows between unbounded preceding and 1 preceding) >= start then 0 else 1 end as opens from transcripts),
tx_numbered as (select *, sum(opens) over (partition by chrom order by start, "end", id) as no from tx_marked),
tx_regions as materialized (
  select id, chrom, min(start) over (partition by chrom, no) as region_start, max("end") over (partition by chrom, no) as region_end from tx_numbered)
"""


def fixed_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated exons' starts and ends, of each part on every chromosome and strand."""
    part = table(spark, sf_dir, "part").select(
        F.explode(F.array(*map(F.lit, "ANR"))).alias("chrom"), "p_partkey"
    ).select("chrom", F.explode(F.array(*map(F.lit, "+-"))).alias("strand"), "p_partkey")
    ends = F.array(*[F.struct(F.lit(kind).alias("kind"), (F.col("p_partkey") * 400 + at).cast("bigint").alias("pos")) for kind, at in (("START", 10), ("END", 59))])
    return part.select("chrom", "strand", F.explode(ends).alias("_e")).select("chrom", "strand", "_e.kind", "_e.pos").distinct()


FIXED = """
, fixed as materialized (select distinct c.chrom, s.strand, k.kind, cast(p_partkey * 400 + k.shift as bigint) as mark from part
  cross join (select unnest(['A', 'N', 'R']) as chrom) c cross join (select unnest(['+', '-']) as strand) s
  cross join (select * from (values ('START', 10), ('END', 59)) v(kind, shift)) k)
"""
