"""Mixing sources to target weights by Sainte-Laguë (operator 5), DataFrame only.

The mix is made of blocks of equal token counts.  Blocks go to sources as seats
go to parties: the highest quotients target / (2 s - 1) win, which gives each
source an integer quota; the same rule then splits a source's quota among its
shards by their sizes.  Inside a shard a seeded digest orders the documents,
the ordered words are cut into equal blocks, and the quota takes whole rounds of
all blocks first and then the first blocks of the seeded order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, unused

WEIGHTS = (3, 1, 2)


def apportion(parties: DataFrame, votes: str, seats: str, order: str, group: list[str]) -> DataFrame:
    """Add ``quota`` (long): seats by the highest quotients within each group.

    Ties go to the smaller ``order``.  Only quotients near each party's share
    are listed (seven per party on average): the final divisor differs from the
    mean divisor by half a seat for each party at most, so no quota lies further
    from its share than the bounds used here.
    """
    g = Window.partitionBy(*group)
    p = F.col(votes) / F.sum(votes).over(g)
    m = F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(g)
    near = parties.withColumn("_p", F.coalesce(F.when(F.col(votes) > 0, p), F.lit(0.0))).withColumn("_m", m)
    mid = F.floor(F.col("_p") * F.col(seats) + 0.5)
    slack = F.ceil(F.col("_p") * F.col("_m")) + 2
    near = near.withColumn("_lo", F.greatest(mid - slack, F.lit(0))).withColumn("_hi", F.when(F.col(votes) > 0, mid + slack).otherwise(F.lit(0)))
    near = near.withColumn("_lo", F.least("_lo", "_hi")).withColumn("_left", F.col(seats) - F.sum("_lo").over(g))
    tried = near.withColumn("_k", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence(F.col("_lo") + 1, F.col("_hi")))))
    quotient = F.col(votes) / (2 * F.col("_k") - 1)
    rank = F.row_number().over(g.orderBy(F.desc_nulls_last(quotient), order))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))
    keys = parties.columns
    return tried.withColumn("_rank", rank).groupBy(*keys, "_lo").agg(won.alias("_won")).withColumn("quota", F.col("_lo") + F.col("_won")).drop("_lo", "_won")


def targets(sources: DataFrame, share: float = 1.5, top: float = 2.0) -> DataFrame:
    """Add ``src`` (place of the source) and ``target`` (double).

    Sources by code point, null last, weigh 3, 1, 2, repeating.  No target
    passes ``top`` times its source's size; what is above is shared again by
    weight.  By water filling: in order of size per weight, the capped sources
    are a prefix, found from running sums.
    """
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    src = sources.withColumn("src", F.row_number().over(by_name).cast("int") - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("src"), F.lit(len(WEIGHTS))) + 1)
    src = src.withColumn("_w", weight.cast("double")).withColumn("_cap", top * F.col("source_size"))
    line = Window.partitionBy().orderBy(F.col("_cap") / F.col("_w"), "src")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = share * F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    src = src.withColumn("_level", level)
    free = F.min(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.struct(F.col("_cap") / F.col("_w"), "src", "_level"))).over(every)
    src = src.withColumn("_free", free)
    filled = F.col("_free").isNotNull() & (F.struct(F.col("_cap") / F.col("_w"), F.col("src")) >= F.struct(F.col("_free.col1"), F.col("_free.src")))
    return src.withColumn("target", F.when(filled, F.col("_w") * F.col("_free._level")).otherwise(F.col("_cap"))).drop("_w", "_cap", "_level", "_free")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    block_words: int = 32,
    shard_words: int = 1 << 17,
    max_shards: int = 4096,
    seed: int = 42,
    key: str | None = None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, whole, part`` per document.

    ``taken`` is the number of words that the mix takes: ``whole`` rounds of the
    whole text and its first ``part`` words once more.  A source has a shard for
    each ``shard_words`` words, ``max_shards`` at most; a shard's documents are
    ordered by the digest of seed and id.  Null texts have size 0 and are never
    taken; null sources are a source, null ids are ids; rows with equal ids
    are documents of their own.  An empty table gives no rows.  ``key`` names a
    column that is unique; it orders rows of one id and size, and is returned.
    """
    own = [F.col(key).alias("_key")] if key else []
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary")).alias("_digest"),
        *own,
    )
    sized = materialize(sized)
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share)
    blocks = F.floor(F.sum("target").over(Window.partitionBy()) / block_words + 0.5)
    sources = apportion(sources.withColumn("_g", F.lit(0)).withColumn("_seats", blocks), "target", "_seats", "src", ["_g"])
    shards = F.least(F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)), F.lit(max_shards))
    sources = materialize(sources.select("source", "src", "source_size", "target", F.col("quota").alias("_source_quota"), shards.alias("_shards")))
    tagged = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    shard = F.pmod(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long"), F.col("_shards"))
    tagged = tagged.withColumn("_shard", shard)
    keys = ["src", "_shard"]
    stats = tagged.groupBy(*keys, "_source_quota").agg(F.sum("size").alias("_words"))
    stats = apportion(stats, "_words", "_source_quota", "_shard", ["src"])
    n_blocks = F.greatest(F.floor(F.col("_words") / block_words + 0.5), F.lit(1))
    stats = stats.withColumn("_n", n_blocks).withColumn("quota", F.least("quota", 2 * F.col("_n")))
    stats = stats.select(
        *keys,
        F.floor(F.col("quota") / F.col("_n")).alias("whole"),
        F.floor(F.pmod("quota", "_n") * F.col("_words") / F.col("_n")).alias("_cut"),
    )
    stats = materialize(stats)
    order = Window.partitionBy(*keys).orderBy("_digest", "doc_id", "size", *["_key" for _ in own]).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.least(F.greatest(F.col("_cut") - start, F.lit(0)), F.col("size"))
    return (
        tagged.join(stats, keys)
        .withColumn("part", part)
        .select(
            "doc_id", "source", "size", "source_size", "target",
            (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), "whole", "part",
            *[F.col("_key").alias(key) for _ in own],
        )
    )


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('42:' || coalesce(doc_id::varchar, 'null')) as digest
  from documents),
src0 as (select source, sum(size)::bigint as source_size from sized group by source),
src1 as (
  select *, row_number() over (order by source nulls last) - 1 as src from src0),
src2 as (
  select *, ([3, 1, 2])[(src % 3) + 1]::double as w, 2.0::double * source_size as cap from src1),
src3 as (
  select *, cap / w as r,
    (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, src rows between unbounded preceding and 1 preceding), 0))
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, src rows between unbounded preceding and 1 preceding), 0)) as lvl
  from src2),
free as (select r, src, lvl from src3 where r >= lvl order by r, src limit 1),
src4 as (
  select s.*, case when f.src is not null and (s.r > f.r or (s.r = f.r and s.src >= f.src)) then s.w * f.lvl else s.cap end as target
  from src3 s left join free f on true),
seats as (
  select *, floor(sum(target) over () / 32 + 0.5)::bigint as seats, sum(target) over () as votes,
    sum(case when target > 0 then 1 else 0 end) over () as m from src4),
near as (
  select *, floor(target / nullif(votes, 0) * seats + 0.5)::bigint as mid, ceil(target / nullif(votes, 0) * m)::bigint + 2 as slack from seats),
bound as (
  select *, case when target > 0 then greatest(mid - slack, 0) else 0 end as lo,
    case when target > 0 then mid + slack else 0 end as hi from near),
tried as (
  select b.src, b.target / (2 * k - 1) as q
  from bound b, unnest(range(b.lo + 1, b.hi + 1)) u(k)),
won as (
  select src, count(*) as n from (
    select *, row_number() over (order by q desc, src) as rk from tried)
  where rk <= (select any_value(seats) - sum(lo) from bound) group by src),
sources as (
  select b.source, b.src, b.source_size, b.target, b.lo + coalesce(w.n, 0) as source_quota,
    least(greatest(ceil(b.source_size / 131072.0)::bigint, 1), 4096) as shards
  from bound b left join won w using (src)),
tagged as (
  select d.*, s.src, s.source_size, s.target, s.source_quota, ('0x' || substr(digest, 1, 8))::bigint % s.shards as shard
  from sized d join sources s on d.source is not distinct from s.source),
st0 as (select src, shard, any_value(source_quota) as quota0, sum(size)::bigint as words from tagged group by src, shard),
st1 as (
  select *, sum(words) over (partition by src) as votes, sum(case when words > 0 then 1 else 0 end) over (partition by src) as m from st0),
st2 as (
  select *, case when words > 0 then greatest(floor(words::double / votes::double * quota0 + 0.5)::bigint - ceil(words::double / votes::double * m)::bigint - 2, 0) else 0 end as lo,
    case when words > 0 then floor(words::double / votes::double * quota0 + 0.5)::bigint + ceil(words::double / votes::double * m)::bigint + 2 else 0 end as hi from st1),
st3 as (
  select src, shard, words::double / (2 * k - 1) as q from st2, unnest(range(lo + 1, hi + 1)) u(k)),
rest as (select src, any_value(quota0) - sum(lo) as n from st2 group by src),
st4 as (
  select src, shard, count(*) as n from (
    select st3.*, row_number() over (partition by st3.src order by q desc, shard) as rk from st3) r
  join rest using (src) where rk <= rest.n group by src, shard),
st5 as (
  select src, shard, words, greatest(floor(words / 32.0 + 0.5)::bigint, 1) as nb,
    least(lo + coalesce(n, 0), 2 * greatest(floor(words / 32.0 + 0.5)::bigint, 1))::bigint as quota
  from st2 left join st4 using (src, shard)),
st6 as (select src, shard, quota // nb as whole, ((quota % nb) * words) // nb as cut from st5),
placed as (
  select t.*, st6.whole, st6.cut,
    coalesce(sum(size) over (partition by t.src, t.shard order by digest, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
  from tagged t join st6 on t.src = st6.src and t.shard = st6.shard)
select doc_id, source, size, source_size::bigint as source_size, target,
  (whole * size + least(greatest(cut - start, 0), size))::bigint as taken, whole::bigint as whole,
  least(greatest(cut - start, 0), size)::bigint as part
from placed
"""


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row per round of each document, with its columns.

    A document appears once for each whole round, and once more with its first
    ``part`` words (white space between them as it was) if a round takes a
    part; documents that the mix leaves out go.  ``n_chars``, if there, is the
    new length.  Null and repeated ids are rows of their own.
    """
    row, made = unused(docs, "row"), unused(docs, "text")
    keyed = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    plan = mix(keyed, **options, key=row)
    size, whole, part = (unused(docs, c) for c in ("size", "whole", "part"))
    plan = plan.select(row, F.col("size").alias(size), F.col("whole").alias(whole), F.col("part").alias(part)).where((F.col(whole) > 0) | (F.col(part) > 0))
    plan = materialize(plan)
    joined = keyed.join(plan, row)
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.greatest(F.col(part), F.lit(1)).cast("int")), "")
    last = F.when(F.col(part) == F.col(size), F.col("text")).otherwise(cut)
    rounds = F.concat(F.array_repeat(F.col("text"), F.col(whole).cast("int")), F.when(F.col(part) > 0, F.array(last)).otherwise(F.array().cast("array<string>")))
    out = joined.withColumn(made, F.explode(rounds)).withColumn("text", F.col(made))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
