"""Divergence between the sources of a language by one-hot level products (operator 11).

A term's probability in a group depends on its count there alone, so the divergence
between two groups needs no term by itself: it needs, for each level (count) of one
group and each level of the other, how many terms stand at both.  These joint tables
come from matrix products.  The kept terms are cut into blocks; a block is an
indicator matrix with a row for each term and a column for each (group, level) that
occurs; the matrix's transpose times the matrix holds the joint table of every pair
of groups, and the blocks' products add up.  Entries are sums of ones below 2**24,
so 32-bit floats are exact.

Level zero has no columns.  With J(a, b) the joint table of levels above zero, the
sum of f over all terms is

    sum J(a, b) (f(a, b) - f(a, 0) - f(0, b) + f(0, 0))
    + sum n(a) (f(a, 0) - f(0, 0)) + sum n(b) (f(0, b) - f(0, 0)) + V f(0, 0)

where n(a) counts the terms at level a of one group; so a term costs no more than
the groups that have it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of letters and of characters beyond ASCII, capitals lowered; a space for every other byte.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms counted in one worker before its counts are sent on.
MOST_KEYS = 250_000
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
#: Rows (term, group) of a block in expectation, and columns and cells of a product.
BLOCK_ROWS = 40_000
MOST_COLUMNS = 1024
MOST_CELLS = 8_000_000


def words(text: bytes | None, table: bytes = LETTERS) -> Iterator[list[bytes]]:
    """The words of a whole text, in lists of bounded size."""
    clean = (text or b"").translate(table)
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + SLICE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    keys = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.record_batch(
                [
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                    pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, distinct = len(n), set()
            for part in words(text.as_py()):
                n.update(part)
                distinct.update(part)
            docs.update(distinct)
            keys += len(n) - before
            if keys > MOST_KEYS:
                yield from sent()
                held, keys = {}, 0
    yield from sent()


def kept_terms(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """``lang, source, term, n, n_lang``: counts of the terms in at least ``least_docs`` rows of the language.

    ``docs`` has the columns lang, source, text; nulls count as ''.  Rows are
    counted where they stand; only counts are shuffled, once, by language and term.
    """
    counted = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.col("text").cast("binary").alias("text")
    ).mapInArrow(_partial_counts, "lang string, source string, term binary, n long, docs long")
    sums = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    return (
        sums.withColumn("in_docs", F.sum("docs").over(term))
        .withColumn("n_lang", F.sum("n").over(term))
        .withColumn("first", F.col("source") == F.min("source").over(term))
        .where(F.col("in_docs") >= least_docs)
        .select("lang", "source", F.col("term").cast("string").alias("term"), "n", "n_lang", "first")
    )


def one_hot_product(row: np.ndarray, col: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries above zero of the indicator matrix's transpose times the matrix.

    ``row`` and ``col`` are the places of the ones, ``group`` the group of each
    column, ascending.  Only entries whose first column's group is the lower are
    returned, as (first column, second column, count).  A matrix that is too wide
    or too large is cut between its rows and the products are added; one row alone
    is cut between its columns.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    todo = [(row, col)]
    while todo:
        r, c = todo.pop()
        rows, r_at = np.unique(r, return_inverse=True)
        cols, c_at = np.unique(c, return_inverse=True)
        if len(rows) > 1 and (len(cols) > MOST_COLUMNS or len(rows) * len(cols) > MOST_CELLS):
            low = r_at < len(rows) // 2
            todo += [(r[low], c[low]), (r[~low], c[~low])]
            continue
        ones = np.zeros((len(rows), len(cols)), np.float32)
        ones[r_at, c_at] = 1
        for at in range(0, len(cols), MOST_COLUMNS):
            part = ones[:, at : at + MOST_COLUMNS].T @ ones
            part *= group[cols[at : at + MOST_COLUMNS]][:, None] < group[cols][None, :]
            a, b = np.nonzero(part)
            found.append((cols[at + a], cols[b], part[a, b].astype(np.int64)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
    width = len(group)
    code, at = np.unique(a * width + b, return_inverse=True)
    sums = np.zeros(len(code), np.int64)
    np.add.at(sums, at, n)
    return code // width, code % width, sums


def _block_tables(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    # rare terms first: neighbours then share their few levels, and a cut leaves fewer columns
    frame = frame.sort_values(["n_lang", "term"], kind="stable")
    row = (frame["term"] != frame["term"].shift()).cumsum().to_numpy()
    names, group = np.unique(frame["source"].to_numpy(object), return_inverse=True)
    level, level_at = np.unique(frame["n"].to_numpy(), return_inverse=True)
    code, col = np.unique(group * len(level) + level_at, return_inverse=True)
    of, at = code // len(level), level[code % len(level)]
    a, b, n = one_hot_product(row, col, of)
    return pd.DataFrame({"lang": key[0], "source": names[of[a]], "level": at[a], "other": names[of[b]], "other_level": at[b], "terms": n})


def joint_tables(kept: DataFrame) -> DataFrame:
    """``lang, source, level, other, other_level, terms`` for source < other and levels above zero.

    ``kept`` is a written table of :func:`kept_terms`.
    """
    blocks = max(1, -(-kept.count() // BLOCK_ROWS))
    schema = "lang string, source string, level long, other string, other_level long, terms long"
    parts = kept.select("lang", "source", "term", "n", "n_lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    products = parts.groupBy("lang", "block").applyInPandas(_block_tables, schema)
    return products.groupBy("lang", "source", "level", "other", "other_level").agg(F.sum("terms").alias("terms"))


def _p(level: str, total: str) -> Column:
    """1 + floor(1000000000 * (level + 1) / (total + v)), exact for any counts; null if there are no terms."""
    high = f"cast(1000000000 as decimal(10,0)) * cast({level} + 1 as decimal(20,0))"
    return F.expr(f"1 + ({high}) div cast(nullif({total} + v, 0) as decimal(20,0))")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def audit(docs: DataFrame, least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """Divergence of every (lang, source) group from each other source and from its language.

    Returns ``lang, source, part, item, value, rank``: part ``pair`` has a row for
    each other source of the language, part ``term`` up to ``top_terms`` terms that
    are likelier in the group than in the language.  Null languages, sources and
    texts are ''; each row is a document, repeated rows too; a group without terms
    has level zero everywhere, and a language without kept terms gives pairs of value 0.
    Other columns of ``docs`` are not read.
    """
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    kept = materialize(kept_terms(docs, least_docs))
    levels = materialize(kept.groupBy("lang", "source", F.col("n").alias("level")).agg(F.count(F.lit(1)).alias("terms")))
    totals = levels.groupBy("lang", "source").agg(F.sum(F.col("level") * F.col("terms")).alias("total"))
    langs = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("lang_total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = materialize(groups.withColumn("p0", _p("0", "total")))

    side = groups.select("lang", "source", "total", "v", "p0")
    other = side.select("lang", F.col("source").alias("other"), F.col("total").alias("other_total"), F.col("p0").alias("q0"))

    both = joint_tables(kept).join(side, ["lang", "source"]).join(other, ["lang", "other"])
    both = both.withColumn("p", _p("level", "total")).withColumn("q", _p("other_level", "other_total"))
    wide = lambda c: c.cast("decimal(38,0)")
    joint = both.groupBy("lang", "source", "other").agg(
        F.sum(wide(F.col("terms")) * wide(_f("p", "q") - _f("p", "q0") - _f("p0", "q") + _f("p0", "q0"))).alias("there"),
        F.sum(wide(F.col("terms")) * wide(_f("q", "p") - _f("q0", "p") - _f("q", "p0") + _f("q0", "p0"))).alias("back"),
    )
    single = levels.join(side, ["lang", "source"]).withColumn("p", _p("level", "total")).join(other, "lang").where("source <> other")
    margin = single.groupBy("lang", "source", "other").agg(
        F.sum(wide(F.col("terms")) * wide(_f("p", "q0") - _f("p0", "q0"))).alias("there"),
        F.sum(wide(F.col("terms")) * wide(_f("q0", "p") - _f("q0", "p0"))).alias("back"),
    )
    ways = materialize(joint.unionByName(margin))  # read in both directions
    none = F.coalesce(wide(F.col("v")) * wide(_f("p0", "q0")), wide(F.lit(0)))
    base = side.join(other, "lang").where("source <> other").select("lang", "source", F.col("other").alias("item"), none.alias("value"))
    parts = (
        base.unionByName(ways.select("lang", "source", F.col("other").alias("item"), F.col("there").alias("value")))
        .unionByName(ways.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").cast("long").alias("value"))
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best))

    own = kept.join(groups, ["lang", "source"]).withColumn("p", _p("n", "total")).withColumn("q", _p("n_lang", "lang_total"))
    terms = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)
    return pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(terms)


AUDIT_SQL = """
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
t as (
  select id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as materialized (
  select lang, term, count(*) as n_lang from t group by lang, term having count(distinct id) >= 3),
c as materialized (
  select t.lang, t.source, t.term, count(*) as n, any_value(k.n_lang) as n_lang
  from t join k on t.lang = k.lang and t.term = k.term group by t.lang, t.source, t.term),
v as materialized (select lang, count(*) as v, sum(n_lang) as n_all from k group by lang),
g as materialized (
  select a.lang, a.source, coalesce(v.v, 0) as v, coalesce(v.n_all, 0) as n_all,
         coalesce((select sum(n) from c where c.lang = a.lang and c.source = a.source), 0) as n_own
  from (select distinct lang, source from d) a left join v on v.lang = a.lang),
p as materialized (
  select g.lang, g.source, k.term,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n_own + g.v)::hugeint as p
  from g join k on k.lang = g.lang
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source
  group by a.lang, a.source, b.source),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(s.value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
w as (
  select c.lang, c.source, c.term as item,
         1 + (1000000000::hugeint * (c.n + 1)) // (g.n_own + g.v)::hugeint as p,
         1 + (1000000000::hugeint * (c.n_lang + 1)) // (g.n_all + g.v)::hugeint as q
  from c join g on c.lang = g.lang and c.source = g.source),
terms as (
  select lang, source, 'term' as part, item, cast(((p - q) * (p - q)) // q as bigint) as value from w where p > q)
select lang, source, part, item, value, cast(rank as int) as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
where part = 'pair' or rank <= 200
"""
