"""Exact top-k inner-product search with block-at-a-time pruning (operator 8).

Rows are cut into blocks by ranges of the identifier and written as forward
indexes: one row per block with its ids, its integer vectors, and the smallest
and largest value of each term (dimension).  For a query the sum over terms of
the larger of ``q * max`` and ``q * min`` bounds every score in a block.  Each
task orders the blocks of its lane by that bound and scores them one by one
until the bound of the next block lies below the query's kth score; a block
that might still hold an equal score is scored, so ties are exact.

Queries and blocks meet in (query chunk, lane) cells of bounded size: a cell
holds at most ``chunk`` queries and ``lane_blocks`` blocks, however large the
table is.  A few chunks of queries at a time are sent to where the lanes lie, so
neither table is copied for the other's sake.  A task carries each query's list on
from lane to lane; the tasks' lists, k rows per query each, are merged by rank.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Numbers of query vectors that are sent to all workers at once, in expectation (8 bytes each).
SENT_NUMBERS = 2_000_000


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id, dim, v`` (array<long>) with each component as floor(scale * x).

    Rows with a null id or vector, or with null or non-finite components, and
    empty vectors take no part.
    """
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.size(x).alias("dim"),
        F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"),
    )


def _scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where no sum can pass 2**53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    return q @ m.T


def no_rows(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of ``n`` empty lists."""
    return np.full((n, k), np.iinfo(np.int64).min, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)


def best_in_lane(
    q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], best_s: np.ndarray, best_i: np.ndarray
) -> None:
    """Put the rows of a lane into every query's list of best rows, block by block.

    All queries of a chunk go through the blocks together: in step s each query
    visits its s-th best block, and leaves when its bound is below its kth score.
    """
    lo = np.stack([m.min(axis=0) for _, m in blocks]).astype(np.float64)
    hi = np.stack([m.max(axis=0) for _, m in blocks]).astype(np.float64)
    qf = q.astype(np.float64)
    bound = np.maximum(qf, 0) @ hi.T + np.minimum(qf, 0) @ lo.T
    bound += np.abs(bound) * 1e-12 + 1e-6  # never below the exact sum
    order = np.argsort(-bound, axis=1, kind="stable")
    none, k = np.iinfo(np.int64).min, best_s.shape[1]
    live = np.arange(len(q))
    for step in range(len(blocks)):
        nxt = order[live, step]
        live = live[bound[live, nxt] >= best_s[live, -1]]
        if not len(live):
            break
        visit = order[live, step]
        for b in np.unique(visit):
            rows = live[visit == b]
            ids, mat = blocks[b]
            s = _scores(q[rows], mat)
            own = q_ids[rows][:, None] == ids[None, :]
            s[own] = none
            all_s = np.concatenate([best_s[rows], s], axis=1)
            all_i = np.concatenate([best_i[rows], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids, s.shape))], axis=1)
            take = _top(all_s, all_i, k)
            best_s[rows] = np.take_along_axis(all_s, take, axis=1)
            best_i[rows] = np.take_along_axis(all_i, take, axis=1)


def listed(q_ids: np.ndarray, best_s: np.ndarray, best_i: np.ndarray) -> pd.DataFrame:
    """The rows of the lists."""
    got = best_i != np.iinfo(np.int64).max
    return pd.DataFrame({"query_id": np.repeat(q_ids, best_i.shape[1]).reshape(best_i.shape)[got], "vec_id": best_i[got], "score": best_s[got]})


def _top(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores per row, ties to the smaller id."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    s = np.take_along_axis(s, by_id, axis=1)
    by_score = np.argsort(~s, axis=1, kind="stable")[:, :k]  # ~s falls as s grows, without overflow
    return np.take_along_axis(by_id, by_score, axis=1)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    block_rows: int = 512,
    lane_blocks: int = 16,
    chunk: int = 2048,
) -> DataFrame:
    """The k highest-scoring other rows of every query.

    Both tables come from :func:`integer_vectors`.  Vectors of another length
    than the query's are no candidates.  Returns ``query_id, rank, vec_id,
    score``: ties go to the smaller id, all candidates if fewer than k.  A query
    without candidates gives no rows; rows that repeat an id each count as rows.
    """
    lanes = max(1, -(-vectors.count() // (block_rows * lane_blocks)))
    chunks = max(1, -(-queries.count() // chunk))

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        ids, mat = frame["vec_id"].to_numpy("<i8"), np.stack(frame["v"].to_numpy()).astype("<i8")
        return pd.DataFrame([(*key, ids.tobytes(), mat.tobytes())])

    lane = F.pmod(F.xxhash64(F.floor(F.col("vec_id") / block_rows)), F.lit(lanes))
    index = vectors.withColumn("lane", lane).groupBy("dim", "lane").applyInPandas(packed, "dim int, lane long, ids binary, mat binary")
    asked = (
        queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
        .groupBy("dim", "part")
        .applyInPandas(packed, "dim int, part long, q_ids binary, q_mat binary")
    )
    index, asked = materialize(index), materialize(asked)

    def search(batches):
        held = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                q_ids = np.frombuffer(r.q_ids, "<i8")
                q = np.frombuffer(r.q_mat, "<i8").reshape(len(q_ids), r.dim)
                ids = np.frombuffer(r.ids, "<i8")
                mat = np.frombuffer(r.mat, "<i8").reshape(len(ids), r.dim)
                cut = range(0, len(ids), block_rows)
                _, *best = held.setdefault((r.dim, r.part), (q_ids, *no_rows(len(q_ids), k)))
                best_in_lane(q_ids, q, [(ids[i : i + block_rows], mat[i : i + block_rows]) for i in cut], *best)
        for lists in held.values():
            yield listed(*lists)

    width = asked.agg(F.max("dim")).first()[0] or 1
    sent = max(1, SENT_NUMBERS // (chunk * width))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = []
    for first in range(0, chunks, sent):
        few = asked.where(F.col("part").between(first, first + sent - 1))
        found = index.join(F.broadcast(few), "dim").mapInPandas(search, "query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        out.append(materialize(ranked.select("query_id", "rank", "vec_id", "score")))
    return reduce(DataFrame.union, out)


TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 50 = 0)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""
