"""Resharding by minimum-cost flow (operator 2).

Rows lie in old shards; the new shards have capacities in bytes.  Moving a byte
to another shard costs one unit (or what a cost matrix says), keeping it costs
nothing.  The flow over old and new shards of least cost says how many bytes go
from each old shard to each new one.  The network has one node per shard, so it
is small however large the table is; it is solved by successive shortest paths.

Each old shard is cut into blocks (a size class and a salt).  The blocks lie on
a line, largest rows first; the stay comes first, then the transfers in order
of their targets, and a row goes where its middle byte lies.  As the small rows
come last, cuts fall between small rows, and no row is taken apart.  Positions
come from sums per block and from a window inside each block: no shard is ever
sorted in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

#: Salts per old shard and size class: 64 shards x 40 classes x 16 salts bound the block table.
SALTS = 16


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Cheapest shipment of all supply within the capacities, cost per unit.

    Successive shortest paths with potentials over the bipartite network.
    """
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    if sum(left) > sum(room):
        raise ValueError("the capacities are too small")
    pot = [0] * (n + m)
    while any(left):
        dist, via = [float("inf")] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                steps = [(n + j, cost[u][j]) for j in range(m)]
            else:
                steps = [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                nd = d + c + pot[u] - pot[v]
                if nd < dist[v]:
                    dist[v], via[v] = nd, u
                    heapq.heappush(heap, (nd, v))
        reached = [x for x in dist if x < float("inf")]
        far = max(reached)
        for v in range(n + m):
            pot[v] += min(dist[v], far)
        end = min((j for j in range(m) if room[j] and dist[n + j] < float("inf")), key=lambda j: pot[n + j])
        path = [n + end]
        while via[path[-1]] >= 0:
            path.append(via[path[-1]])
        path.reverse()
        push = min(left[path[0]], room[end])
        for a, b in zip(path, path[1:]):
            if a >= n:
                push = min(push, flow[b][a - n])
        for a, b in zip(path, path[1:]):
            if a < n:
                flow[a][b - n] += push
            else:
                flow[b][a - n] -= push
        left[path[0]] -= push
        room[end] -= push
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    """Capacities that differ by one at most and sum to the total."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def transfers(supply: dict[int, int], capacity: dict[int, int], cost=None) -> list[tuple[int, int, int, int]]:
    """``(old, new, from, to)``: which stretch of an old shard's line goes where."""
    olds, news = sorted(supply), sorted(capacity)
    cost = cost or [[int(i != j) for j in news] for i in olds]
    flow = min_cost_flow([supply[i] for i in olds], [capacity[j] for j in news], cost)
    out = []
    for a, i in enumerate(olds):
        at = 0
        for b in sorted(range(len(news)), key=lambda b: (news[b] != i, news[b])):
            if flow[a][b]:
                out.append((i, news[b], at, at + flow[a][b]))
                at += flow[a][b]
    return out


def reshard(
    rows: DataFrame,
    new_shards: int,
    key: str = "doc_id",
    size: str = "size",
    old: str = "old_shard",
    capacities: dict[int, int] | None = None,
) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 per shard).

    ``rows`` is a narrow table with a key, a size in bytes (long, 0 or more) and
    the old shard; all its columns stay.  Capacities default to equal bytes for
    shards 0 to ``new_shards - 1``.  Rows of equal keys are placed one by one; a
    null key is a key like any other; a null old shard counts as a shard from
    which every row moves; a real shard -1 is another one.  Columns named
    ``shard`` and ``slot`` are replaced.  An empty table gives no rows.
    """
    rows = rows.drop(*[c for c in ("shard", "slot") if c not in (key, size, old)])
    o, klass, salt, n_bytes, base, at, nth, first = (unused(rows, c) for c in ("old", "class", "salt", "bytes", "base", "at", "nth", "first"))
    none = -(1 << 31)  # stands for a null old shard
    rows = rows.withColumn(o, F.coalesce(F.col(old).cast("int"), F.lit(none)))
    # powers of two, halved once: rows of a class differ by a third at most
    rows = rows.withColumn(klass, F.floor(F.log2(F.greatest(F.col(size), F.lit(1)).cast("double")) * 2).cast("int"))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(key, size), F.lit(SALTS)).cast("int"))
    block = [o, klass, salt]
    rows = materialize(rows)
    per_block = rows.groupBy(*block).agg(F.sum(size).alias(n_bytes))
    line = Window.partitionBy(o).orderBy(F.desc(klass), salt).rowsBetween(Window.unboundedPreceding, -1)
    at_block = materialize(per_block.withColumn(base, F.coalesce(F.sum(n_bytes).over(line), F.lit(0))))
    supply = {r[0]: int(r[1]) for r in at_block.groupBy(o).agg(F.sum(n_bytes)).collect()}  # a row per old shard
    capacities = capacities or dict(enumerate(even_capacities(sum(supply.values()), new_shards)))
    plan = transfers(supply, capacities) or [(0, 0, 0, 0)]
    by_old: dict[int, list[tuple[int, int]]] = {}
    for i, n, lo, _ in plan:
        by_old.setdefault(i, []).append((lo, n))
    steps = F.create_map(*[x for i, cuts in by_old.items() for x in (F.lit(i), F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(n).alias("n")) for lo, n in cuts]))])
    within = Window.partitionBy(*block).orderBy(F.desc(size), F.xxhash64(key), key)
    cuts = steps[F.col(o)]
    # the last stretch that begins at or before the row's middle byte
    target = F.aggregate(cuts, F.get(cuts, 0)["n"], lambda s, c: F.when(2 * c["lo"] <= 2 * F.col(at) + F.col(size), c["n"]).otherwise(s))
    placed = (
        rows.join(at_block.select(*block, base), block)
        .withColumn(at, F.col(base) + F.coalesce(F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn(nth, F.row_number().over(within))
        .withColumn("shard", target)
    )
    placed = materialize(placed)
    # slots: a count per (shard, block), then the place inside it
    counts = placed.groupBy("shard", *block).agg(F.count(F.lit(1)).alias(n_bytes))
    order = Window.partitionBy("shard").orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(first, F.coalesce(F.sum(n_bytes).over(order), F.lit(0))).drop(n_bytes)
    inside = Window.partitionBy("shard", *block).orderBy(nth)
    return (
        placed.join(counts, ["shard", *block])
        .withColumn("slot", F.col(first) + F.row_number().over(inside) - 1)
        .drop(*block, base, at, nth, first)
    )


def rewrite_affected(data: DataFrame, plan: DataFrame, out_dir: str, key: str = "doc_id") -> DataFrame:
    """Write the shards that a plan changes, and say which files hold what.

    ``plan`` is the result of :func:`reshard` with unique keys.  A new shard is
    affected if it gains or loses a row; only rows of such shards are shuffled
    and written, below ``out_dir`` in one folder per shard.  Returns ``shard,
    affected, n_rows, moved_bytes``: unaffected shards stay in their old files.
    """
    gone = plan.where(F.col("shard") != F.col("old_shard"))
    touched = gone.select("shard").union(gone.select(F.col("old_shard").alias("shard"))).distinct()
    target = plan.join(touched, "shard", "left_semi").select(F.col(key), "shard", "slot")
    spread = F.pmod(F.floor(F.col("slot") / 100_000), F.lit(1_000_000))
    (
        data.drop("shard", "slot").join(target, key)
        .repartition("shard", spread)
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").mode("overwrite").parquet(out_dir)
    )
    moved = F.sum(F.when(F.col("shard") != F.col("old_shard"), F.col("size")).otherwise(0)).alias("moved_bytes")
    report = plan.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), moved)
    flag = touched.withColumn("affected", F.lit(True))
    return report.join(flag, "shard", "left").select("shard", F.coalesce("affected", F.lit(False)).alias("affected"), "n_rows", "moved_bytes")
