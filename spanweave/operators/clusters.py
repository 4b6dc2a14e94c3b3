"""Boundary positions by one-dimensional least squares in groups.

A group ends where the next position lies over ``merge`` away.  It is cut into the
smallest number of runs that are no wider than twice ``merge`` and whose first has
two positions or more; of these cuts the one with the least squared distance to the
runs' weighted means counts, and of equals the one with the shortest last run, then
the shortest last but one, and so on.  Each run becomes its rounded mean; means
within ``merge`` of each other are grouped and cut again, until all stand alone.

Two facts make one pass over a group enough.  Cuts of the first i positions and of
the rest are together a cut of all, so a smallest cut of all holds smallest cuts of
every prefix it ends at, and a prefix needs only its least (number, cost).  And only
positions within twice ``merge`` can begin the run that ends at i.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import BIN, run_ids, runs
from .tables import written

#: Costs that differ by less are equal (they are sums of squares of whole positions over whole counts).
SAME = 1e-9
#: Positions that one task takes together in expectation.
TASK_ROWS = 200_000


def best_cut(marks: Sequence[tuple[int, int]], merge: int) -> list[tuple[int, int]]:
    """First and last index of each run of the best cut of a group of two positions or more."""
    n = len(marks)
    best: list[tuple[int, float, int] | None] = [None] * n  # runs, cost, first index of the last run
    for i in range(1, n):
        weight = moment = square = 0
        found = None
        for j in range(i, -1, -1):
            far = marks[i][0] - marks[j][0]
            if far > 2 * merge:
                break
            weight += marks[j][1]
            moment += marks[j][1] * far
            square += marks[j][1] * far * far
            head = (0, 0.0) if j == 0 else best[j - 1]
            if head is None:  # one position alone can't be the first run
                continue
            cost = head[1] + square - moment * moment / weight
            if found is None or head[0] + 1 < found[0] or (head[0] + 1 == found[0] and cost < found[1] - SAME * max(1.0, found[1])):
                found = (head[0] + 1, cost, j)
        best[i] = found
    runs, last = [], n - 1
    while last >= 0:
        first = best[last][2]
        runs.append((first, last))
        last = first - 1
    return runs[::-1]


def cluster_positions(marks: Sequence[tuple[int, int]], merge: int = 1, least: int = 1) -> list[int]:
    """Clustered positions of sorted (position, count) rows; runs under ``least`` counts are dropped."""
    out: list[int] = []
    todo = [list(marks)]
    while todo:
        rows = todo.pop()
        groups: list[list[tuple[int, int]]] = []
        for pos, count in rows:
            if groups and groups[-1][-1][0] == pos:
                groups[-1][-1] = (pos, groups[-1][-1][1] + count)
            elif groups and pos <= groups[-1][-1][0] + merge:
                groups[-1].append((pos, count))
            else:
                groups.append([(pos, count)])
        for group in groups:
            if sum(count for _, count in group) < least:
                continue
            if len(group) == 1:
                out.append(group[0][0])
                continue
            means = []
            for first, last in best_cut(group, merge):
                count = sum(c for _, c in group[first : last + 1])
                total = sum((p - group[first][0]) * c for p, c in group[first : last + 1])
                if count >= least:
                    means.append((group[first][0] + (2 * total + count) // (2 * count), count))  # half a position rounds up
            todo.append(means)
    return sorted(out)


def cluster_rows(rows: pd.DataFrame, keys: Sequence[str], merge: int = 1, least: int = 1) -> pd.DataFrame:
    """Clustered positions ``keys, pos`` of many whole groups: rows with the keys, ``_no``, ``pos`` and ``n``."""
    # groups stand together after sorting; those of one position are the most and need no cut
    rows = rows.sort_values([*keys, "_no", "pos"], kind="stable", ignore_index=True)
    opens = np.zeros(len(rows), bool)
    opens[:1] = True
    for c in [*keys, "_no"]:
        now, was = rows[c], rows[c].shift()
        opens |= ((now != was) & ~(now.isna() & was.isna())).to_numpy(bool)
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, len(rows)))
    pos, n = rows["pos"].to_numpy(), rows["n"].to_numpy()
    alone = first[size == 1]
    alone = alone[n[alone] >= least]
    at, found = [alone], [pos[alone]]
    for i, k in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        means = cluster_positions(list(zip(pos[i : i + k].tolist(), n[i : i + k].tolist(), strict=True)), merge, least)
        at.append(np.full(len(means), i))
        found.append(np.array(means, pos.dtype))
    out = rows.loc[np.concatenate(at).astype(np.int64), [*keys]].reset_index(drop=True)
    return out.assign(pos=np.concatenate(found))


def boundary_kmeans(marks: DataFrame, keys: Sequence[str], merge: int = 1, least: int = 1, bin_size: int = BIN) -> DataFrame:
    """Clustered boundary positions: ``keys, pos``.

    ``marks`` has ``pos``, a row for each observation; null positions don't count.
    Observations are counted by position before anything is sorted, so a group is as
    large as its island has positions, however deep it is, and takes time in
    proportion.  Groups are cut by running aggregates over bins and dealt to tasks
    whole, many to a task.
    """
    at = marks.where("pos is not null").groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n"))
    at = run_ids(written(runs(at, keys, "pos", merge, ["pos"], bin_size)), keys)
    at = at.select(*keys, (F.col("_no._bin") * (bin_size + 1) + F.col("_no._own")).alias("_no"), "pos", "n")
    tasks = max(1, -(-at.count() // TASK_ROWS))
    fields = [at.schema[k] for k in keys] + [at.schema["pos"]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        return cluster_rows(rows, keys, merge, least)

    return at.groupBy(F.pmod(F.xxhash64(*keys, "_no"), F.lit(tasks)).alias("_task")).applyInPandas(cluster, schema)
