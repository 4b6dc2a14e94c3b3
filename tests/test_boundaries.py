"""Boundary clustering, as-of joins and chains against brute force."""

import random
from fractions import Fraction
from itertools import combinations

import pandas as pd
import pytest

from spanweave.operators import asof, chains, clusters


def all_cuts(n):
    for k in range(n):
        for at in combinations(range(1, n), k):
            edges = [0, *at, n]
            yield [(edges[i], edges[i + 1] - 1) for i in range(len(edges) - 1)]


def squares(marks, run):
    rows = marks[run[0] : run[1] + 1]
    weight = sum(c for _, c in rows)
    mean = Fraction(sum(p * c for p, c in rows), weight)
    return sum(c * (p - mean) ** 2 for p, c in rows)


def brute_cut(marks, merge):
    fit = [
        cut for cut in all_cuts(len(marks))
        if cut[0][1] >= 1 and all(marks[b][0] - marks[a][0] <= 2 * merge for a, b in cut)
    ]
    fewest = min(map(len, fit))
    fit = [cut for cut in fit if len(cut) == fewest]
    return min(fit, key=lambda cut: (sum(squares(marks, run) for run in cut), [-a for a, _ in reversed(cut)]))


def brute_positions(marks, merge, least):
    counts = {}
    for p, c in marks:
        counts[p] = counts.get(p, 0) + c
    groups, out = [], []
    for p in sorted(counts):
        if groups and p - groups[-1][-1][0] <= merge:
            groups[-1].append((p, counts[p]))
        else:
            groups.append([(p, counts[p])])
    for group in groups:
        if sum(c for _, c in group) < least:
            continue
        if len(group) == 1:
            out.append(group[0][0])
            continue
        means = []
        for a, b in brute_cut(group, merge):
            weight = sum(c for _, c in group[a : b + 1])
            mean = Fraction(sum(p * c for p, c in group[a : b + 1]), weight)
            if weight >= least:
                means.append((int(mean + Fraction(1, 2)), weight))
        out += brute_positions(means, merge, least)
    return sorted(out)


@pytest.mark.parametrize("merge", [1, 2, 3])
def test_best_cut_is_best_of_all_cuts(merge):
    rng = random.Random(merge)
    for _ in range(150):
        marks, pos = [], 100
        for _ in range(rng.randint(2, 9)):
            marks.append((pos, rng.choice([1, 1, 2, 3, 7])))
            pos += rng.randint(1, merge)
        assert clusters.best_cut(marks, merge) == brute_cut(marks, merge)


def test_cluster_positions_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(f"c{k}", 50 + rng.randint(0, 40)) for k in range(12) for _ in range(rng.randint(1, 18))]
    marks = spark.createDataFrame([*rows, ("c0", None)], "chrom string, pos long")
    for merge, least in ((1, 1), (1, 2), (2, 3)):
        found = sorted((r["chrom"], r["pos"]) for r in clusters.boundary_kmeans(marks, ["chrom"], merge, least, bin_size=16).collect())
        want = sorted((c, p) for c in {c for c, _ in rows} for p in brute_positions([(p, 1) for x, p in rows if x == c], merge, least))
        assert found == want


def test_clusters_of_a_long_run_take_linear_time():
    found = clusters.cluster_positions([(p, 1 + p % 3) for p in range(200_000)], merge=1)
    assert all(b - a > 1 for a, b in zip(found, found[1:], strict=False))


def test_lone_positions_are_not_cut(monkeypatch):
    """Only groups of several positions are cut one by one; null keys are a key of their own."""
    rows = [(k, no, 1000 * no + i, 1 + no % 3) for k in ("a", None, "b") for no in range(9) for i in range(1 + 2 * (no == 4))]
    cut, real = [], clusters.cluster_positions
    monkeypatch.setattr(clusters, "cluster_positions", lambda *a: cut.append(a) or real(*a))
    got = clusters.cluster_rows(pd.DataFrame(rows[::-1], columns=["k", "_no", "pos", "n"]), ["k"], 1, 2)
    want = [(k, p) for k in ("a", None, "b") for no in range(9) for p in real([(r[2], r[3]) for r in rows if r[:2] == (k, no)], 1, 2)]
    assert len(cut) == 3 and sorted(map(str, zip(got["k"].tolist(), got["pos"].tolist(), strict=True))) == sorted(map(str, want))


def test_no_marks_give_no_clusters(spark):
    none = spark.createDataFrame([], "chrom string, pos long")
    assert clusters.boundary_kmeans(none, ["chrom"]).collect() == []


def test_around_against_lists(spark):
    rng = random.Random(3)
    points = [(k, rng.randint(0, 200)) for k in "ab" for _ in range(60)] + [("c", 5), ("a", None)]
    series = {n: [(k, rng.randint(0, 200)) for k in "ab" for _ in range(12)] for n in ("x", "y")}
    df = lambda rows: spark.createDataFrame(rows, "k string, pos long")
    for bin_size in (8, 1 << 16):
        found = asof.around(df(points), {n: df(rows) for n, rows in series.items()}, ["k"], bin_size).collect()
        assert {(r["k"], r["pos"]) for r in found} == {p for p in points if p[1] is not None}
        for r in found:
            for n, rows in series.items():
                marks = [p for k, p in rows if k == r["k"]]
                assert r[f"prev_{n}"] == max((p for p in marks if p < r["pos"]), default=None)
                assert r[f"next_{n}"] == min((p for p in marks if p >= r["pos"]), default=None)


@pytest.mark.parametrize(
    "clustered, fixed, near, snap",
    [
        ([101], [], 101, 101),  # next
        ([99], [], 99, 99),  # previous
        ([99, 101], [], 101, 101),  # the upper of equals
        ([99], [101], 99, 101),  # clustered first when near, next fixed first when snapped
        ([101], [99], 101, 101),
        ([102], [99], 99, 99),  # nothing clustered is near: fixed
        ([102], [98], None, 100),
        ([], [], None, 100),
    ],
)
def test_priorities_of_marks(spark, clustered, fixed, near, snap):
    df = lambda rows: spark.createDataFrame([("c", p) for p in rows], "k string, pos long")
    args = (df([100]), df(clustered), df(fixed), ["k"], 1)
    assert asof.nearest_mark(*args).first()["mark"] == near
    assert asof.snapped(*args).first()["mark"] == snap


def test_snapped_exons_drop_what_is_too_short(spark):
    exons = spark.createDataFrame([("c", 10, 20), ("c", 30, 32), ("c", 40, 43)], "chrom string, start long, end long")
    marks = spark.createDataFrame([("c", "START", 11), ("c", "END", 21), ("c", "START", 41)], "chrom string, kind string, pos long")
    found = asof.snapped_exons(exons, marks, marks.where("false"), ["chrom"])
    assert [tuple(r) for r in found.collect()] == [("c", 11, 21)]


def graph(spark, arcs):
    return spark.createDataFrame([("g", a, b) for a, b in arcs], "k string, a long, b long")


def nodes(spark, ids):
    return spark.createDataFrame([("g", n) for n in ids], "k string, node long")


def counted(monkeypatch):
    calls, real = [], chains.written
    monkeypatch.setattr(chains, "written", lambda df: calls.append(1) or real(df))
    return calls


def test_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    calls = counted(monkeypatch)
    arcs = graph(spark, [(i, i + 1) for i in range(n - 1)])
    found = {r["node"]: (r["chain"], r["place"]) for r in chains.chains(nodes(spark, range(n)), arcs, ["k"]).collect()}
    assert found == {i: (0, i) for i in range(n)}
    assert len(calls) < 2 + 2 * 20  # two tables a round
    calls.clear()
    got = chains.reachable(arcs, nodes(spark, [4000]), ["k"])
    assert got.count() == n - 4000
    assert len(calls) < 60


def test_chains_stop_at_branches_and_rings(spark):
    arcs = [(1, 2), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6), (6, 7), (20, 21), (21, 22), (22, 20), (30, 30)]
    ids = sorted({x for arc in arcs for x in arc} | {40})
    found = {r["node"]: (r["chain"], r["place"]) for r in chains.chains(nodes(spark, ids), graph(spark, arcs), ["k"]).collect()}
    assert found == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (6, 1), 20: (20, 0), 21: (21, 0), 22: (22, 0), 30: (30, 0), 40: (40, 0)}
    short = chains.contracted(graph(spark, arcs[:7]), chains.chains(nodes(spark, ids), graph(spark, arcs[:7]), ["k"]), ["k"])
    assert sorted((r["a"], r["b"]) for r in short.collect()) == [(1, 4), (1, 5), (4, 6), (5, 6)]


def test_reachable_against_a_walk(spark):
    rng = random.Random(5)
    arcs = sorted({(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 80) for _ in range(90))} | {(90, 91), (91, 90)})
    starts = [3, 17, 40, 91, 200]
    seen, todo = set(starts), list(starts)
    while todo:
        at = todo.pop()
        for a, b in arcs:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    found = chains.reachable(graph(spark, arcs), nodes(spark, starts), ["k"])
    assert sorted(r["node"] for r in found.collect()) == sorted(seen)


def test_groups_across_bins_equal_a_walk(spark):
    from spanweave.operators import intervals

    rng = random.Random(11)
    rows = [("c", rng.randrange(200), rng.randrange(3), rng.random() < 0.3) for _ in range(150)]
    df = spark.createDataFrame(rows, "chrom string, pos bigint, sample_id int, evidence boolean")
    runs = []
    for p in sorted({r[1] for r in rows}):
        if runs and p - runs[-1][-1] <= 2:
            runs[-1].append(p)
        else:
            runs.append([p])
    want = []
    for run in runs:
        own = [r for r in rows if r[1] in run]
        if any(r[3] for r in own) and len({r[2] for r in own}) * 100 // 3 >= 40:
            want.append(("c", run[0], run[-1], len(own), len({r[2] for r in own})))
    for size in (4, 64, 1 << 16):
        found = intervals.position_groups(df, ["chrom"], 3, merge=2, least_percent=40, bin_size=size)
        assert sorted(map(tuple, found.select("chrom", "start", "end", "n", "n_samples").collect())) == want
    counted = df.groupBy("chrom", "pos", "sample_id").agg({"evidence": "max", "*": "count"}).toDF("chrom", "pos", "sample_id", "evidence", "n")
    found = intervals.position_groups(counted, ["chrom"], 3, merge=2, least_percent=40, bin_size=16)
    assert sorted(map(tuple, found.select("chrom", "start", "end", "n", "n_samples").collect())) == want


def test_no_frame_of_an_asof_join_is_read_again_for_each_row(spark):
    points = spark.createDataFrame([("c", 5)], "chrom string, pos bigint")
    plan = asof.around(points, {"m": points}, ["chrom"])._jdf.queryExecution().optimizedPlan().toString()
    near = [line for line in plan.splitlines() if "_near_" in line and "Window" in line]
    assert near and not any("unboundedfollowing" in line.lower() for line in near)


def test_raw_exons_lie_between_gaps(spark, monkeypatch):
    from spanweave.operators import intervals

    def unwanted(*_):
        raise AssertionError("all covered stretches are sorted again")

    monkeypatch.setattr(intervals, "islands", unwanted)
    rng = random.Random(3)
    rows = [(k, left, left + rng.randrange(9)) for k in "ab" for left in (rng.randrange(400) for _ in range(60))] + [("c", 7, 7)]
    df = spark.createDataFrame(rows, "k string, left bigint, right bigint")
    want = []
    for k in "abc":
        own = None
        for _, left, right in sorted(r for r in rows if r[0] == k):
            if own and left - own[1] < 5:
                own[1] = max(own[1], right)
            else:
                own = [left, right]
                want.append((k, own))
    want = sorted((k, *own) for k, own in want)
    for size in (4, 32, 1 << 16):
        assert sorted(map(tuple, intervals.covered_stretches(df, ["k"], bin_size=size).collect())) == want
    assert intervals.covered_stretches(df.limit(0), ["k"]).count() == 0
