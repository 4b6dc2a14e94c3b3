"""Reads and the exons they touch, joined by bins without gathering reads; raw exons by running ends."""

import random

from spanweave.operators import graph, intervals, pairs
from spanweave.plans import queries

KEYS = ["chrom", "strand"]
READ = "read_id long, sample_id int, chrom string, strand string, segments array<struct<left:long,right:long>>"


def _reads(seed, n=300):
    rng, out = random.Random(seed), []
    for i in range(n):
        pos, segments = rng.randint(1, 3000), []
        for _ in range(rng.randint(1, 3)):
            end = pos + rng.randint(0, 60)
            segments.append((pos, end))
            pos = end + rng.choice([6, 20, 90, 700, 1500])  # long gaps reach over several bins
        out.append((i, i % 3, "c", rng.choice("+-"), segments))
    return out


def test_touched_exons_equal_brute_force(spark):
    reads = _reads(1)
    exons = {s: [(p, p + 39 + k % 70) for k, p in enumerate(range(1, 8000, 120))] for s in "+-"}
    rows = [("c", s, *x) for s in exons for x in exons[s]]
    got = pairs.touched_exons(spark.createDataFrame(reads, READ), spark.createDataFrame(rows, "chrom string, strand string, start long, end long"), bin_size=64)
    want = {}
    for i, _, _, strand, segments in reads:
        hit = [(a, b, sum(max(0, min(r, b) - max(l, a) + 1) for l, r in segments)) for a, b in exons[strand]]
        hit = [x for x in hit if x[2]]
        if hit:
            want[i] = (segments[0][0], segments[-1][1], hit)
    assert any(r - l > 128 for l, r, _ in want.values()) and any(r - l < 64 for l, r, _ in want.values())
    assert {r["read_id"]: (r["left"], r["right"], [tuple(x) for x in r["exons"]]) for r in got.collect()} == want
    links = graph.linked(got, KEYS).collect()
    steps = {}
    for i, sample, _, strand, _ in reads:
        ids = [x[0] for x in want[i][2]] if i in want else []
        for a, b in zip(ids, [*ids[1:], None]):
            steps[strand, a, b, sample] = steps.get((strand, a, b, sample), 0) + 1
    assert {(r["strand"], r["a"], r["b"], r["sample_id"]): r["n"] for r in links} == steps


def test_covered_stretches_equal_brute_force_over_bins(spark):
    rng = random.Random(2)
    rows = [("c", s, p, p + rng.randint(0, 200 if rng.random() < 0.05 else 12)) for s in "+-" for p in (rng.randint(1, 4000) for _ in range(250))]
    found = intervals.covered_stretches(spark.createDataFrame(rows, "chrom string, strand string, left long, right long"), KEYS, bin_size=64)
    want = set()
    for s in "+-":
        start = stop = None
        for left, right in sorted(r[2:] for r in rows if r[1] == s):
            if start is not None and left - stop >= 5:
                want.add((s, start, stop))
                start = None
            start, stop = (left, right) if start is None else (start, max(stop, right))
        want.add((s, start, stop))
    got = [(r["strand"], r["start"], r["end"]) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_exon_sets_are_not_gathered_by_read(spark, capsys):
    queries._atoms(spark, "/root/testdata/sf0.001").explain(True)
    assert "collect_set" not in capsys.readouterr().out
