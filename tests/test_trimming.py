"""Edge trimming against a walk over positions, and each limit by hand."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from spanweave.operators import tables, trimming
from spanweave.operators.trimming import TrimLimits

SMALL = TrimLimits(percent=40, low=2, high=8, least_max=4, report=4, cut=6, above=3)


def walk(exons, bounds, segs, lim):
    """Trimmed exons of one key, position by position."""
    starts, ends = {p for k, p in bounds if k == "START"}, {p for k, p in bounds if k == "END"}
    depth = lambda p: sum(a <= p <= b for a, b in segs)
    out = []
    for start, end in sorted(exons):
        at = [start] + [p for p in range(start + 1, end + 1) if p in starts or p - 1 in ends] + [end + 1]
        for a, b in zip(at, at[1:], strict=False):
            b -= 1
            deep = [depth(p) for p in range(a, b + 1)]
            limit = min(max(max(deep) * lim.percent // 100, lim.low), lim.high)
            if max(deep) >= lim.least_max and min(deep) <= limit:
                found, p = [], a
                while p <= b:
                    q = p
                    while q <= b and depth(q) >= limit:
                        q += 1
                    if q > p:
                        if found and p - found[-1][1] < lim.report:
                            found[-1][1] = q - 1
                        elif q - p >= lim.report:
                            found.append([p, q - 1])
                    p = q + 1
                if len(found) == 1:
                    lo, hi = found[0]
                    enough = hi - lo + 1 >= lim.cut and max(map(depth, range(lo, hi + 1))) > lim.above
                    if lo == a:
                        if enough and b not in ends and b - hi >= lim.cut:
                            b = hi
                    elif hi == b and enough and a not in starts and lo - a >= lim.cut:
                        a = lo
            out.append([a, b])
    merged = []
    for a, b in out:
        if merged and merged[-1][1] + 1 == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [tuple(x) for x in merged]


def run(spark, exons, bounds, segs, lim):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    return trimming.trimmed_exons(
        df(exons, "k string, start long, end long"), df(bounds, "k string, kind string, pos long"), df(segs, "k string, left long, right long"), ["k"], lim
    )


def test_trimming_against_a_walk(spark):
    rng = random.Random(4)
    exons, bounds, segs = [], [], []
    for k in range(60):
        for start in (10, 100):
            end = start + rng.randint(5, 60)
            exons.append((f"c{k}", start, end))
            bounds += [(f"c{k}", rng.choice(["START", "END"]), rng.randint(start - 1, end + 1)) for _ in range(rng.choice([0, 0, 1, 2]))]
            for _ in range(rng.choice([3, 8])):
                at = rng.choice([start, rng.randint(start, end)])
                segs += [(f"c{k}", at, min(end, at + rng.randint(2, 25)))] * rng.choice([1, 1, 2, 4])
    found = {}
    for r in run(spark, exons, bounds, segs, SMALL).collect():
        found.setdefault(r["k"], []).append((r["start"], r["end"]))
    of = lambda rows, k: [tuple(r[1:]) for r in rows if r[0] == k]
    cut = 0
    for k in {e[0] for e in exons}:
        want = walk(of(exons, k), of(bounds, k), of(segs, k), SMALL)
        assert sorted(found[k]) == want, k
        cut += want != sorted(of(exons, k))
    assert cut > 10


DEEP = [("c", 1, 200)] * 60  # ten percent are 6, held at 15
THIN = [("c", 1, 400)] * 5


@pytest.mark.parametrize(
    "exon_end, bounds, segs, expected",
    [
        (400, [], DEEP + THIN, [(1, 200)]),
        (299, [], DEEP + THIN, [(1, 299)]),  # 99 would go
        (300, [], DEEP + THIN, [(1, 200)]),  # 100 go
        (400, [("c", "END", 400)], DEEP + THIN, [(1, 400)]),  # the edge is a boundary
        (400, [("c", "START", 400)], DEEP + THIN, [(1, 200), (400, 400)]),  # a boundary of the other kind
        (400, [], [("c", 1, 99)] * 65 + THIN, [(1, 400)]),  # too short to stay alone
        (400, [], [("c", 1, 200)] * 54 + THIN, [(1, 400)]),  # largest depth 59
        (400, [], [("c", 201, 400)] * 60 + THIN, [(201, 400)]),  # a shallow start
        (400, [], [("c", 101, 300)] * 60 + THIN, [(1, 400)]),  # deep in the middle only
        (400, [], [("c", 1, 150), ("c", 300, 400)] * 60 + THIN, [(1, 400)]),  # two deep stretches
        (400, [], [("c", 1, 150), ("c", 189, 220)] * 60 + THIN, [(1, 220)]),  # 39 apart: one
        (400, [], [("c", 1, 150), ("c", 190, 220)] * 60 + THIN, [(1, 150)]),  # 40 apart, and too short to count
    ],
)
def test_limits_by_hand(spark, exon_end, bounds, segs, expected):
    segs = [(k, a, min(b, exon_end)) for k, a, b in segs]
    found = run(spark, [("c", 1, exon_end)], bounds, segs, TrimLimits())
    assert sorted((r["start"], r["end"]) for r in found.collect()) == expected


def test_written_steps_leave_no_shuffle_files(spark, monkeypatch):
    """A step's shuffle files go while later ones are written, and a table's files when it is freed."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = disk.getAllFiles()
        names = {files.apply(i).getName() for i in range(files.size())}
        return {n for n in names if n.startswith("shuffle_")}

    was = held()
    monkeypatch.setattr(tables, "CLEAN_SECONDS", 0.0)
    table = tables.written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    made = held() - was
    for _ in range(20):
        if not made & held():
            break
        tables.freed(tables.written(spark.range(1)))  # a later step
        time.sleep(0.3)
    assert not made & held() and table.count() == 10
    folder = {f.rsplit("/", 1)[0].removeprefix("file://") for f in table.inputFiles()}
    tables.freed(table)
    assert len(folder) == 1 and not any(os.path.exists(f) for f in folder)
