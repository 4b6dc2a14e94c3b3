"""Strand islands and the evidence index, by hand and against plain loops."""

import random

from pyspark.sql import functions as F

from spanweave.operators import evidence, strands

READS = "read_id long, sample_id int, chrom string, xs string, segments array<struct<left:bigint,right:bigint>>"


def made(spark, rows):
    return spark.createDataFrame([(i, 0, "c", xs, segs) for i, (xs, segs) in enumerate(rows)], READS)


def test_reads_without_strand_follow_islands(spark):
    rows = [
        ("+", [(100, 150)]), ("+", [(140, 200)]),  # the island on +
        (None, [(160, 220)]),  # begins there: +
        (None, [(120, 130), (300, 330)]),  # spliced and unknown: gone
        ("-", [(190, 260)]), (None, [(195, 205)]),  # begins in both
        (None, [(250, 270)]),  # begins in - only
        (None, [(1000, 1050)]),  # begins in none
        ("+", [(1020, 1060)]),
    ]
    got = {}
    for r in strands.routed(made(spark, rows)).collect():
        got.setdefault(r.read_id, set()).add(r.strand)
    assert got == {0: {"+"}, 1: {"+"}, 2: {"+"}, 4: {"-"}, 5: {"+", "-"}, 6: {"-"}, 7: {"+", "-"}, 8: {"+"}}


def test_islands_against_their_reads(spark):
    rows = [
        ("+", [(100, 150)]), ("+", [(100, 160)]),  # two reads: one opens, one proves
        ("-", [(120, 170)]),  # opens its island alone, and + doesn't begin in it
        (None, [(1000, 1050)]), ("+", [(1020, 1060)]),  # only the other strand on -: goes
        ("+", [(2000, 2100)]), ("-", [(2050, 2110)]),  # + is only opened and discouraged: goes
    ]
    got = {(r.strand, r.start): (r.end, r.n, r.evidence, r.discouraged, r.kept) for r in strands.judged_islands(strands.routed(made(spark, rows))).collect()}
    assert got == {
        ("+", 100): (160, 2, True, True, True),
        ("-", 120): (170, 1, False, False, True),
        ("+", 1000): (1060, 2, True, False, True),
        ("-", 1000): (1050, 1, False, True, False),
        ("+", 2000): (2100, 1, False, True, False),
        ("-", 2050): (2110, 1, False, False, True),
    }
    assert strands.judged_islands(strands.routed(made(spark, rows).limit(0))).count() == 0


def test_evidence_against_loops(spark):
    rng = random.Random(2)
    exons = sorted(rng.sample(range(10, 100_000), 60))
    sets = [(rng.choice("xy"), sorted(rng.sample(exons, rng.randrange(1, 5))), rng.randrange(2), rng.randrange(1, 4)) for _ in range(200)]
    mates = []
    for _ in range(200):
        a, b = (rng.sample(exons, rng.randrange(1, 3)) for _ in range(2))
        mates.append((rng.choice("xy"), rng.randrange(2), sorted(a), sorted(b)))
    want = {}
    for c, e, s, n in sets:
        for x in e[1:-1]:
            want.setdefault((c, x, s), [0, 0])[0] += n
    for c, s, a, b in mates:
        if a[-1] >= b[0]:
            continue
        inside = [x for x in exons if a[-1] < x < b[0]] + ([a[-1]] if len(a) > 1 else []) + ([b[0]] if len(b) > 1 else [])
        for x in inside:
            want.setdefault((c, x, s), [0, 0])[1] += 1
    got = evidence.evidence_index(
        spark.createDataFrame(sets, "chrom string, exon_ids array<bigint>, sample_id int, n long"),
        spark.createDataFrame(mates, "chrom string, sample_id int, near array<bigint>, far array<bigint>"),
        spark.createDataFrame([(c, x) for c in "xy" for x in exons], "chrom string, exon_id long"),
        ["chrom"],
    )
    assert {(r.chrom, r.exon_id, r.sample_id): [r.crossing, r.spanning] for r in got.collect()} == want
    assert got.where(F.col("exon_id").isNull()).count() == 0
