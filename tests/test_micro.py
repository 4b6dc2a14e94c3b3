"""Cases computed by hand."""

import pytest
from pyspark.sql import functions as F

from spanweave.functions import alignment as A
from spanweave.functions.scores import merged_score
from spanweave.operators import graph, intervals, quantify, reads
from spanweave.sources import text


def segs(spark, cigar, pos=100):
    row = spark.createDataFrame([(cigar, pos)], "cigar string, pos long").select(A.segments(F.col("cigar"), F.col("pos")).alias("s")).first()
    return [(x.left, x.right) for x in row.s]


@pytest.mark.parametrize(
    "cigar, expected",
    [
        ("10M5N20M", [(100, 109), (115, 134)]),
        ("10M3N20M", [(100, 132)]),
        ("10M4N20M", [(100, 109), (114, 133)]),
        ("5S10M2I10M", [(100, 119)]),
        (None, []),
        ("", []),
    ],
)
def test_cigar_fold(spark, cigar, expected):
    assert segs(spark, cigar) == expected


def test_short_anchor_drops_its_intron(spark):
    df = spark.createDataFrame([("9M50N20M50N20M", 1)], "cigar string, pos long")
    row = df.select(A.anchored_introns(A.segments(F.col("cigar"), F.col("pos"))).alias("j")).first()
    assert [(x.left, x.right) for x in row.j] == [(80, 129)]


@pytest.mark.parametrize("second, n", [((156, 180), 1), ((157, 180), 2), ((120, 130), 1)])
def test_islands(spark, second, n):
    df = spark.createDataFrame([("c", 100, 150), ("c", *second)], "chrom string, left long, right long")
    assert intervals.islands(df, ["chrom"]).count() == n


def test_islands_do_not_depend_on_bins_or_order(spark):
    rows = [("c", (i * 7919) % 3000, (i * 7919) % 3000 + i % 40) for i in range(300)] * 2
    df = spark.createDataFrame(rows, "chrom string, left long, right long")
    found = [sorted(map(tuple, intervals.islands(d, ["chrom"], bin_size=b).collect())) for b in (64, 1 << 16) for d in (df, df.orderBy("right"))]
    assert all(x == found[0] for x in found)


@pytest.mark.parametrize("second, n", [((14, 20), 1), ((15, 20), 2)])
def test_stretches_join(spark, second, n):
    df = spark.createDataFrame([("c", 1, 10), ("c", *second)], "chrom string, left long, right long")
    assert intervals.covered_stretches(df, ["chrom"]).count() == n


def test_votes(spark):
    df = spark.createDataFrame([(1, 3), (2, 3), (1, 2)], "n int, t int")
    low, high = ([r[0] for r in df.select(A.vote(F.col("n"), F.col("t"), m)).collect()] for m in ("low", "high"))
    assert low == [True, True, True] and high == [False, True, False]


def test_scores():
    assert merged_score([4, 9, 100]) == pytest.approx(24.495, abs=1e-3)
    assert merged_score([]) is None and merged_score(None) is None


def test_abundance(spark):
    df = spark.createDataFrame([(10.0, 1000, 100.0, 1_000_000), (0.1, 100, 100.0, 1_000_000)], "m double, e long, r double, n long")
    got = df.select(A.read_count(F.col("m"), F.col("e"), F.col("r")), A.fpkm(F.col("m"), F.col("r"), F.col("n"))).collect()
    assert [r[0] for r in got] == [50, 1] and got[0][1] == pytest.approx(50)


def test_weighted_mean(spark):
    df = spark.createDataFrame([(1, 10.0, 100), (1, 40.0, 50)], "id int, mean double, weight long")
    assert tuple(quantify.combined(df, ["id"]).first()) == (1, 20.0, 150)


def test_nested(spark):
    rows = [(1, "c", 1, 600, [(101, 499)], 5, 5.0), (2, "c", 150, 400, [(200, 300)], 5, 5.0)]
    df = spark.createDataFrame(rows, "id long, chrom string, start long, end long, gaps array<struct<left:long,right:long>>, flow long, score double")
    assert [r.id for r in intervals.without_nested(df, df, ["chrom"]).collect()] == [2]


def test_reduction_and_components(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 9)], "a long, b long")
    assert sorted(map(tuple, graph.reduced(arcs).collect())) == [(1, 2), (2, 3), (7, 9)]
    assert sorted(map(tuple, graph.components(arcs).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)]


def test_dead_ends(spark):
    arcs = spark.createDataFrame([("r", 1, 2), ("r", 2, 3), ("r", 2, 4), ("r", 5, 3)], "k string, a long, b long")
    at = lambda *n: spark.createDataFrame([("r", x) for x in n], "k string, node long")
    left = graph.without_dead_ends(arcs, at(1), at(3), ["k"])
    assert sorted((r.a, r.b) for r in left.collect()) == [(1, 2), (2, 3)]


def test_compaction(spark):
    df = spark.createDataFrame([("t", 1, 50), ("t", 51, 80), ("t", 100, 120)], "t string, start long, end long")
    assert sorted((r.start, r.end) for r in quantify.compacted(df, ["t"]).collect()) == [(1, 80), (100, 120)]


def test_sibling_junctions(spark):
    def valid(a, b):
        rows = [("c", "+", 10, 20, 0, a), ("c", "+", 10, 30, 0, b)]
        df = spark.createDataFrame(rows, "chrom string, strand string, jl long, jr long, sample_id int, n long")
        return {r.jr: r.holds_left for r in reads.supported_junctions(df, 1).collect()}[20]

    assert not valid(3, 25) and valid(3, 24)


def test_modes(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, "c")], "k int, v string")
    assert sorted(r.v for r in quantify.modes(df, ["k"], "v").collect()) == ["a", "b"]
    assert quantify.common_value(df, ["k"], "v").first().v == "a"


def test_sam_and_gtf(spark, tmp_path):
    sam = tmp_path / "a.sam"
    sam.write_text("@SQ\tSN:c1\tLN:9\nq\t99\tc1\t100\t60\t10M\t=\t150\t60\tACGTACGTAC\t*\tXS:A:+\nshort\n")
    r = text.read_sam(spark, str(sam)).collect()
    assert len(r) == 1 and (r[0].chrom, r[0].pos, r[0].xs, r[0].seq_len, r[0].mate_chrom) == ("c1", 100, "+", 10, "c1")
    assert [x.chrom for x in text.sam_chromosomes(spark, [str(sam)]).collect()] == ["c1"]
    gtf = tmp_path / "a.gtf"
    gtf.write_text('# x\nc\ts\texon\t30\t20\t.\t+\t.\tgene_id "g"; transcript_id "t";\nc\ts\texon\t1\t9\t.\t+\t.\ttranscript_id "t"; gene_id "g"\nc\ts\tCDS\t1\t9\t.\t+\t.\tx\nc\ts\texon\t5\t6\t.\t-\t.\tParent=a,b\n')
    t = {x.transcript_id: x for x in text.guide_transcripts(text.read_gtf(spark, str(gtf))).collect()}
    assert (t["t"].gene_id, t["t"].start, t["t"].end, len(t["t"].exons)) == ("g", 1, 30, 2)
    assert t["a"].gene_id is None and t["b"].start == 5
    lines = text.gtf_lines(text.guide_transcripts(text.read_gtf(spark, str(gtf))).withColumns({"fpkm": F.lit(1.0), "cov": F.lit(2.0)}))
    assert lines.count() == 7


def brute_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components_of_whole_tables(spark, tmp_path):
    import random

    from spanweave import registry

    run = registry.queries()["components"]
    rows = [(r.l_suppkey, 10**12 + r.l_partkey) for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").collect()]
    assert {r.node: r.component for r in run(spark, "/root/testdata/sf0.001").collect()} == brute_components(rows)
    rng = random.Random(3)
    few = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 4), (5, None)]
    spark.createDataFrame(few, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = brute_components((a, 10**12 + b) for a, b in few if a is not None and b is not None)
    assert {r.node: r.component for r in run(spark, str(tmp_path)).collect()} == want and len(set(want.values())) > 5


def test_low_boundaries_by_votes(spark):
    """10 -> 20 is the only way on from a deep exon; 30 -> 50 has a second way and a shallow end."""
    arcs = spark.createDataFrame(
        [("c", 10, 20, 15, 0, 1), ("c", 10, 20, 15, 1, 1), ("c", 30, 50, 39, 0, 1), ("c", 30, 70, 39, 0, 5), ("c", 60, 70, 65, 0, 5)],
        "chrom string, a long, b long, a_end long, sample_id int, n long",
    )
    means = spark.createDataFrame(
        [("c", 10, 0, 20.0), ("c", 10, 1, 19.9), ("c", 10, 2, 10.0), ("c", 20, 0, 1.0), ("c", 30, 0, 500.0), ("c", 50, 0, 19.0)],
        "chrom string, start long, sample_id int, mean double",
    )
    # sample 0 votes by 20 >= 10 * 1 + 10, sample 1 doesn't by 19.9, sample 2 has no reads and 10 >= 10: 66 %
    got = graph.low_boundaries(arcs, means, ["chrom"], (0, 1, 2)).collect()
    assert [tuple(r) for r in got] == [("c", 10, 20, 2, True, True)]


def test_small_junctions_by_votes(spark):
    arcs = spark.createDataFrame([("c", 1, 2, 0, 1), ("c", 1, 2, 1, 1), ("c", 1, 2, 2, 2), ("c", 2, 3, 0, 1)], "chrom string, a long, b long, sample_id int, n long")
    rows = [("c", e, s, n) for e, n in ((1, 20), (2, 20), (3, 19)) for s in (0, 1, 2)]
    nodes = spark.createDataFrame(rows, "chrom string, exon_id long, sample_id int, n long")
    # 2 * 1 + 18 = 20 in two samples; 2 * 4 + 18 = 26 isn't reached in the third
    got = graph.small_junctions(arcs, nodes, ["chrom"], 3).collect()
    assert [tuple(r) for r in got] == [("c", 1, 2, 2)]


def test_retained_introns_by_votes(spark):
    arcs = spark.createDataFrame(
        [("c", 10, 20, 19, 0, 3), ("c", 20, 30, 29, 0, 3), ("c", 10, 30, 19, 0, 40)],
        "chrom string, a long, b long, a_end long, sample_id int, n long",
    )
    means = spark.createDataFrame([("c", 20, 0, 11.9)], "chrom string, start long, sample_id int, mean double")
    nodes = spark.createDataFrame([("c", 20, 0, 44)], "chrom string, exon_id long, sample_id int, n long")
    got = graph.retained_introns(means, arcs, nodes, ["chrom"], (0,)).collect()
    assert [tuple(r) for r in got] == [("c", 10, 20, 30, 1)]
    thick = nodes.withColumn("n", F.lit(45).cast("long"))
    assert graph.retained_introns(means, arcs, thick, ["chrom"], (0,)).count() == 0


def test_neighbour_capacities(spark):
    arcs = spark.createDataFrame([("c", 10, 20, 19, 0, 6), ("c", 10, 40, 19, 0, 2), ("c", 15, 20, 18, 0, 2)], "chrom string, a long, b long, a_end long, sample_id int, n long")
    means = spark.createDataFrame([("c", 10, 0, 4.0), ("c", 20, 0, 6.0)], "chrom string, start long, sample_id int, mean double")
    # of 10's coverage 4 * 6 / 8, of 20's 6 * 6 / 8
    got = graph.neighbour_capacities(arcs, means, ["chrom"]).collect()
    assert [(r.a, r.b, r.capacity) for r in got] == [(10, 20, 3.0)]


def test_reduced_containment_and_splits(spark):
    held = spark.createDataFrame([("c", [1], [1, 2]), ("c", [1], [1, 2, 3]), ("c", [1, 2], [1, 2, 3])], "chrom string, inner array<long>, outer array<long>")
    got = graph.reduced_containment(held, ["chrom"]).collect()
    assert sorted((r.inner, r.outer) for r in got) == [([1], [1, 2]), ([1, 2], [1, 2, 3])]
    cut = graph.split_bins(spark.createDataFrame([("c", [1, 2, 3]), ("c", [1, 2])], "chrom string, exon_ids array<long>"), ["chrom"]).collect()
    assert [(r.exon_id, r.left, r.right) for r in cut] == [(2, [1, 2], [2, 3])]
