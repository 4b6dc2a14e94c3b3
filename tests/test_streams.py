"""Streams that run: blocks by keyed state, late rows included, and blocks by time."""

import os
import random

from pyspark.sql import functions as F

from spanweave.operators import intervals
from spanweave.streaming import blocks

SCHEMA = "chrom string, left long, right long"


def streamed(spark, path, batches, build, schema=SCHEMA):
    (path / "in").mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/batch{i}")
        file = next((path / f"batch{i}").glob("part-*")).rename(path / "in" / f"{i}.parquet")
        os.utime(file, (1e9 + i, 1e9 + i))  # the files' times decide their order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    name = f"out_{random.randrange(1 << 30)}"
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start()
    assert query.awaitTermination(120)
    return spark.table(name)


def test_blocks_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted((rng.choice("ab"), p, p + rng.randint(0, 12)) for p in (rng.randint(0, 3000) for _ in range(300)))
    by_pos = sorted(rows, key=lambda r: r[1])
    batches = [by_pos[i : i + 75] for i in range(0, 300, 75)]
    for b in batches:
        rng.shuffle(b)
    # batches are cut at a position, so no row is late
    batches.append([("a", None, None), ("b", None, None)])
    got = streamed(spark, tmp_path, batches, lambda s: blocks.position_blocks(s, ["chrom"])).collect()
    late = sum(r["late"] for r in got)
    want = intervals.islands(spark.createDataFrame(rows, SCHEMA), ["chrom"])
    assert late == 0
    assert {tuple(r)[:4] for r in got} == {(r["chrom"], r["start"], r["end"], r["n"]) for r in want.collect()}


def test_late_rows_join_nothing(spark, tmp_path):
    batches = [
        [("a", 1, 10), ("a", 8, 20), ("a", 100, 110)],  # 1 to 20 is given out
        [("a", 15, 18), ("a", 26, 30), ("a", 105, 120)],  # two are late, one grows the open block
        [("a", 300, 301), ("a", 27, 40)],  # out of order, but beside no block that was given out
        [("a", None, None), ("b", 5, 6)],
    ]
    got = streamed(spark, tmp_path, batches, lambda s: blocks.position_blocks(s, ["chrom"]))
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 20, 2, 0), ("a", 27, 40, 1, 2), ("a", 100, 120, 2, 0), ("a", 300, 301, 1, 0)]


def test_event_blocks_on_a_stream(spark, tmp_path):
    at = lambda minutes: 1_700_000_000 + 60 * minutes
    batches = [
        [(1, at(0)), (1, at(10)), (2, at(5))],
        [(1, at(300)), (2, at(301))],
        [(2, at(302))],  # late rows are told by the watermark of the batch before
        [(1, at(12)), (1, at(700))],  # the first comes hours behind it
        [(1, at(1400))],
    ]
    got = streamed(
        spark, tmp_path, batches, lambda s: blocks.event_blocks(s.withColumn("ts", F.timestamp_seconds("t")), late="1 hour"), "user_id long, t long"
    )
    rows = sorted((r["user_id"], int(r["first_ts"].timestamp()), int(r["last_ts"].timestamp()), r["n"]) for r in got.collect())
    assert rows == [(1, at(0), at(10), 2), (1, at(300), at(300), 1), (1, at(700), at(700), 1), (2, at(5), at(5), 1), (2, at(301), at(302), 2)]
