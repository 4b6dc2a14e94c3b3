"""BAM files written here, read back as partitions with and without filters."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from spanweave.operators import reads
from spanweave.sources import bam

NAMES = ["c1", "c2", "empty", "c3"]


def block(data):
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = body.compress(data) + body.flush()
    size = 18 + len(body) + 8
    return struct.pack("<4BIBBH2sHH", 31, 139, 8, 4, 0, 0, 255, 6, b"BC", 2, size - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(ref, pos, cigar, name, flag, mapq, n_bases, xs):
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(op)) for n, op in cigar)
    tags = b"NMC\x02" + b"MDZ10A5\0" + b"ZBBs" + struct.pack("<i2h", 2, 7, 8) + (b"XSA" + xs.encode() if xs else b"")
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, n_bases, -1, -1, 0)
    body += name.encode() + b"\0" + ops + b"\x11" * ((n_bases + 1) // 2) + b"\xff" * n_bases + tags
    return struct.pack("<i", len(body)) + body


def write(path, rows, per_block=7, index=True):
    """Sorted rows (ref, pos, cigar, name, flag, mapq, n_bases, xs); a record may run over the end of a block."""
    head = b"BAM\x01" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", len(NAMES))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 10**7) for n in NAMES)
    out, places, spans = block(head), [], {}
    for at in range(0, len(rows), per_block):
        data = b""
        for r in rows[at : at + per_block]:
            places.append(len(out) << 16 | len(data))
            data += packed(*r)
        half = len(data) // 2  # two blocks: a record is cut in the middle
        first = block(data[:half])
        for i in range(len(places) - len(rows[at : at + per_block]), len(places)):
            if places[i] & 0xFFFF >= half:
                places[i] = (len(out) + len(first)) << 16 | (places[i] & 0xFFFF) - half
        out += first + block(data[half:])
    end = len(out) << 16
    out += block(b"")
    path.write_bytes(out)
    if index:
        for i, r in enumerate(rows):
            if r[0] >= 0:
                stop = places[i + 1] if i + 1 < len(rows) else end
                first, _, windows = spans.get(r[0], (places[i], 0, {}))
                length = sum(n for n, op in r[2] if op in "MDN=X")
                for w in range(r[1] >> 14, (r[1] + max(1, length) - 1 >> 14) + 1):
                    windows.setdefault(w, places[i])
                spans[r[0]] = (first, stop, windows)
        bai = b"BAI\x01" + struct.pack("<i", len(NAMES))
        for ref in range(len(NAMES)):
            first, stop, windows = spans.get(ref, (0, 0, {}))
            bai += struct.pack("<i", 2 if windows else 0)
            if windows:
                bai += struct.pack("<IiQQ", 0, 1, first, stop) + struct.pack("<IiQQQQ", 37450, 2, 0, 1, 2, 3)
            line = [windows.get(w, 0) for w in range(max(windows, default=-1) + 1)]
            bai += struct.pack(f"<i{len(line)}Q", len(line), *line)
        (path.parent / f"{path.name}.bai").write_bytes(bai)
    return str(path)


def some_rows(n=400):
    rng = random.Random(2)
    rows = sorted(((rng.choice([0, 0, 1, 3]), rng.randint(0, 200_000)) for _ in range(n)), key=lambda r: r)
    out = []
    for i, (ref, pos) in enumerate(rows):
        cigar = rng.choice([[(50, "M")], [(3, "S"), (20, "M"), (30_000, "N"), (27, "M")], [(10, "M"), (2, "I"), (5, "D"), (9, "=")]])
        out.append((ref, pos, cigar, f"r{i}", rng.choice([0, 16, 99]), rng.randint(0, 60), rng.choice([0, 50, 51]), rng.choice(["+", "-", None])))
    return [*out, (-1, -1, [], "lost", 4, 0, 20, None)]


def expected(rows):
    text = lambda cigar: "".join(f"{n}{op}" for n, op in cigar) or None
    return sorted(((NAMES[r[0]] if r[0] >= 0 else None, r[1] + 1, r[5], r[4], text(r[2]), r[3], r[7], r[6]) for r in rows), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("chrom", "pos", "mapq", "flag", "cigar", "qname", "xs", "seq_len").collect()), key=str)


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("partition_bytes", [1, 3000, 1 << 26])
def test_all_records(spark, tmp_path, index, partition_bytes):
    rows = some_rows()
    df = bam.read_bam(spark, write(tmp_path / "a.bam", rows, index=index), partition_bytes=partition_bytes)
    assert found(df) == expected(rows)
    assert df.select("read_id").distinct().count() == len(rows)
    n = df.rdd.getNumPartitions()
    assert (n > 20 if partition_bytes == 1 else n >= 4) if index else n == 1  # each sequence on its own, and what has no place


FILTERS = {
    "chrom = 'c2'": lambda r: r[0] == "c2",
    "chrom in ('c1', 'c3') and pos >= 50000": lambda r: r[0] in ("c1", "c3") and r[1] >= 50_000,
    "chrom = 'c1' and pos > 16384 and pos < 40000": lambda r: r[0] == "c1" and 16_384 < r[1] < 40_000,
    "pos = 77": lambda r: r[1] == 77,
    "chrom = 'c1' and pos <= 32768 and mapq > 20": lambda r: r[0] == "c1" and r[1] <= 32_768 and r[2] > 20,
    "chrom = 'empty'": lambda r: False,
    "chrom = 'no such'": lambda r: False,
    "chrom = 'c1' and chrom = 'c2'": lambda r: False,
    "chrom = 'c1' and pos > 10000000": lambda r: False,
    "chrom is null": lambda r: r[0] is None,
}


@pytest.mark.parametrize("index", [True, False])
def test_filters_choose_the_same_records(spark, tmp_path, index):
    rows = some_rows()
    df = bam.read_bam(spark, write(tmp_path / "a.bam", rows, index=index), partition_bytes=1)
    for text, keep in FILTERS.items():
        assert found(df.where(text)) == [r for r in expected(rows) if keep(r)], text


def test_filters_reach_the_index(spark, tmp_path):
    df = bam.read_bam(spark, write(tmp_path / "a.bam", some_rows()), partition_bytes=1)
    whole = df.rdd.getNumPartitions()
    one = df.where("chrom = 'c1'")
    part = df.where("chrom = 'c1' and pos > 60000 and pos < 70000")
    assert whole > one.rdd.getNumPartitions() > part.rdd.getNumPartitions() >= 1
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan bam" in plan and "= c1" not in plan and "60000" not in plan  # Spark has nothing left to compare
    assert "mapq" in df.where("mapq > 20")._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].split("Filter")[1]


def test_samples_and_empty_files(spark, tmp_path):
    a, b = write(tmp_path / "a.bam", some_rows(20)), write(tmp_path / "b.bam", [])
    df = bam.read_bam(spark, [b, a, a], pool=2)
    assert {(r["input_no"], r["sample_id"], r["count"]) for r in df.groupBy("input_no", "sample_id").count().collect()} == {(1, 0, 21), (2, 1, 21)}
    assert df.select("read_id").distinct().count() == 42
    kept = reads.with_segments(reads.usable(df.withColumn("strand", F.col("xs"))))
    assert kept.count() > 0  # the columns are those of the other readers


def test_broken_files_are_named(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(b"no bam at all, but long enough")
    with pytest.raises(Exception, match="no block of a BAM file"):
        bam.read_bam(spark, str(tmp_path / "x.bam")).count()


def test_merged_inputs_keep_their_order(spark):
    rows = [("a", 5, n) for n in range(3)] + [("a", 1, 0), ("b", 1, 1)]
    inputs = [spark.createDataFrame([r for r in rows if r[2] == n], "chrom string, pos long, n int") for n in range(3)]
    out = reads.merged(*inputs)
    assert [(r["chrom"], r["pos"], r["input_no"]) for r in out.collect()] == [("a", 1, 0), ("a", 5, 0), ("a", 5, 1), ("a", 5, 2), ("b", 1, 1)]
    assert "rangepartitioning" in out._jdf.queryExecution().toString()
