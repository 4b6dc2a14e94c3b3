"""BAM files as a Spark data source: indexed blocks are partitions, and filters on
chromosome and position choose them.

The format (fixed values are marked) is a series of gzip blocks that each name their
own compressed size; a virtual offset is a block's place in the file times 2**16 plus
a place inside the block.  The index beside a file (``.bai``) has, for each
sequence, the virtual offsets of its first and last records and of the first record
over each window of 16,384 positions.  Those offsets are where partitions begin, so a
task reads whole records and decompresses its own blocks only.  A file without an
index is one partition.

Files are opened through Arrow's file systems, so a path may be a URI; the driver and
all executors must be able to open it.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = (
    "voffset long, chrom string, pos long, mapq int, flag int, cigar string, qname string, "
    "mate_chrom string, mate_pos long, xs string, seq_len int"
)
#: Fixed values of the format: letters of CIGAR operations, sizes of tag values, bits of an
#: index window, and the index bin that holds no records.
CIGAR_OPS = "MIDNSHP=X"
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
WINDOW_BITS = 14
META_BIN = 37450
#: Compressed bytes of a partition, and records of a batch.
PARTITION_BYTES = 64 << 20
BATCH_ROWS = 20_000


@dataclass
class BamPartition(InputPartition):
    """Records from one virtual offset to another (None: to the end), of one sequence or of all."""

    begin: int
    end: int | None
    chrom: str | None


class Blocks:
    """Decompressed bytes from a virtual offset on, with the virtual offset of each place."""

    def __init__(self, file: pa.NativeFile, voffset: int):
        self.file, self.coffset, self.data, self.at = file, voffset >> 16, b"", voffset & 0xFFFF
        self.size = 0  # compressed bytes of the current block
        self._load()

    def _load(self) -> bool:
        self.file.seek(self.coffset)
        head = self.file.read(18)
        if len(head) < 18:
            self.data, self.size = b"", 0
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError(f"no block of a BAM file at byte {self.coffset}")
        extra = struct.unpack_from("<H", head, 10)[0]
        fields = head[12:] + self.file.read(extra - 6)
        place, size = 0, None
        while place + 4 <= extra:
            name, length = fields[place : place + 2], struct.unpack_from("<H", fields, place + 2)[0]
            if name == b"BC":
                size = struct.unpack_from("<H", fields, place + 4)[0] + 1
            place += 4 + length
        if size is None:
            raise ValueError(f"no block of a BAM file at byte {self.coffset}")
        self.size = size
        self.data = zlib.decompress(self.file.read(size - 12 - extra), wbits=-15)
        return True

    def voffset(self) -> int | None:
        """Where the next byte stands; None at the end of the file."""
        while self.at >= len(self.data):
            self.at -= len(self.data)
            self.coffset += self.size
            if not self._load():
                return None
        return self.coffset << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.voffset() is None:
                raise ValueError("the BAM file ends inside a record")
            parts.append(self.data[self.at : self.at + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def header(blocks: Blocks) -> list[str]:
    """Names of the sequences; ``blocks`` then stands at the first record."""
    if blocks.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        names.append(blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode())
        blocks.read(4)
    return names


def index_of(data: bytes) -> list[tuple[int, int, list[int]] | None]:
    """For each sequence the first and last virtual offset and the windows' offsets; None without records."""
    if data[:4] != b"BAI\x01":
        raise ValueError("not an index of a BAM file")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        first, last = None, 0
        n_bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n_bins):
            number, n_chunks = struct.unpack_from("<Ii", data, at)
            chunks = struct.unpack_from(f"<{2 * n_chunks}Q", data, at + 8)
            at += 8 + 16 * n_chunks
            if number != META_BIN and chunks:
                first = min(chunks[::2]) if first is None else min(first, *chunks[::2])
                last = max(last, *chunks[1::2])
        n_windows = struct.unpack_from("<i", data, at)[0]
        windows = list(struct.unpack_from(f"<{n_windows}Q", data, at + 4))
        at += 4 + 8 * n_windows
        out.append(None if first is None else (first, last, windows))
    return out


def xs_tag(tags: bytes) -> str | None:
    """The strand in the tag XS of type A."""
    at = 0
    while at + 3 <= len(tags):
        name, kind = tags[at : at + 2], chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            at = tags.index(b"\0", at) + 1
        elif kind == "B":
            item, n = chr(tags[at]), struct.unpack_from("<i", tags, at + 1)[0]
            at += 5 + n * TAG_BYTES[item]
        else:
            if name == b"XS" and kind == "A":
                return chr(tags[at]) if chr(tags[at]) in "+-" else None
            at += TAG_BYTES[kind]
    return None


def record(body: bytes, names: list[str]) -> tuple:
    """One record's columns but for the virtual offset; positions count from 1."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_bases, mate_ref, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", body)
    at = 32 + n_name
    ops = struct.unpack_from(f"<{n_ops}I", body, at)
    tags = at + 4 * n_ops + (n_bases + 1) // 2 + n_bases
    cigar = "".join(f"{op >> 4}{CIGAR_OPS[op & 15]}" for op in ops) or None
    name = lambda r: names[r] if r >= 0 else None
    return name(ref), pos + 1, mapq, flag, cigar, body[32 : at - 1].decode(), name(mate_ref), mate_pos + 1, xs_tag(body[tags:]), n_bases


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.chroms: list[str] | None = None
        self.low, self.high = None, None  # closed bounds of pos

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes chromosomes and bounds of the position over; other filters stay with Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("chrom",) and isinstance(f, EqualTo | In):
                wanted = [value] if isinstance(f, EqualTo) else list(value)
                self.chroms = [c for c in wanted if self.chroms is None or c in self.chroms]
            elif column == ("pos",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    low = value + isinstance(f, GreaterThan)
                    self.low = low if self.low is None else max(self.low, low)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    high = value - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            elif column == ("pos",) and isinstance(f, IsNotNull):
                pass  # pos is never null
            else:
                yield f

    def partitions(self) -> list[BamPartition]:
        fs, path = opened(self.path)
        with fs.open_input_file(path) as file:
            blocks = Blocks(file, 0)
            names = header(blocks)
            begin = blocks.voffset()
        if begin is None:
            return [BamPartition(0, 0, None)]
        if fs.get_file_info(f"{path}.bai").type == pafs.FileType.NotFound:
            return [BamPartition(begin, None, None)]
        with fs.open_input_file(f"{path}.bai") as file:
            index = index_of(file.read())
        found, last = [], begin
        for name, entry in zip(names, index, strict=False):
            if entry is None:
                continue
            last = max(last, entry[1])
            if self.chroms is None or name in self.chroms:
                found += self._ranges(name, *entry)
        if self.chroms is None and self.low is None and self.high is None:
            found.append(BamPartition(last, None, None))  # records without a place stand behind all others
        return found or [BamPartition(0, 0, None)]

    def _ranges(self, name: str, first: int, last: int, windows: list[int]) -> list[BamPartition]:
        """Partitions of a sequence's records from the window of ``low`` on; none begins behind the window of ``high``."""
        low = 0 if self.low is None else max(0, self.low - 1) >> WINDOW_BITS
        high = len(windows) if self.high is None else (max(0, self.high - 1) >> WINDOW_BITS) + 1
        if windows and low >= len(windows) or self.high is not None and self.high < 1:
            return []
        starts = sorted({v for v in windows[low:high] if v})
        begin = min((v for v in windows[low:] if v), default=first) if low else first
        cuts = [begin]
        for v in starts[bisect_left(starts, begin) :]:
            if (v >> 16) - (cuts[-1] >> 16) >= self.bytes:
                cuts.append(v)
        return [BamPartition(a, b, name) for a, b in zip(cuts, [*cuts[1:], last], strict=True)]

    def read(self, partition: BamPartition) -> Iterator[pa.RecordBatch]:
        if partition.end == 0:
            return
        fs, path = opened(self.path)
        with fs.open_input_file(path) as file:
            names = header(Blocks(file, 0))
            blocks, rows = Blocks(file, partition.begin), []
            while (voffset := blocks.voffset()) is not None and (partition.end is None or voffset < partition.end):
                row = record(blocks.read(struct.unpack("<i", blocks.read(4))[0]), names)
                if partition.chrom is not None and self.high is not None and row[1] > self.high:
                    break  # sorted by position inside a sequence
                if (self.low is None or row[1] >= self.low) and (self.high is None or row[1] <= self.high):
                    if self.chroms is None or row[0] in self.chroms:
                        rows.append((voffset, *row))
                if len(rows) == BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))]
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))


class BamDataSource(DataSource):
    """Options: ``path``; ``partitionBytes``, compressed bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, paths: str | list[str], pool: int = 1, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Records of BAM files with the columns of :func:`~spanweave.sources.text.read_sam`; input i belongs to sample i div ``pool``.

    Filters on ``chrom`` and ``pos`` reach the index.  A record without a place has no
    chromosome and position 0.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamDataSource)
    out = None
    for no, path in enumerate([paths] if isinstance(paths, str) else paths):
        rows = spark.read.format("bam").option("partitionBytes", partition_bytes).load(path)
        rows = rows.select(
            F.xxhash64(F.lit(no), "voffset").alias("read_id"), F.lit(no // pool).alias("sample_id"), F.lit(no).alias("input_no"),
            "chrom", "pos", "mapq", "flag", "cigar", "qname", "mate_chrom", "mate_pos", "xs", "seq_len",
        )
        out = rows if out is None else out.unionByName(rows)
    return out
