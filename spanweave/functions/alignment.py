"""Column functions over alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<left:bigint,right:bigint>>"
#: SAM flag bits (fixed values of the format).
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY = 0x1, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80, 0x100


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def cigar_ops(cigar: Column) -> Column:
    """An array of ``n`` (bigint) and ``op``."""
    parts = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(
        parts,
        lambda p: F.struct(F.regexp_extract(p, r"^\d+", 0).cast("bigint").alias("n"), F.right(p, F.lit(1)).alias("op")),
    )


def segments(cigar: Column, left: Column, min_intron: int = 5) -> Column:
    """Aligned stretches as closed intervals from a 1-based left end.

    Matches and deletions extend a stretch, a skip ends it, and inserts, clips
    and pads take no room.  A stretch that begins less than ``min_intron``
    after the end of the one before joins it.
    """
    start = F.struct(left.cast("bigint").alias("at"), F.array().cast(SEGMENTS).alias("out"))

    def step(s: Column, o: Column) -> Column:
        end = s["at"] + o["n"] - 1
        last = F.element_at(s["out"], -1)
        joins = (F.size(s["out"]) > 0) & (s["at"] - F.get(s["out"], F.size(s["out"]) - 1)["right"] < min_intron)
        grown = F.concat(
            F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))),
            F.array(F.struct(last["left"].alias("left"), end.alias("right"))),
        )
        added = F.concat(s["out"], F.array(F.struct(s["at"].alias("left"), end.alias("right"))))
        out = F.when(o["op"].isin("M", "D", "=", "X"), F.when(joins, grown).otherwise(added)).otherwise(s["out"])
        at = F.when(o["op"].isin("M", "D", "=", "X", "N"), s["at"] + o["n"]).otherwise(s["at"])
        return F.struct(at.alias("at"), out.alias("out"))

    return F.aggregate(cigar_ops(cigar), start, step, lambda s: s["out"])


def introns(segs: Column) -> Column:
    """Gaps between following stretches, as closed intervals."""
    gaps = F.zip_with(
        F.slice(segs, 1, F.greatest(F.size(segs) - 1, F.lit(0))),
        F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0))),
        lambda a, b: F.struct((a["right"] + 1).alias("left"), (b["left"] - 1).alias("right")),
    )
    return F.when(F.size(segs) > 1, gaps).otherwise(F.array().cast(SEGMENTS))


def anchored_introns(segs: Column, min_anchor: int = 10) -> Column:
    """Introns whose outer stretches are long enough.

    A first or last stretch under ``min_anchor`` takes its intron with it.
    """
    size = lambda s: s["right"] - s["left"] + 1
    n = F.size(segs)
    short_first = size(F.get(segs, F.lit(0))) < min_anchor
    short_last = size(F.get(segs, n - 1)) < min_anchor
    keep = lambda x, i: ~((i == 0) & short_first) & ~((i == n - 2) & short_last)
    return F.filter(introns(segs), keep)


def strand_from_flags(flag: Column, library: str = "fr-firststrand") -> Column:
    """Strand of the transcript by library type; null if the flags can't tell.

    Of a pair in opposite directions, the second read of a first-strand
    library, or the first one of a second-strand library, runs along the
    transcript; in a library of equal directions both do (``ff``) or neither (``rr``).
    """
    reverse = has_flag(flag, REVERSE)
    second = has_flag(flag, PAIRED) & has_flag(flag, SECOND)
    if library == "fr-unstranded":
        return F.lit(None).cast("string")
    along = {"ff": ~reverse, "rr": reverse, "fr-firststrand": F.when(second, ~reverse).otherwise(reverse), "fr-secondstrand": F.when(second, reverse).otherwise(~reverse)}
    if library not in along:
        raise ValueError(f"unknown library type {library}")
    return F.when(along[library], "+").otherwise("-")


def vote(n: Column, total: Column, mode: str) -> Column:
    """Whether ``n`` of ``total`` samples carry a vote: all, high, low or single.

    High is 60 and low 30 percent, in whole percents.
    """
    percent = F.floor(n * 100 / total)
    return {"all": n == total, "high": percent >= 60, "low": percent >= 30, "single": n > 0}[mode]


def fpkm(mean: Column, read_length: Column, mapped: Column) -> Column:
    """Fragments per kilobase and million from mean base coverage."""
    return mean / (2 * read_length) / mapped * 1e9


def read_count(mean: Column, effective_length: Column, read_length: Column) -> Column:
    """Whole reads behind a mean coverage; at least one if there is any."""
    n = F.floor(mean * effective_length / (2 * read_length))
    return F.when(mean > 0, F.greatest(n, F.lit(1))).otherwise(n).cast("bigint")
