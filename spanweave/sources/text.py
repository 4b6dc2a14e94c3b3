"""Readers and writers of the line formats: SAM, GTF and GFF3, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sam(spark: SparkSession, paths: str | list[str], pool: int = 1) -> DataFrame:
    """SAM lines as records; input i belongs to sample i div ``pool``.

    Header lines and lines with fewer than 11 fields are left out.
    """
    out = None
    for no, path in enumerate([paths] if isinstance(paths, str) else paths):
        f = F.split("value", "\t")
        xs = F.regexp_extract("value", r"\tXS:A:([+-])", 1)
        rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(f) >= 11)).select(
            F.xxhash64(F.lit(no), "value").alias("read_id"),
            F.lit(no // pool).alias("sample_id"),
            F.lit(no).alias("input_no"),
            f[2].alias("chrom"),
            f[3].cast("bigint").alias("pos"),
            f[4].cast("int").alias("mapq"),
            f[1].cast("int").alias("flag"),
            F.when(f[5] != "*", f[5]).alias("cigar"),
            f[0].alias("qname"),
            F.when(f[6] == "=", f[2]).otherwise(F.when(f[6] != "*", f[6])).alias("mate_chrom"),
            f[7].cast("bigint").alias("mate_pos"),
            F.when(xs != "", xs).alias("xs"),
            F.when(f[9] == "*", 0).otherwise(F.length(f[9])).alias("seq_len"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def sam_chromosomes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct sequence names over all headers."""
    rows = spark.read.text(paths).where(F.col("value").startswith("@SQ"))
    return rows.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom")).distinct()


def attribute(text: Column, name: str) -> Column:
    """A GTF or GFF3 attribute without separator and quotes; null if absent."""
    parts = F.transform(F.split(text, ";"), lambda p: F.trim(p))
    own = F.filter(parts, lambda p: p.startswith(name + " ") | p.startswith(name + "="))
    value = F.trim(F.regexp_replace(F.substring(F.get(own, F.lit(0)), len(name) + 2, 1 << 20), '"', ""))
    return F.when(F.size(own) > 0, value)


def gtf_exons(lines: DataFrame) -> DataFrame:
    """``chrom, strand, gene_id, transcript_id, start, end`` of exon lines.

    ``lines`` has ``value``.  Comments and lines of fewer than nine fields are
    left out, reversed ends are swapped.  GFF3 names its transcript in Parent
    (several of them, by commas) and has no gene.
    """
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(f) >= 9)).where(f[2] == "exon")
    a, b = f[3].cast("bigint"), f[4].cast("bigint")
    names = F.coalesce(attribute(f[8], "transcript_id"), attribute(f[8], "Parent"))
    return rows.select(
        f[0].alias("chrom"), f[6].alias("strand"), attribute(f[8], "gene_id").alias("gene_id"),
        F.explode(F.split(names, ",")).alias("transcript_id"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"),
    )


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return gtf_exons(spark.read.text(path))


def guide_transcripts(exons: DataFrame) -> DataFrame:
    """One row per transcript with its span and sorted exons."""
    return exons.groupBy("chrom", "strand", "transcript_id").agg(
        F.min("gene_id").alias("gene_id"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("exons"),
    )


def gtf_lines(transcripts: DataFrame, source: str = "spanweave") -> DataFrame:
    """GTF lines in order: each transcript, then its exons.

    ``transcripts`` has ``chrom, strand, gene_id, transcript_id, fpkm, cov,
    exons``.  Returns ``sort`` columns and ``value``.
    """
    names = F.format_string('gene_id "%s"; transcript_id "%s";', "gene_id", "transcript_id")
    numbers = F.format_string(' FPKM "%.6f"; cov "%.6f";', F.col("fpkm").cast("double"), F.col("cov").cast("double"))
    whole = F.struct(F.lit("transcript").alias("kind"), F.get("exons", F.lit(0))["start"].alias("s"), F.element_at("exons", -1)["end"].alias("e"), F.concat(names, numbers).alias("t"))
    parts = F.transform("exons", lambda x: F.struct(F.lit("exon").alias("kind"), x["start"].alias("s"), x["end"].alias("e"), names.alias("t")))
    rows = transcripts.select("chrom", "strand", "transcript_id", F.get("exons", F.lit(0))["start"].alias("first"), F.posexplode(F.concat(F.array(whole), parts)).alias("line_no", "_x"))
    line = F.concat_ws("\t", "chrom", F.lit(source), "_x.kind", F.col("_x.s").cast("string"), F.col("_x.e").cast("string"), F.lit("."), "strand", F.lit("."), "_x.t")
    return rows.select("chrom", "first", "transcript_id", "line_no", line.alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Sorted part files that read in name order as one file."""
    lines.orderBy("chrom", "first", "transcript_id", "line_no").select("value").write.mode("overwrite").text(path)


def write_matrix(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
