"""One query for each training-data operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compress_class, divergence, dual_tree, html_extract, line_dedup, lm_score, mixing, quality, reshard, secret_scan, simhash, spm, topk
from .common import MOST_ROWS, materialize, sized


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_host_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op2_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 old shards, by id, to 40 of equal bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(32)).cast("int").alias("old_shard"),
    )
    return reshard.reshard(rows, 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def op3_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_lines(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its remaining text and how many lines went."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_apportioned_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    kinds = [secret_scan.count_kind(F.col("base"), k).alias(f"n_{name}") for k, (name, *_) in enumerate(secret_scan.BASE)]
    return found.select(
        "doc_id", *kinds, F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("all_spans")).alias("spans"),
    )


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what the labels call good; the background is every document."""
    good = materialize(table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct())
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", lm_score.fold_of("doc_id").alias("fold"))
    few = good.count() <= MOST_ROWS
    marked = docs.join(sized(good).withColumn("is_target", F.lit(True)), "doc_id", "left")
    model = lm_score.fit(marked if few else materialize(marked))  # a join that shuffles the texts runs once
    return lm_score.score(docs, model, keep=["doc_id"])


def op8_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spm.encode_decode(docs, tokenizer_path()).drop("text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = compress_class.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(compress_class.fold_of() == 1, F.lit(False)).alias("held_out")
    return compress_class.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_suffix_text": op1_host_suffix_text,
    "op2_resharding": op2_resharding,
    "op3_line_first_cleaning": op3_line_first_cleaning,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_apportioned_mix": op5_apportioned_mix,
    "op6_markov_secrets": op6_markov_secrets,
    "op7_cross_entropy_difference": op7_cross_entropy_difference,
    "op8_block_top_k": op8_block_top_k,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_simhash": op10_simhash,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_compression_quality": op12_compression_quality,
    "op13_dual_tree_search": op13_dual_tree_search,
}

ORACLE_SQL: dict[str, str] = {
    "op5_apportioned_mix": mixing.MIX_SQL,
    "op8_block_top_k": topk.TOP_K_SQL,
    "op11_divergence_audit": divergence.AUDIT_SQL,
    "op13_dual_tree_search": dual_tree.RANK_SQL,
}
