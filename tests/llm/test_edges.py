"""Names that clash, long runs and repetitive texts."""

import random

from pyspark.sql import functions as F

from spanweave.llm import line_dedup, mixing, quality, queries, reshard, spm

from .test_native import WORD, brute_lines, expected_counts, frame


def test_internal_names_are_free(spark):
    names = ["_lines", "_filled", "_words", "_grams", "_FILLED_"]
    docs = frame(spark, ["a b c a b c a b c", None, "One line.\nOne line."])
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), "doc_id"))
    for r in quality.clean_lines(docs).collect():
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected_counts(r.text)


def test_reshard_keeps_all_columns(spark):
    names = ["_old", "_class", "_salt", "_base", "_at", "_nth", "_first", "_bytes", "_n", "_cuts", "_rows"]
    rows = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 16).alias("size"), (F.col("id") % 3 - 1).cast("int").alias("old_shard"), F.lit("x").alias("slot"))
    rows = rows.withColumn("old_shard", F.when(F.col("doc_id") % 11 != 0, F.col("old_shard")))
    plain = {r.doc_id: (r.shard, r.slot) for r in reshard.reshard(rows, 5).collect()}
    for n in names:
        rows = rows.withColumn(n, F.concat(F.lit(n), "doc_id"))
    got = reshard.reshard(rows, 5)
    assert set(got.columns) == {*rows.columns, "shard", "slot"}
    for r in got.collect():
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
        assert (r.shard, r.slot) == plain[r.doc_id]
    assert len(plain) == 200
    # rows without an old shard aren't those of a shard called -1
    one = spark.createDataFrame([(i, 10, None if i < 5 else -1) for i in range(10)], "doc_id long, size long, old_shard int")
    stay = {r.doc_id: r.shard for r in reshard.reshard(one, 2, capacities={-1: 50, 0: 50}).collect()}
    assert all(stay[i] == -1 for i in range(5, 10)) and all(stay[i] == 0 for i in range(5))


def test_mixed_texts_keep_clashing_columns(spark):
    docs = frame(spark, [f"w{i} " * (3 + i) for i in range(12)])
    names = ["_row", "_text", "_size", "_whole", "_part", "size", "whole", "part"]
    for n in names:
        docs = docs.withColumn(n, F.concat(F.lit(n), "doc_id"))
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all([r[n] for n in names] == [f"{n}{r.doc_id}" for n in names] for r in rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    for i, n in taken.items():
        assert sum(len(WORD.findall(r.text)) for r in rows if r.doc_id == i) == n


def test_lines_of_few_shingles(spark):
    """Rulers and repeats of 128 characters and more have signatures and meet their likes."""
    kinds = ["-", "=", "_", ".", "~", "ab", "- ", "=-", "*", "#", "+-", "abc"]
    docs = [(i, "\n".join((kind * 150)[:n] for n in (140, 142, 144))) for i, kind in enumerate(kinds)]
    docs.append((len(kinds), "=-" * 80 + "\n" + "=-" * 80 + "="))
    lines = [(i, x) for i, x in enumerate(x for _, t in docs for x in t.split("\n"))]
    signed = line_dedup.signatures(spark.createDataFrame(lines, "id long, line string"))
    assert {r.id for r in signed.select("id").collect()} == {i for i, _ in lines}
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == brute_lines(docs)


def test_long_runs_encode_in_linear_time():
    import time

    import sentencepiece

    path = queries.tokenizer_path()
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), spm._model(open(path, "rb").read())
    rng = random.Random(4)
    spent = {}
    for n in (20_000, 200_000):
        text = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
        began = time.process_time()
        ids = model.encode(text)
        spent[n] = time.process_time() - began
        assert ids == library.encode(text)
    assert spent[200_000] < 40 * spent[20_000]


def test_near_dedup_keeps_clashing_columns(spark):
    import pytest

    pipeline = pytest.importorskip("corpus_pipeline")
    docs = frame(spark, ["one two three four five six", "one two three four five six", "another text of some words", None])
    docs = docs.withColumn("_key", F.concat(F.lit("k"), "doc_id")).withColumn("fingerprint", F.lit("f"))
    out = pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r._key) for r in out.collect()) == [(0, "k0"), (2, "k2"), (3, "k3")]


def test_main_text_does_not_depend_on_the_segments_of_a_host(spark):
    import random

    from spanweave.llm import html_extract

    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    twice = [words(20) for _ in range(10)]
    often = words(15)
    rows = []
    for i in range(40):
        body = f"<p>{words(30)}</p><p>{twice[i % 10] if i < 20 else words(9)}</p>" + (f"<p>{often}</p>" if i % 4 else "")
        if i % 3 == 0:
            body = f"<p>menu {words(5)}</p><article>{body}</article>"
        rows.append((i, f"http://{'a' if i % 5 else 'b'}.example.com/{i}", f"<html><body>{body}</body></html>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = [
        sorted(map(tuple, html_extract.main_text(pages, least_pages=8, segment_chars=size).collect())) for size in (6_000_000, 5_000, 600)
    ]
    assert found[0] == found[1] == found[2]
    assert not any(t in r[2] for r in found[0] for t in twice if r[0] % 3)  # stands on two unmarked pages, or beside a marked one
