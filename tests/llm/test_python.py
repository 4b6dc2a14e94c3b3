"""Operators with Python in their tasks, against brute force, and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanweave.llm import html_extract, lm_score, queries, simhash, spm, topk

DIR = "/root/testdata/sf0.001"


def test_page_zones():
    page = """<!DOCTYPE html><html><head><title>t</title><style>x</style></head><body><nav><ul><li>Home</li></ul></nav>
    <div class="sidebar">side</div><article><header><h1>Big &amp; small&nbsp;things</h1></header><p>One <b>two
    three<br>four<p class="ad">buy<p>five &#33;</p><script>var a="</p>";</script><aside>z</aside>
    <section id=comments><p>nice</p></section><form>f</form></article><footer>&copy; x</footer></body>"""
    text = [t for z, t in html_extract.page_blocks(page) if z == "m"]
    assert text == ["Big & small things", "One two three four", "five !"]
    assert html_extract.page_blocks(None) == [] and html_extract.page_blocks("") == []
    assert html_extract.page_blocks("a < b &am c <b")[0][1] == "a < b &am c <b"


def test_article_names_and_unclosed_elements():
    text = lambda p: [t for z, t in html_extract.page_blocks(p) if z == "m"]
    assert text('<article><div class="post-header"><h1>Title</h1></div><p class="related work">Body</p></article>') == ["Title", "Body"]
    assert text("<article><p>One <button>Go<p>Two <noscript>three</article>") == ["One Go", "Two three"]
    assert text('<article><p>One</p><div class="related"><p>Other</p></div><p>Two</p><script>x</article>') == ["One", "Two"]


def test_page_ids_survive(spark):
    big = 2**53 + 1
    rows = [(None, "http://h/1", "<p>a b</p>"), (big, "http://h/2", "<p>c d</p>"), (big, "http://h/2", "<p>c d</p>"), (3, "http://h/3", "<p>" + "word " * 50_000 + "</p>")]
    got = sorted(((r.page_id or 0, r.n_chars) for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()))
    assert got == [(0, 3), (3, 249_999), (big, 3), (big, 3)]


def brute_support(pages, length):
    where = {}
    for k, p in enumerate(pages):
        for i in range(len(p) - length + 1):
            where.setdefault(tuple(p[i : i + length]), set()).add(k)
    out = []
    for p in pages:
        best = [0] * len(p)
        for i in range(len(p) - length + 1):
            for j in range(i, i + length):
                best[j] = max(best[j], len(where[tuple(p[i : i + length])]))
        out.append(best)
    return out


@pytest.mark.parametrize("length", [1, 2, 3, 5, 7])
def test_repeats_by_suffix_array(length):
    random.seed(length)
    pages = [[random.randrange(4) for _ in range(random.randrange(30))] for _ in range(6)]
    tokens, of, end = [], [], 100
    for k, p in enumerate(pages):
        tokens += [*p, end + k]
        of += [k] * (len(p) + 1)
    got = html_extract.repeated(np.array(tokens), np.array(of), length)
    at = 0
    for p, want in zip(pages, brute_support(pages, length)):
        assert got[at : at + len(p)].tolist() == want
        at += len(p) + 1


def test_boilerplate_without_marks(spark):
    notice = "this very long notice about nothing at all stands on each and every page of the site"
    rows = [(i, "http://h.example/%d" % i, f"<div>{notice}</div><p>unique text number {i} is here to stay</p>") for i in range(5)]
    rows += [(9, None, None), (10, "http://x/", ""), (11, "http://h.example/11", "<div>" + "w%d " * 3 + "</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    assert all(got[i] == f"unique text number {i} is here to stay" for i in range(5))
    assert got[9] == "" and got[10] == ""
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_article_text_on_table(spark):
    import html
    import re

    got = {r.page_id: r for r in queries.op1_host_suffix_text(spark, DIR).collect()}
    for r in spark.read.parquet(f"{DIR}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_sentencepiece_gives_results_out_in_parts(monkeypatch):
    import pandas as pd

    with open(queries.tokenizer_path(), "rb") as f:
        model = spm.PieceModel(f.read())
    monkeypatch.setattr(spm, "HELD_CHARS", 1000)
    texts = ["some words " * (i % 90) for i in range(50)] + [None]
    parts = list(spm._coded_frames(model, pd.Series(texts), ["n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]))
    assert max(len(p) for p in parts) < 20 and sum(map(len, parts)) == 51
    assert [len(i) for p in parts for i in p["token_ids"]] == [len(model.encode(t or "")) for t in texts]


def test_lm_score(spark):
    good = ["the cat sat on the mat and the dog ran to the house"] * 20
    bad = ["lorem ipsum dolor sit amet consectetur adipiscing elit sed do"] * 60
    rows = [(i, t, i < 20) for i, t in enumerate(good + bad)] + [(100, None, None), (101, "", False), (102, " \n", True), (103, "the cat " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean").withColumn("fold", lm_score.fold_of("doc_id"))
    model = lm_score.fit(docs)
    got = {r.doc_id: r for r in lm_score.score(docs.withColumn("score", F.lit(1)), model).collect()}
    assert max(got[i].score for i in range(20)) < min(got[i].score for i in range(20, 80))
    assert got[100].score is None and got[101].n_tokens == 0 and got[102].target_loss is None and got[103].n_tokens == 40000
    assert lm_score.score(docs.limit(0), lm_score.fit(docs.limit(0))).count() == 0


def test_lm_pairs_are_exact(spark):
    import collections

    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("text", (F.col("doc_id") % 3 == 0).alias("is_target"), lm_score.fold_of("doc_id").alias("fold"))
    model = lm_score.fit(docs, min_count=1)
    base, want = model["unknown"] + 2, collections.Counter()
    folds = set()
    for r in docs.collect():
        ids = [base - 1] + [model["place"][w] for w in (r.text or "").lower().split()]
        folds.update((r.fold, a * base + b) for a, b in zip(ids, ids[1:]))
        want.update((f"{kind}{r.fold}", a * base + b) for a, b in zip(ids, ids[1:]) for kind in ("n", "t")[: 1 + bool(r.is_target)])
    for c in lm_score.COUNTS:
        got = {(c, p): n for p, n in zip(model["pair"].tolist(), model[c]["pair"].tolist()) if n}
        # those that a document of the other fold can ask for
        assert got == {k: n for k, n in want.items() if k[0] == c and {(0, k[1]), (1, k[1])} <= folds}


@pytest.mark.parametrize("sizes", [{"max_words": 30}, {"max_pairs": 20}, {"max_words": 40, "max_pairs": 0}, {"max_words": 0}])
def test_lm_losses_do_not_depend_on_what_workers_hold(spark, sizes):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{min(rng.randrange(1, 400) for _ in range(3))}" for _ in range(rng.randrange(60))), i % 3 == 0) for i in range(120)]
    rows += [(None, None, None), (7, "", True), (7, "w1 w2 w1 w2 strange w1", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean").withColumn("fold", lm_score.fold_of("doc_id"))
    got = [
        sorted(map(tuple, lm_score.score(docs, lm_score.fit(docs, **s)).select("doc_id", "text", "n_tokens", "target_loss", "background_loss").collect()), key=str)
        for s in ({}, sizes)
    ]
    assert [r[:3] for r in got[0]] == [r[:3] for r in got[1]] and len(got[0]) == len(rows)
    for a, b in zip(*got):
        assert a[3:] == pytest.approx(b[3:], abs=1e-6)


def test_lm_words_that_no_table_has_are_unknown(spark):
    kept, gone = lm_score._far_id("kept"), lm_score._far_id("gone")
    rows = spark.createDataFrame([(kept, 1, 10), (gone, 1, 20), (1, gone, 30), (kept, gone, 40), (2, kept, 50)], "a long, b long, n long")
    got = lm_score._resolved(rows, spark.createDataFrame([(kept,)], "id long"), 5)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [(kept, 1, 10), (5, 1, 20), (1, 5, 30), (kept, 5, 40), (2, kept, 50)]
    bits = lm_score._bit_table(rows, "a", "b")
    one, two = np.array([1, 2, 2]), np.array([gone, kept, 1])
    assert lm_score._may_have(bits, one, two).tolist() == [True, True, False] and sum(bin(x).count("1") for x in bits) == 5


def test_top_k_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    want = sorted(con.sql(topk.TOP_K_SQL).fetchall())
    v = topk.integer_vectors(spark.read.parquet(f"{DIR}/embeddings.parquet"))
    got = topk.top_k(v, v.where("vec_id % 50 = 0"), block_rows=16, lane_blocks=3, chunk=3)
    assert sorted(map(tuple, got.collect())) == want


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, []), (50, [-1.0, 0.25])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")))
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 50 = 0")).collect()))
    assert [r[:3] for r in got if r[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 50)]
    assert [r[2] for r in got if r[0] == 50] == [0, 1, 2]
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_top_k_sends_a_few_chunks_at_a_time(spark, monkeypatch):
    """Neither table is copied for each part of the other, and lists are carried from lane to lane and merged between tasks."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-9, 9)) for _ in range(4)]) for i in range(400)]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), scale=1).repartition(3)
    written, write = [], topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda df: written.append((df, write(df))) or written[-1][1])
    monkeypatch.setattr(topk, "SENT_NUMBERS", 3 * 2 * 4)
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id % 20 = 0"), block_rows=16, lane_blocks=2, chunk=3).collect()))
    scored = lambda q: sorted((-sum(a * b for a, b in zip(rows[q][1], x, strict=True)), i) for i, x in rows if i != q)[:5]
    assert got == [(q, n + 1, i, int(-s)) for q in range(0, 400, 20) for n, (s, i) in enumerate(scored(q))]
    assert sum(df.count() for _, df in written[:2]) < 40 and len(written) == 2 + 4
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df, _ in written]
    assert not any("explode" in p for p in plans)


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = queries.tokenizer_path()
    with open(path, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_file=path), spm.PieceModel(f.read())


def test_encoding_equals_library(pieces):
    library, model = pieces
    random.seed(1)
    alphabet = "abcdefthe THE  \t\n▁ éßñ日本语ＡAKIA0123456789_-=/\x00�😀"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randrange(80))) for _ in range(1500)]
    texts += [" " * i + "x" + " " * j for i in range(0, 40, 3) for j in range(0, 40, 5)] + [w * k for w in ("a", "the", "ab", "!", "\n", "日") for k in range(1, 60, 4)]
    for t in texts:
        ids = library.encode(t)
        assert model.encode(t) == ids, t
        assert model.decode(ids) == library.decode(ids), t


def test_encoding_column(spark, pieces):
    library, _ = pieces
    rows = [(1, None), (2, ""), (3, " "), (4, "Hello  world"), (4, "Hello  world"), (5, "wörter " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    for r in spm.encode_decode(docs, queries.tokenizer_path(), with_ids=True).collect():
        ids = library.encode(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert spm.encode_decode(docs.limit(0), queries.tokenizer_path()).count() == 0


def slow_fingerprint(text):
    import xxhash

    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_on_table(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect())
    prints = [slow_fingerprint(t) for _, t in docs]
    roots = slow_components(prints)
    want = sorted((i, f"{p:016x}", docs[r][0]) for (i, _), p, r in zip(docs, prints, roots))
    assert sorted(map(tuple, queries.op10_simhash(spark, DIR).collect())) == want


def test_near_links_in_chunks(spark):
    """Dense balls of fingerprints: every linked pair is found, also over chunks."""
    random.seed(9)
    centres = [random.getrandbits(64) for _ in range(4)]
    prints = list({c ^ sum(1 << b for b in random.sample(range(64), random.randrange(7))) for c in centres for _ in range(150)})
    roots = slow_components(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    from spanweave.llm.common import connected_components

    for chunk in (7, 20_000):
        found = {r.node: r.root for r in connected_components(simhash.near_links(df, chunk=chunk)).collect()}
        groups = [found.get(s, s) for s in signed]
        assert len(set(zip(groups, roots))) == len(set(roots)) == len(set(groups))


def test_simhash_edges(spark):
    rows = [(3, None), (1, ""), (2, " \t"), (5, "a b"), (5, "a b"), (6, "x " * 30000), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert len(got) == 7 and {r[2] for r in got if r[0] in (1, 2, 3)} == {1}
    assert {r[2] for r in got if r[0] == 5} == {5} and {r[2] for r in got if r[0] is None} == {5}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from spanweave.llm import quality

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = pipeline.materialize(stage(spark, docs, DIR))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert out.where("n_chars <> length(text)").count() == 0
        seen.append((docs, docs := out))
    (raw, kept), (_, lines), (_, single), (_, mixed), (texts, coded) = seen
    verdict = {r.doc_id: r.kept for r in quality.clean_lines(raw).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in verdict.items() if k}
    rows = sorted((r.doc_id, r.text) for r in lines.collect())
    roots = slow_components([slow_fingerprint(t) for _, t in rows])
    assert sorted(r.doc_id for r in single.collect()) == sorted(rows[r][0] for r in set(roots))
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    assert coded.count() == texts.count() and coded.where("n_tokens <> size(token_ids)").count() == 0


def test_pipeline_survives_nulls(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = "This is a sentence with a handful of words, one of many. " * 3
    rows = [(1, " ".join(f"{text}{i}." for i in range(9)), None, None, None), (2, None, "en", "a", 0), (None, text * 9, None, "a", None), (3, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    pipeline.run(spark, str(tmp_path)).collect()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "e/documents.parquet"))
    assert pipeline.run(spark, str(tmp_path / "e")).count() == 0


def test_null_and_repeated_ids_keep_their_texts(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    one, two, three, four = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(4))
    rows = [(None, one), (None, two), (5, two), (7, three), (7, four), (8, four), (8, four)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.orderBy(F.desc("text")).coalesce(1)):
        single = pipeline.materialize(pipeline.near_dedup(spark, table, ""))
        assert single.columns == docs.columns
        assert sorted((r.doc_id or 0, r.text) for r in single.collect()) == sorted([(0, one), (5, two), (7, three), (7, four)])
    # half as many words again as there are: each text once, and of rows with one id each its own
    mixed = [(r.doc_id, r.text) for r in pipeline.source_mix(spark, single, "").collect()]
    assert {(None, one), (5, two), (7, three), (7, four)} <= set(mixed) and len(mixed) <= 8
    assert abs(sum(len(t.split()) for _, t in mixed) - 360) <= 32
