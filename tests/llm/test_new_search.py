"""Divergence audit, compression classifier and dual-tree search against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanweave.llm import compress_class, divergence, dual_tree

LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", Counter(LETTER.findall((text or "").translate(UPPER)))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = [t for t in {t for d in mine for t in d[2]} if sum(t in d[2] for d in mine) >= least]
        groups = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, terms in mine:
            groups[s].update({t: terms[t] for t in kept if t in terms})
        every = sum(groups.values(), Counter())

        def p(counts, t, v=len(kept)):
            return 1 + 10**9 * (counts[t] + 1) // (sum(counts.values()) + v)

        def f(p, q):
            return (p - q) ** 2 // q

        for s, c in groups.items():
            pairs = [(-sum(f(p(c, t), p(groups[o], t)) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-f(p(c, t), p(every, t)), t.encode(), t) for t in kept if c[t] and p(c, t) > p(every, t)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


def corpus(rng, n=120):
    words = [f"w{chr(97 + i)}{'é' * (i % 3)}" for i in range(26)] + ["The", "THE", "日本", "x1y", "Σ"]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "ü", None, ""]), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(n)]
    return [*rows, ("zz", "lone", None), ("zz", "other", "one two"), ("yy", "only", "same same"), rows[0], rows[0], ("en", "a", "the " * 5000)]


def audit_rows(df):
    return {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()}


def test_audit_against_brute_force(spark):
    rows = corpus(random.Random(2))
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "lang string, source string, text string, n long, term string")
    assert audit_rows(divergence.audit(df)) == brute_audit(rows)
    assert audit_rows(divergence.audit(df, least_docs=1, top_terms=2)) == brute_audit(rows, 1, 2)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


@pytest.mark.parametrize("columns, cells", [(1024, 8_000_000), (4, 8_000_000), (1024, 40), (2, 4)])
def test_products_do_not_depend_on_blocks(monkeypatch, columns, cells):
    monkeypatch.setattr(divergence, "MOST_COLUMNS", columns)
    monkeypatch.setattr(divergence, "MOST_CELLS", cells)
    rng = random.Random(1)
    group = np.sort(np.array([rng.randint(0, 4) for _ in range(15)]))
    ones = sorted({(r, c) for r in range(40) for c in rng.sample(range(15), 4)})
    a, b, n = divergence.one_hot_product(np.array([r for r, _ in ones]), np.array([c for _, c in ones]), group)
    found = dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True))
    want = Counter((c, d) for r, c in ones for s, d in ones if r == s and group[c] < group[d])
    assert found == dict(want)


def test_counts_are_sent_on_in_parts(spark, monkeypatch):
    rows = corpus(random.Random(4), 60)
    monkeypatch.setattr(divergence, "SLICE", 16)
    batches = [list(divergence.words(t.encode() if t else None)) for _, _, t in rows]
    assert [[w.decode() for part in b for w in part] for b in batches] == [LETTER.findall((t or "").translate(UPPER)) for _, _, t in rows]


def brute_ranking(docs, items, k=10):
    terms = [(i, TERM.findall((t or "").translate(UPPER))) for i, t in docs]
    held = [(i, Counter(t), len(t)) for i, t in terms if t]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        rows = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in TERM.findall((text or "").translate(UPPER))
            )
            if score > 0:
                rows.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


def ranked(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def search_tables(rng, n=300):
    common, rare = ["the", "of", "And", "é", "2024"], [f"r{i}" for i in range(150)]
    text = lambda k: " ".join(rng.choices(common, k=k) + rng.choices(rare, k=k // 2))
    docs = [(i, text(rng.randint(0, 40))) for i in range(n)] + [(None, text(20)), (7, text(20)), (901, None), (902, ""), (903, "the " * 30_000)]
    docs += [(1000 + i, "r1 r2 r3 the end") for i in range(30)]  # ties beyond k
    items = [(i, text(rng.randint(1, 12))) for i in range(90)] + [(200, "r1 r2 r3 r3"), (201, None), (202, "unseen"), (203, "!"), (None, "r5 the"), (5, "r9 r9")]
    return docs, items


def test_ranking_against_brute_force(spark, monkeypatch):
    docs, items = search_tables(random.Random(8))
    monkeypatch.setattr(dual_tree, "BLOCK_DOCS", 100)
    monkeypatch.setattr(dual_tree, "LEAF_DOCS", 4)
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n long").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute_ranking(docs, items)
    assert ranked(dual_tree.rank_documents(d, q)) == want
    monkeypatch.setattr(dual_tree, "PASS_TERMS", 200)  # several passes
    assert ranked(dual_tree.rank_documents(d, q)) == want


def test_ranking_of_empty_tables(spark):
    docs, items = search_tables(random.Random(1), 5)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dual_tree.rank_documents(d.where("false"), q).collect() == []
    assert dual_tree.rank_documents(d, q.where("false")).collect() == []


def block_of(rows, vocabulary, total):
    doc, term, tf, n = [], [], [], []
    for i, text in enumerate(rows):
        found = Counter(text.split())
        n.append(sum(found.values()))
        for t, c in found.items():
            doc.append(i), term.append(vocabulary[t]), tf.append(c)
    ids = np.arange(len(rows))
    return dual_tree.Block(ids, np.zeros(len(rows), bool), np.array(n), np.array(doc), np.array(term), np.array(tf), total)


@pytest.mark.parametrize("exact", [np.float64, np.int64])
def test_walk_prunes_and_stays_exact(exact):
    rng = random.Random(6)
    words = [f"t{i}" for i in range(400)]
    rows = [" ".join(rng.choices(words[40 * (i % 10) : 40 * (i % 10) + 40], k=30)) for i in range(2000)]
    vocabulary = {w: i for i, w in enumerate(words)}
    df = np.array([sum(w in r.split() for r in rows[:200]) * 10 for w in words])
    total = (len(rows), 30 * len(rows))
    items = dual_tree.tree_of_items([(i, [w.encode() for w in rng.sample(words[40 * (i % 10) : 40 * (i % 10) + 40], 5)]) for i in range(80)], {w.encode(): i for w, i in vocabulary.items()}, df, len(rows))
    block = block_of(rows, vocabulary, total)
    nodes = [items.node(i, size) for size in dual_tree.ITEM_NODES for i in range(0, len(items.keys), size)]
    best = dual_tree.Best(80, 10, np.ones(80, np.int64))
    scored = dual_tree.walk(items, block, best, nodes, False, exact)
    assert scored < 0.3 * 80 * len(rows)  # most pairs are never scored
    full = np.zeros((80, len(rows)), np.int64)
    for x in range(80):
        at, w = block.part(items.terms[x], items.weights[x])
        weights = np.zeros(len(block.terms))
        weights[at] = w
        places, scores = block.scores(np.arange(len(block.leaf)), weights, exact)
        full[x, block.ids[places]] = scores
    for x in range(80):
        want = sorted((-int(s), i) for i, s in enumerate(full[x]) if s > 0)[:10]
        assert [(s, i) for s, _, i in best.rows[x]] == want


def test_node_maxima_bound_what_lies_below():
    items = dual_tree.Items([1, 2], [np.array([1, 3]), np.array([3, 5])], [np.array([2.0, 7.0]), np.array([9.0, 1.0])])
    ids, most = items.node(0, 8)
    assert dict(zip(ids.tolist(), most.tolist(), strict=True)) == {1: 2.0, 3: 9.0, 5: 1.0}


def labelled(spark, n=900):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["the", "house", "river", "walks", "slowly", "through", "meadow", "and"]) for _ in range(rng.randint(20, 400)))
    bad = lambda: " ".join(rng.choice(["BUY", "NOW", "$$$", "click!!", "FREE", "###", "winner"]) for _ in range(rng.randint(20, 400)))
    kinds = [rng.random() < 0.7 for _ in range(n)]
    docs = [(i, good() if k else bad(), "s") for i, k in enumerate(kinds)]
    labels = [(i, int(k), 0) for i, k in enumerate(kinds) if i % 5]
    docs += [(n, None, None), (n + 1, "", "s"), (None, good(), "s"), (0, docs[0][1], "s"), (n + 2, "long words " * 100_000, "s")]
    labels += [(None, 1, 0), (n, 0, 0), (3, 2, 0), (4, None, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict(enumerate(kinds))


def test_classifier_on_held_out_rows(spark):
    docs, labels, kinds = labelled(spark)
    out = compress_class.score(docs, compress_class.train(docs, labels)).collect()
    assert len(out) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["doc_id"] in kinds and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["predicted"] == kinds[r["doc_id"]] for r in held) / len(held) > 0.98
    assert {r["_score"] for r in out} == {"s", None}  # a column that was there before
    assert len({r["score"] for r in out if not r["text"]}) == 1
    assert len({r["score"] for r in out if r["doc_id"] == 0}) == 1


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = labelled(spark, 300)
    flipped = labels.withColumn("quality", (compress_class.fold_of() == 1).cast("int") * (1 - labels.quality) + (compress_class.fold_of() != 1).cast("int") * labels.quality)
    assert compress_class.train(docs, flipped) == compress_class.train(docs, labels)


def test_without_labels_the_score_is_constant(spark):
    docs, labels, _ = labelled(spark, 60)
    for given, score in ((labels.where("false"), 0.5), (labels.where("quality = 1"), None)):
        model = compress_class.train(docs, given)
        scores = {r["score"] for r in compress_class.score(docs, model).collect()}
        assert len(scores) == 1 and (score is None or scores == {score})
    assert compress_class.score(docs.where("false"), model).collect() == []


def test_differences_use_the_whole_text():
    good, bad = (compress_class.train_dictionary([w * 40 for _ in range(200)]) for w in (b"meadow river ", b"CLICK NOW ### "))
    head = b"meadow river " * 200
    more = compress_class.differences([head, head + b"CLICK NOW ### " * 2000], good, bad)
    assert more[0] > 0 > more[1]
