"""Ranked lexical search by dual trees (operator 13).

Items (queries) and documents are vectors over the items' terms: a term's weight
times its repeats in the item, and a term's share of a document's score.  Both get
a hierarchy whose nodes hold the largest value of each coordinate below them, so
that the product of two nodes' maxima bounds the score of every item below the one
with every document below the other.  From the tops down, a pair of nodes whose
bound is below the weakest kth score of the node's items is dropped with all that
lies below it; at the bottom documents are scored exactly.

Spark deals the documents: each task builds trees over blocks of its documents and
walks the items' tree against them.  A first walk scores only the most promising
leaf of each block and item, and yields kth scores that hold for the whole table;
the second walk prunes with these from its first block on.  Bounds and scores are
sums of integers below 2**53 in doubles, or 64-bit integers if they could be larger,
so nothing is lost by rounding.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize
from .divergence import words

#: Bytes of digits, letters and characters beyond ASCII, capitals lowered; a space for every other byte.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: (item, term) rows of one pass over the documents in expectation; more items take more passes.
PASS_TERMS = 250_000
#: Documents of a block and of a leaf, leaves of a document branch, items of the two kinds of item nodes.
BLOCK_DOCS, LEAF_DOCS, BRANCH = 4096, 32, 8
ITEM_NODES = (64, 8)
#: Cells of a block's table of leaf maxima; blocks over many terms are made smaller.
MOST_CELLS = 8_000_000


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item, item_id, terms``: a key for each row, its id, and its terms with repeats (binary)."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lower, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
    return materialize(
        items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), found.alias("terms")).where("size(terms) > 0")
    )


def document_vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """``doc_id, n, ids, tfs``: terms of each document that has any, and those of the vocabulary with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            lengths, ends, ids, tfs = [], [0], [], []
            for text in batch["text"]:
                n, found = 0, Counter()
                for part in words(text.as_py(), TERM_BYTES):
                    n += len(part)
                    found.update(map(known, part))
                found.pop(None, None)
                ids.extend(found)
                tfs.extend(found.values())
                lengths.append(n)
                ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.record_batch([batch["doc_id"], pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    taken = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return taken.mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<int>").where("n > 0")


@dataclass
class Items:
    """The items of a pass, in tree order: keys, and for each the ids and weights of its terms."""

    keys: list[int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]

    def node(self, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the node over ``size`` items, with the largest weight of each."""
        terms = np.concatenate(self.terms[first : first + size])
        ids, at = np.unique(terms, return_inverse=True)
        most = np.zeros(len(ids))
        np.maximum.at(most, at, np.concatenate(self.weights[first : first + size]))
        return ids, most


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def tree_of_items(rows: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int], df: np.ndarray, n_docs: int) -> Items:
    """Items ordered by their most frequent terms, so that neighbours share coordinates."""
    held = []
    for key, terms in rows:
        counts = Counter(vocabulary[t] for t in terms)
        ids = np.array(sorted(counts), np.int64)
        weights = np.array([counts[i] * term_weight(n_docs, int(df[i])) for i in ids], np.float64)
        often = sorted(counts, key=lambda i: (-df[i], i))[:4]
        held.append((often, key, ids, weights))
    held.sort(key=lambda x: x[:2])
    return Items([h[1] for h in held], [h[2] for h in held], [h[3] for h in held])


class Block:
    """Documents of a block in leaf order, with the maxima of leaves and branches."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, total: tuple[int, int]):
        n_docs, n_terms = total
        if int(n.max(initial=0)) * 75 * n_docs < 2**63:
            m = 25 + (75 * n * n_docs) // n_terms
        else:
            m = np.array([25 + (75 * int(x) * n_docs) // n_terms for x in n], np.int64)
        share = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        # leaves of documents that share their strongest frequent term and are about as long
        top = np.full(len(ids), -1, np.int64)
        by_doc = np.lexsort((term, -tf, doc))
        first = np.unique(doc[by_doc], return_index=True)
        top[first[0]] = term[by_doc][first[1]]
        order = np.lexsort((n, top))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.none = ids[order], none[order]
        self.terms, local = np.unique(term, return_inverse=True)
        by_place = np.argsort(place[doc], kind="stable")
        self.doc, self.local, self.share = place[doc][by_place], local[by_place], share[by_place].astype(np.float64)
        self.starts = np.searchsorted(self.doc, np.arange(len(ids) + 1))
        leaves = -(-len(ids) // LEAF_DOCS)
        self.leaf = np.zeros((leaves, len(self.terms)))
        np.maximum.at(self.leaf, (self.doc // LEAF_DOCS, self.local), self.share)
        self.branch = np.maximum.reduceat(self.leaf, np.arange(0, leaves, BRANCH), axis=0)

    def part(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms that the block has, and their weights."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        there = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        return at[there], weights[there]

    def scores(self, leaves: np.ndarray, weights: np.ndarray, exact: type) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the leaves' documents; ``weights`` has a value for each term of the block."""
        docs = (leaves[:, None] * LEAF_DOCS + np.arange(LEAF_DOCS)).ravel()
        docs = docs[docs < len(self.ids)]
        size = self.starts[docs + 1] - self.starts[docs]
        entry = np.repeat(self.starts[docs] - np.cumsum(size) + size, size) + np.arange(size.sum())
        part = weights[self.local[entry]].astype(exact) * self.share[entry].astype(exact)
        ends = np.concatenate([[0], np.cumsum(size)])
        sums = np.concatenate([[0], np.cumsum(part, dtype=exact)])
        return docs, (sums[ends[1:]] - sums[ends[:-1]]).astype(np.int64)


class Best:
    """The k best documents of each item: by score, then null ids last, then by id."""

    def __init__(self, items: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.rows: list[list[tuple[int, bool, int]]] = [[] for _ in range(items)]

    def weakest(self, item: int) -> int:
        """A score below this can't be among the item's k best."""
        held = self.rows[item]
        return max(int(self.floor[item]), -held[-1][0] if len(held) == self.k else 1)

    def add(self, item: int, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        good = np.nonzero(scores >= self.weakest(item))[0]
        if len(good):
            order = good[np.lexsort((ids[good], none[good], -scores[good]))][: self.k]
            new = [(-int(scores[i]), bool(none[i]), int(ids[i])) for i in order]
            self.rows[item] = sorted(self.rows[item] + new)[: self.k]


def walk(items: Items, block: Block, best: Best, nodes: list[tuple[np.ndarray, np.ndarray]], first_only: bool, exact: type) -> int:
    """Walk both trees; returns how many (item, document) pairs were scored.

    ``nodes`` are the item nodes over ``ITEM_NODES`` items, large ones first.
    """
    if not len(block.ids) or not len(block.terms):
        return 0
    large, small = ITEM_NODES
    count, scored = len(items.keys), 0
    n_large = -(-count // large)
    bound = lambda table, part: table[:, part[0]].astype(exact) @ part[1].astype(exact)
    for i in range(n_large):
        inside = range(i * large, min(count, (i + 1) * large))
        low = 1 if first_only else min(best.weakest(x) for x in inside)
        branches = np.nonzero(bound(block.branch, block.part(*nodes[i])) >= low)[0]
        if not len(branches):
            continue
        under = (branches[:, None] * BRANCH + np.arange(BRANCH)).ravel()
        under = under[under < len(block.leaf)]
        for j in range(inside.start // small, -(-inside.stop // small)):
            within = range(j * small, min(count, (j + 1) * small))
            low = 1 if first_only else min(best.weakest(x) for x in within)
            leaves = under[bound(block.leaf[under], block.part(*nodes[n_large + j])) >= low]
            if not len(leaves):
                continue
            for x in within:
                part = block.part(items.terms[x], items.weights[x])
                most = bound(block.leaf[leaves], part)
                weights = np.zeros(len(block.terms))
                weights[part[0]] = part[1]
                order = np.argsort(-most, kind="stable")
                at, step = 0, 1
                while at < len(order) and most[order[at]] >= best.weakest(x):
                    docs, scores = block.scores(leaves[order[at : at + step]], weights, exact)
                    best.add(x, scores, block.none[docs], block.ids[docs])
                    scored += len(docs)
                    if first_only:
                        break
                    at, step = at + step, 4
    return scored


def _blocks(batches: Iterator[pa.RecordBatch], total: tuple[int, int]) -> Iterator[Block]:
    for whole in batches:
        at = 0
        while at < len(whole):
            batch = whole.slice(at, BLOCK_DOCS)
            distinct = max(1, len(np.unique(batch["ids"].flatten().to_numpy())))
            fit = max(LEAF_DOCS, MOST_CELLS // distinct * LEAF_DOCS)
            batch = batch.slice(0, fit)
            at += len(batch)
            sizes = np.diff(batch["ids"].offsets.to_numpy())
            yield Block(
                batch["doc_id"].fill_null(0).to_numpy(),
                batch["doc_id"].is_null().to_numpy(zero_copy_only=False),
                batch["n"].to_numpy(),
                np.repeat(np.arange(len(batch)), sizes),
                batch["ids"].flatten().to_numpy().astype(np.int64),
                batch["tfs"].flatten().to_numpy().astype(np.int64),
                total,
            )


def searcher(items: Items, k: int, floor: np.ndarray, total: tuple[int, int], first_only: bool) -> Callable:
    """A function over batches of vectors that yields each item's best documents in them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = [items.node(i, size) for size in ITEM_NODES for i in range(0, len(items.keys), size)]
        top = sum(float(most.sum()) for _, most in nodes[: -(-len(items.keys) // ITEM_NODES[0])]) * 1e6
        exact = np.float64 if top < 2**53 else np.int64
        best = Best(len(items.keys), k, floor)
        for block in _blocks(batches, total):
            walk(items, block, best, nodes, first_only, exact)
        rows = [(key, None if none else doc, -score) for key, held in zip(items.keys, best.rows, strict=True) for score, none, doc in held]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item", "doc_id", "score"])

    return search


def _kth(found: DataFrame, items: Items, k: int) -> np.ndarray:
    """The kth score of each item among the rows found; 1 where there are fewer."""
    by = Window.partitionBy("item").orderBy(F.desc("score"))
    rows = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s"))
    held = {r["item"]: r["s"] for r in rows.where(F.col("c") == k).collect()}
    return np.array([held.get(key, 1) for key in items.keys], np.int64)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The k documents of the highest score above 0 for every row of ``items``: ``item_id, rank, doc_id, score``.

    Equal scores go by document id, null ids last.  Every row of ``docs`` is a
    document and every row of ``items`` an item, rows with equal ids too; null and
    empty texts have no terms, and an item without terms gives no rows.  Other
    columns are not read.  Items are dealt to passes so that the terms a task holds
    are bounded (``PASS_TERMS``); each pass reads the documents once.
    """
    asked = item_terms(items, item_id, item_text)
    passes = max(1, -(-int(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // PASS_TERMS))
    found = None
    for number in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number)
        rows = [(r["item"], [t.encode() for t in r["terms"]]) for r in mine.collect()]
        if rows:
            part = _one_pass(docs, rows, k, doc_id, text)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item long, doc_id long, score long")
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _one_pass(docs: DataFrame, rows: list[tuple[int, list[bytes]]], k: int, doc_id: str, text: str) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in rows for t in terms}))}
    vectors = materialize(document_vectors(docs, vocabulary, doc_id, text))
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect():
        df[r["id"]] = r["count"]
    items = tree_of_items(rows, vocabulary, df, n_docs)
    total = (n_docs, int(n_terms or 0))
    schema = "item long, doc_id long, score long"
    first = vectors.mapInArrow(searcher(items, k, np.ones(len(items.keys), np.int64), total, True), schema)
    floor = _kth(first, items, k)
    found = materialize(vectors.mapInArrow(searcher(items, k, floor, total, False), schema))
    drop_materialized(vectors)
    return found


RANK_SQL = """
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms, row_number() over () as id
  from documents),
i as (
  select item_id, row_number() over () as item, unnest(regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from benchmark),
m as materialized (select item, any_value(item_id) as item_id, term, count(*) as times from i group by item, term),
g as materialized (
  select count(*) filter (where len(terms) > 0) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from d),
t as materialized (
  select id, term, count(*) as tf from (select id, unnest(terms) as term from d)
  where term in (select term from m) group by id, term),
f as materialized (select term, count(*) as df from t group by term),
w as materialized (
  select f.term, cast(floor(1000 * ln((2 * g.n_docs + 2)::double / (2 * f.df + 1))) as bigint) as w from f, g),
l as materialized (select d.id, d.doc_id, 25 + (75 * len(d.terms) * g.n_docs) // g.n_terms as m from d, g where len(d.terms) > 0),
s as (
  select m.item, any_value(m.item_id) as item_id, l.id, any_value(l.doc_id) as doc_id,
         cast(sum(m.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * l.m))) as bigint) as score
  from m join t on m.term = t.term join w on w.term = t.term join l on l.id = t.id
  group by m.item, l.id)
select item_id, cast(rank as int) as rank, doc_id, score from (
  select *, row_number() over (partition by item order by score desc, doc_id nulls last) as rank from s where score > 0)
where rank <= 10
"""
