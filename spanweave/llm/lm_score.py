"""Cross-entropy difference scoring (operator 7).

A target model and a background model, both interpolated word bigrams over one
shared vocabulary, score each document: the difference of their losses per
token says how much more the document resembles the target than the corpus.

The models are matched: same order, smoothing, vocabulary and folds.  Documents
fall into two folds by the hash of their id, and each is scored by the models of
the other fold, so that no model has seen the document it scores.

All counts cover all documents.  Words and pairs are counted per task and
summed by shuffles.  What workers hold for scoring is of a fixed size: the
``max_words`` most frequent words and the ``max_pairs`` most frequent pairs of
them (the lowest count that fits decides, so ties stay or go together).  All other
words and pairs stay in written tables: a worker gives out the pairs that it
doesn't know, a join finds their losses, and these are added up by document.  So
the two sizes decide where a loss is found and not what it is.  A word that
workers don't hold goes by 61 bits of its hash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, sized, unused

#: Weight of the single-word model, in pairs seen after a word.
BACK = 4.0
#: What each single word counts besides its occurrences.
FLAT = 0.5
#: Words below this count are the unknown word.
MIN_COUNT = 3
COUNTS = ["n0", "n1", "t0", "t1"]
#: Ids of words that workers don't hold begin here.
FAR = 1 << 61
#: Losses that are found by joins are added up as integers, so that their order doesn't matter.
SCALE = 1 << 30
#: Size of the bit tables by which workers rule out most words and pairs that no table has (what passes is joined).
BITS = 26


def _least_count(counts: DataFrame, most: int) -> int:
    """The lowest count such that at most ``most`` rows have it or more."""
    steps = counts.groupBy(F.least(F.col("n"), F.lit(1_000_000)).alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    total, least = 0, 1_000_001
    for n, rows in sorted(map(tuple, steps.collect()), reverse=True):  # a row per count, up to a million of small integers
        if total + rows > most:
            break
        total, least = total + rows, n
    return least


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for batch in batches:
        for t in batch["text"]:
            if t:
                seen.update(t.lower().split())
            if len(seen) > 400_000:
                yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})
                seen.clear()
    yield pd.DataFrame({"word": pd.Series(list(seen), dtype=object), "n": np.array(list(seen.values()), np.int64)})


def _slot(a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    """The place of a word or a pair in a bit table."""
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(b).astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def _bit_table(rows: DataFrame, *columns: str) -> np.ndarray:
    """The bits of all rows, in bytes; of one size whatever the number of rows."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"slot": 1 + np.unique(_slot(*[batch[c].to_numpy(np.int64) for c in columns]))})

    found = rows.select(*columns).mapInPandas(slots, "slot long")
    found = found.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    table = found.toArrow().to_pydict()
    # Spark's buckets begin with the number 1
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for bucket, bits in zip(table["bucket"], table["bits"]):
        out[(bucket - 1) * 4096 : (bucket - 1) * 4096 + len(bits)] |= np.frombuffer(bits, np.uint8)
    return out


def _may_have(table: np.ndarray, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    slot = _slot(a, b)
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _far_id(word: str) -> int:
    return FAR | int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 3


def _ids(text: str | None, place: dict[str, int], unknown: int, more: np.ndarray | None) -> np.ndarray:
    """Word ids of a text, after the mark that stands before the first word.

    A word without a place is unknown, unless the bit table of ``more`` words may have it: then it goes by its hash.
    """
    words = (text or "").lower().split()
    ids = np.empty(len(words) + 1, np.int64)
    ids[0] = unknown + 1
    ids[1:] = np.fromiter(map(place.get, words, repeat(unknown if more is None else -1)), np.int64, len(words))
    if more is not None and len(at := np.flatnonzero(ids < 0)):
        far = np.array([_far_id(words[i - 1]) for i in at.tolist()], np.int64)
        ids[at] = np.where(_may_have(more, far), far, unknown)
    return ids


def _pair_counter(held, unknown: int):
    """Counts pairs per task; the word before the first one is ``unknown + 1``.

    ``n`` is the count times four, plus two in the target, plus the fold.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, more = held.value
        keys: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        waiting = 0

        def flush() -> pd.DataFrame:
            k = np.concatenate(keys, axis=1) if keys else np.empty((2, 0), np.int64)
            m = np.concatenate(marks) if marks else np.array([], np.int64)
            keys.clear()
            marks.clear()
            order = np.lexsort((m, *k))
            k, m = k[:, order], m[order]
            new = (k[:, 1:] != k[:, :-1]).any(axis=0) | (m[1:] != m[:-1])
            at = np.flatnonzero(np.concatenate([[True], new])) if len(m) else np.array([], np.int64)
            return pd.DataFrame({"a": k[0, at], "b": k[1, at], "n": 4 * np.diff(at, append=len(m)) + m[at]})

        for batch in batches:
            for t, target, fold in zip(batch["text"], batch["is_target"], batch["fold"]):
                ids = _ids(t, place, unknown, more)
                if len(ids) > 1:
                    keys.append(np.stack([ids[:-1], ids[1:]]))
                    marks.append(np.full(len(ids) - 1, 2 * int(target) + int(fold), np.int64))
                    waiting += len(ids)
                if waiting > 2_000_000:
                    yield flush()
                    waiting = 0
        yield flush()

    return count


def fold_of(key: str) -> F.Column:
    """0 or 1, by the hash of the id."""
    return F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(2)).cast("int")


def _far(base: int) -> Column:
    return (F.col("a") >= base) | (F.col("b") >= base)


def _resolved(rows: DataFrame, rare: DataFrame, unknown: int) -> DataFrame:
    """Rows of pairs ``a, b`` in which hashes of words that aren't in ``rare`` become the unknown word."""
    names = rows.columns
    for c, other in (("a", "b"), ("b", "a")):
        # a row that asks for nothing goes by its other word, so that no key gathers rows
        key = F.when(F.col(c) >= FAR, F.col(c)).otherwise(-F.col(other))
        known = sized(rare).select(F.col("id").alias(f"{c}_key"), F.lit(True).alias(f"{c}_kept"))
        rows = rows.withColumn(f"{c}_key", key).join(known, f"{c}_key", "left")
    new = {c: F.when((F.col(c) < FAR) | F.col(f"{c}_kept"), F.col(c)).otherwise(F.lit(unknown)).cast("long") for c in "ab"}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in names])


def _with_words(rows: DataFrame, column: str, kind: str, near: DataFrame, rare: DataFrame | None) -> DataFrame:
    """Rows with the ``kind`` columns (``before`` or ``word``) of the word in ``column``; a frequent word's come by broadcast."""
    values = lambda t: t.select(F.col("id").alias(column), *[F.col(f"{kind}_{c}") for c in COUNTS])
    out = rows.where(F.col(column) < FAR).join(F.broadcast(values(near)), column)
    return out if rare is None else out.unionByName(rows.where(F.col(column) >= FAR).join(values(rare), column))


def fit(docs: DataFrame, max_words: int = 1 << 17, max_pairs: int = 1 << 19, min_count: int = MIN_COUNT) -> dict:
    """Fit both models on ``docs`` with columns ``text, is_target, fold``.

    The background is every document, the target those with ``is_target``.
    ``max_words`` and ``max_pairs`` are what workers hold; the losses don't depend
    on them.  Returns the tables that :func:`score` takes.
    """
    spark = docs.sparkSession
    docs = docs.select("text", F.coalesce("is_target", F.lit(False)).alias("is_target"), "fold")
    words = docs.select("text").mapInPandas(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words.where(F.col("n") >= min_count))
    least = _least_count(words, max_words)
    kept = words.where(F.col("n") >= least).select("word").toArrow().to_pandas()["word"]
    place = {w: i for i, w in enumerate(sorted(kept))}
    unknown = len(place)
    base = unknown + 2

    def far_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": np.array([_far_id(w) for w in batch["word"]], np.int64)})

    rare = materialize(words.where(F.col("n") < least).select("word").mapInPandas(far_ids, "id long").distinct())
    n_rare = rare.count()
    drop_materialized(words)
    more = _bit_table(rare, "id") if n_rare else None
    counter = _pair_counter(spark.sparkContext.broadcast((place, more)), unknown)
    sums = [F.sum(c).alias(c) for c in COUNTS]
    n, fold, target = F.shiftright("n", 2), F.col("n").bitwiseAND(F.lit(1)), F.shiftright("n", 1).bitwiseAND(F.lit(1))
    each = {c: n * (fold if c[1] == "1" else 1 - fold) * (target if c[0] == "t" else 1) for c in COUNTS}
    # tasks give each pair once for a fold, so rows are summed only where they are gathered
    pairs = docs.mapInPandas(counter, "a long, b long, n long").repartition("a", "b").groupBy("a", "b").agg(*[F.sum(x).alias(c) for c, x in each.items()])
    pairs = materialize(pairs)
    if n_rare:
        found = pairs
        far = _resolved(found.where(_far(base)), rare, unknown)
        vague = (F.col("a") == unknown) | (F.col("b") == unknown)
        far = far.union(found.where(~_far(base) & vague)).groupBy("a", "b").agg(*sums)
        pairs = materialize(found.where(~_far(base) & ~vague).union(far))
        drop_materialized(found)
    first, last = (pairs.groupBy(F.col(c).alias("id")).agg(*sums) for c in "ab")
    total = np.array(pairs.agg(*sums).fillna(0).first(), float) + FLAT * (base + n_rare)
    model: dict = {"place": place, "unknown": unknown, "more": more}
    near = {"id": np.arange(base)}
    of_first, of_last = (t.where(F.col("id") < base).toArrow().to_pandas() for t in (first, last))
    for c, full in zip(COUNTS, total):
        before, single = np.zeros(base), np.full(base, FLAT)
        before[of_first["id"].to_numpy(np.int64)] = of_first[c].to_numpy()
        single[of_last["id"].to_numpy(np.int64)] += of_last[c].to_numpy()
        model[c] = {"before": before.astype(np.float32), "word": single / full}
        near |= {f"before_{c}": np.log(before + BACK), f"word_{c}": np.log(BACK * single / full)}
    near = spark.createDataFrame(pd.DataFrame(near))
    words = None
    if n_rare:
        logs = [F.log(F.coalesce(f"f_{c}", F.lit(0)) + BACK).alias(f"before_{c}") for c in COUNTS]
        logs += [F.log((F.col(c) + FLAT) * (BACK / full)).alias(f"word_{c}") for c, full in zip(COUNTS, total)]
        firsts = first.where(F.col("id") >= FAR).select("id", *[F.col(c).alias(f"f_{c}") for c in COUNTS])
        words = materialize(last.where(F.col("id") >= FAR).join(firsts, "id", "left").select("id", *logs))
    # a pair that only one fold has is never looked up by the other
    both = pairs.where("n0 > 0 and n1 > 0").withColumn("n", F.col("n0") + F.col("n1"))
    held = F.lit(False) if not max_pairs else ~_far(base) & (F.col("n") >= _least_count(both.where(~_far(base)), max_pairs))
    top = both.where(held).withColumn("pair", F.col("a") * base + F.col("b")).toArrow().to_pandas().sort_values("pair")
    model["pair"] = top["pair"].to_numpy()
    for c in COUNTS:
        model[c]["pair"] = top[c].to_numpy().astype(np.float32)
    # what a pair's count takes off the loss; pairs with the unknown word are asked for by rows whose words are found by joins
    off = [(F.log(F.col(c) + F.exp(f"word_{c}")) - F.col(f"word_{c}")).alias(c) for c in COUNTS]
    lost = lambda t: materialize(_with_words(t, "b", "word", near, words).select("a", "b", *off))
    rest = lost(both.where(~held))
    mixed = lost(both.where(held & ((F.col("a") == unknown) | (F.col("b") == unknown)))) if n_rare else None
    model["tables"] = {"rare": rare, "near": near, "words": words, "rest": rest, "mixed": mixed}
    model["asks"] = n_rare > 0 or not rest.isEmpty()
    model["may_ask"] = _bit_table(rest, "a", "b") if model["asks"] else None
    drop_materialized(pairs)
    return model


class Slots:
    """Places of keys in an array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.at = np.zeros(1 << self.bits, np.int64)
        left, slot = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.key[slot] < 0
            got, one = np.unique(slot[free], return_index=True)
            taken = np.flatnonzero(free)[one]
            self.key[got], self.at[got] = keys[left[taken]], left[taken]
            stay = np.ones(len(left), bool)
            stay[taken] = False
            left, slot = left[stay], (slot[stay] + 1) & (len(self.key) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, slot = np.arange(len(keys)), self._first(keys)
        while len(left):
            seen = self.key[slot]
            hit = seen == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (seen >= 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.key) - 1)
        return out


def _losses(ids: list[np.ndarray], folds: list[int], model: dict, slots: Slots) -> list[tuple]:
    """Tokens, summed losses under the other fold's target and background, and pairs that are looked up elsewhere.

    A pair with a word that isn't held has no loss yet; another unknown pair has that of one never seen.
    """
    sizes = np.array([len(i) - 1 for i in ids])
    fold = np.repeat(np.array(folds, np.int64), sizes)
    first, last = np.concatenate([i[:-1] for i in ids]), np.concatenate([i[1:] for i in ids])
    near = (first < FAR) & (last < FAR)
    at = np.full(len(first), -1, np.int64)
    at[near] = slots.find(first[near] * (model["unknown"] + 2) + last[near])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    losses = []
    for kind in "tn":
        loss = np.zeros(len(first))
        for f in (0, 1):
            own = np.flatnonzero((fold == f) & near)
            m, a, b = model[f"{kind}{1 - f}"], first[own], last[own]
            seen = np.where(at[own] >= 0, m["pair"][at[own]], 0.0) if len(m["pair"]) else 0.0
            loss[own] = np.log(m["before"][a] + BACK) - np.log(seen + BACK * m["word"][b])
        full = sizes > 0
        out = np.full(len(ids), np.nan)
        if full.any():
            out[full] = np.add.reduceat(loss, starts[full])
        losses.append(out)
    rows = [sizes.tolist(), *losses]
    if model["asks"]:
        ask = at < 0
        ask[ask] = ~near[ask] | _may_have(model["may_ask"], first[ask], last[ask])
        ends = np.cumsum(np.concatenate([[0], ask]))[np.cumsum(sizes)][:-1]
        rows += [np.split(first[ask], ends), np.split(last[ask], ends)]
    return list(zip(*rows))


def _added(asked: DataFrame, model: dict) -> DataFrame:
    """Per ``key`` what the pairs ``a, b`` of ``asked`` add to the sums, ``t`` and ``n`` in units of 1 / ``SCALE``."""
    tables, unknown = model["tables"], model["unknown"]
    far_row = _far(unknown + 2)
    other = lambda kind, pre="": F.when(F.col("fold") == 0, F.col(f"{pre}{kind}1")).otherwise(F.col(f"{pre}{kind}0"))
    sums = lambda rows, sign, pre="": rows.select("key", *[F.round(sign * SCALE * other(k, pre)).cast("long").alias(k) for k in "tn"])
    parts = []
    if model["more"] is not None:
        far = materialize(_resolved(asked.where(far_row), tables["rare"], unknown))
        asked = asked.where(~far_row).unionByName(far)
        for c, kind, sign in (("a", "before", 1), ("b", "word", -1)):
            parts.append(sums(_with_words(far, c, kind, tables["near"], tables["words"]), sign, f"{kind}_"))
        parts.append(sums(far.join(sized(tables["mixed"]), ["a", "b"]), -1))
    parts.append(sums(asked.join(tables["rest"], ["a", "b"]), -1))
    return reduce(DataFrame.union, parts).groupBy("key").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))


def score(docs: DataFrame, model: dict, text: str = "text", fold: str = "fold", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens, target_loss, background_loss, score`` to every document.

    Losses are nats per token, ``score`` is target minus background: the lower,
    the more like the target.  Null, empty and blank texts have no tokens and
    null losses.  Columns of ``docs`` with these names are replaced; of the others
    ``keep`` names those that stay (all).
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast({k: v for k, v in model.items() if k != "tables"})
    names = ["n_tokens", "target_loss", "background_loss", "score"]
    stay = [c for c in (docs.columns if keep is None else keep) if c not in names]
    kinds = {"n_tokens": "long", "t": "double", "n": "double"} | ({"a": "array<long>", "b": "array<long>"} if model["asks"] else {})

    @F.pandas_udf(", ".join(f"{c} {k}" for c, k in kinds.items()))
    def losses(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = held.value
        slots = Slots(m["pair"])
        frame = lambda w: pd.DataFrame(_losses(*map(list, zip(*w)), m, slots), columns=list(kinds))
        for texts, folds in batches:
            waiting: list[tuple[np.ndarray, int]] = []
            tokens = 0
            for t, f in zip(texts, folds):
                ids = _ids(t, m["place"], m["unknown"], m["more"])
                waiting.append((ids, f))
                tokens += len(ids)
                if tokens > 300_000:
                    yield frame(waiting)
                    waiting, tokens = [], 0
            if waiting:
                yield frame(waiting)

    own = unused(docs, "lm")
    found = docs.select(*stay, losses(F.col(text), F.col(fold)).alias(own), F.col(fold).cast("int").alias(f"{own}_fold"))
    more = {"t": F.lit(0), "n": F.lit(0)}
    if model["asks"]:
        # the key is written with the pairs, so it names the same row in both
        found = materialize(found.withColumn(f"{own}_key", F.monotonically_increasing_id()))
        asked = found.select(F.col(f"{own}_key").alias("key"), F.col(f"{own}_fold").alias("fold"), F.explode(F.arrays_zip(f"{own}.a", f"{own}.b")).alias("p"))
        added = _added(asked.select("key", "fold", F.col("p.a").alias("a"), F.col("p.b").alias("b")), model)
        added = added.toDF(f"{own}_key", f"{own}_t", f"{own}_n")
        found = found.join(added, f"{own}_key", "left")
        more = {k: F.coalesce(f"{own}_{k}", F.lit(0)) for k in "tn"}
    n = F.col(f"{own}.n_tokens")
    loss = {k: F.when(n > 0, (F.col(f"{own}.{k}") + more[k] / F.lit(float(SCALE))) / n) for k in "tn"}
    return found.select(
        *stay, n.alias("n_tokens"), loss["t"].alias("target_loss"), loss["n"].alias("background_loss"), (loss["t"] - loss["n"]).alias("score"),
    )
