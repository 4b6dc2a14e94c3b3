"""SimHash fingerprints and their near-duplicate links (operator 10).

A document's fingerprint is the bitwise majority of its shingles' hashes.  Two
fingerprints link at ``radius`` or fewer differing bits.  Documents with equal
fingerprints are grouped first, so all later work is on distinct fingerprints.

Which pairs are looked at: the 64 bits are cut into ``radius + 2`` blocks.  Two
fingerprints that differ in ``radius`` bits or fewer agree in two whole blocks
at least, so rows are dealt by every pair of blocks (a table per pair), and no
linked pair is missed.  Within a bucket the pivot table decides: the Hamming
distances of each fingerprint to reference fingerprints are computed once per
row; a pair whose distances to any reference differ by more than ``radius``
can't link, by the triangle inequality.  Survivors are verified bit by bit.

A bucket gives at most one link per member (a spanning forest of its links, by
union-find inside the bucket), never all its pairs.  A bucket of over
``chunk`` rows is cut into chunks, and every pair of chunks is a task of its
own, so that no task holds more than two chunks of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, drop_materialized, materialize

BITS = 64
#: Reference fingerprints; drawn once with a fixed seed.
PIVOTS = 24
SEED = 42


def fingerprint_bytes(text: str | None, n_words: int = 4) -> int:
    """The fingerprint of one text; see :func:`fingerprints`."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(n_words, len(words))
    of = xxhash.xxh64_intdigest
    view = memoryview(joined)
    total = len(words) - k + 1
    count = np.zeros(BITS, np.int64)
    for lo in range(0, total, 8192):
        hi = min(total, lo + 8192)
        h = np.array([of(view[s:e], SEED) for s, e in zip(starts[lo:hi].tolist(), ends[lo + k - 1 : hi + k - 1].tolist())], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    on = np.flatnonzero(2 * count > total)
    return int(sum(1 << int(b) for b in on))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", n_words: int = 4) -> DataFrame:
    """Add the fingerprint as a signed long.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are
    ``n_words`` words joined by spaces with repeats counted (fewer words: the
    whole sequence; no words or null: fingerprint zero), hashed by XXH64 with
    seed 42.  A bit is 1 if it is set in over half the hashes.
    """

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vals = np.fromiter((fingerprint_bytes(t, n_words) for t in batch), np.uint64, len(batch))
            yield pd.Series(vals.view(np.int64))

    return docs.withColumn(out, fp(F.col(text)))


def _pivots(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2**64, n, dtype=np.uint64)


def _table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances to the pivots: one row for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def bucket_forest(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (as positions) that span each linked group of one bucket.

    Rows are tried from each not yet settled row: those near it (within
    ``radius``) join its group.  A row is compared with those rows only that the
    pivot table doesn't rule out and that aren't in its group already.
    """
    n = len(fps)
    parent = np.arange(n)
    label = np.arange(n)
    links = []
    for i in range(n - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(rest):
            continue
        for p in range(0, table.shape[1], 8):  # the largest coordinate difference, in steps
            rest = rest[(np.abs(table[rest, p : p + 8] - table[i, p : p + 8]) <= radius).all(axis=1)]
            if not len(rest):
                break
        rest = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= radius]
        for j in rest.tolist():
            a, b = _find(parent, i), _find(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
        if len(rest):
            groups = np.unique(label[rest])
            label[np.isin(label, groups)] = label[i]
    return links


def _sorted_links(frame: pd.DataFrame, radius: int, pivots: np.ndarray) -> pd.DataFrame:
    """Spanning links of all buckets of a frame sorted by bucket."""
    key, sub = frame["bucket"].to_numpy(), frame["pair"].to_numpy()
    fps = frame["fp"].to_numpy().view(np.uint64)
    new = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
    starts = np.concatenate([[0], new])
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    a, b = [], []
    two = starts[sizes == 2]
    if len(two):
        x, y = fps[two], fps[two + 1]
        tx, ty = _table(x, pivots), _table(y, pivots)
        ok = (np.abs(tx - ty).max(axis=1) <= radius) & (np.bitwise_count(x ^ y) <= radius)
        a.append(x[ok])
        b.append(y[ok])
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        own = fps[s : s + n]
        found = bucket_forest(own, _table(own, pivots), radius)
        if found:
            i, j = np.array(found).T
            a.append(own[i])
            b.append(own[j])
    if not a:
        return pd.DataFrame({"a": np.array([], np.int64), "b": np.array([], np.int64)})
    return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def near_links(fps: DataFrame, radius: int = 4, chunk: int = 20_000, pivots: int = PIVOTS) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that span every component.

    ``fps`` has a column ``fp`` (long) without repeats.
    """
    blocks = radius + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = []
    for keep in combinations(range(blocks), 2):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in keep)
        masks.append(mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask)
    keyed = fps.select(
        "fp",
        F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks)])).alias("bucket"),
    )
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    large = counts.where(F.col("n") > chunk).select("bucket", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    large = materialize(large)
    dealt = keyed.join(large, "bucket", "left")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts").cast("long")).cast("int")
    pair = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda o: F.least(o, own) * F.col("parts") + F.greatest(o, own),
        )
    )
    dealt = dealt.select("bucket", F.explode(pair).alias("pair"), "fp")
    refs = _pivots(pivots)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = (batch["bucket"] == batch["bucket"].iloc[-1]) & (batch["pair"] == batch["pair"].iloc[-1])
            first = len(batch) - int(last.to_numpy()[::-1].argmin()) if not last.all() else 0
            if first:
                yield _sorted_links(pd.concat([*held, batch.iloc[:first]]), radius, refs)
                held = [batch.iloc[first:]]
            elif held and (held[-1]["bucket"].iloc[-1] != batch["bucket"].iloc[0] or held[-1]["pair"].iloc[-1] != batch["pair"].iloc[0]):
                yield _sorted_links(pd.concat(held), radius, refs)
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield _sorted_links(pd.concat(held), radius, refs)

    return (
        dealt.repartition("bucket", "pair")
        .sortWithinPartitions("bucket", "pair", "fp")
        .mapInPandas(spans, "a long, b long")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id that links lead to, the document's own
    included.  Null and empty texts, and texts of white space only, have
    fingerprint zero and link like any other.  A null id keeps its fingerprint;
    its component is that of the others with its fingerprint, or null.  Rows
    with equal ids are all returned.  An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "fp"))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = materialize(rooted.join(least, "root").select("fp", "component_id"))
    drop_materialized(rooted)
    drop_materialized(distinct)
    return prints.join(by_fp, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
