"""Quality classifier by compression with two dictionaries (operator 12).

One zstandard dictionary is trained on pieces of texts labelled good, one on
pieces of texts labelled bad.  A text is cut into pieces of ``PIECE`` bytes, each
is compressed with both, and ``(bad size - good size) / bytes of the text`` is its
normalised difference: above zero the good dictionary helps more.  A logistic
curve, fitted on labelled texts that neither dictionary has seen, turns the
difference into the score.

Whole texts are scored, piece by piece.  Only training is bounded, by parameters:
``SAMPLE_DOCS`` labelled rows for each class and part in expectation, and
``SAMPLE_BYTES`` of pieces for each dictionary, both taken by hash.  The curve is
fitted on counts by class and rounded difference, so that the driver gets at most
a few thousand rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused

#: Bytes of UTF-8 that are compressed on their own; a dictionary helps short inputs most.
PIECE = 1024
LEVEL = 3
DICT_BYTES = 112_640
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 6_000_000
#: Differences are rounded to this many decimals for the curve's fit only.
DECIMALS = 4


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id. Fold 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


@dataclass(frozen=True)
class Model:
    """Dictionaries of the good and the bad class, and the curve ``1 / (1 + exp(-(slope x + offset)))``.

    An absent dictionary (no labelled text of the class) is ``b""``; then every
    difference is zero and the score is the share of good labels.
    """

    good: bytes
    bad: bytes
    slope: float
    offset: float


def _cut(text: bytes | None) -> Iterator[bytes]:
    view = memoryview(text or b"")
    return (bytes(view[i : i + PIECE]) for i in range(0, len(view), PIECE))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def differences(texts: list[bytes | None], good: bytes, bad: bytes) -> np.ndarray:
    """The normalised size difference of each text; 0 for an empty or null one."""
    if not good or not bad:
        return np.zeros(len(texts))
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress
    return np.array([sum(len(by_bad(p)) - len(by_good(p)) for p in _cut(t)) / max(1, len(t or b"")) for t in texts])


def difference_column(text: str, good: bytes, bad: bytes) -> Column:
    @F.pandas_udf("double")
    def difference(texts: pd.Series) -> pd.Series:
        return pd.Series(differences(texts.tolist(), good, bad))

    return difference(F.col(text).cast("binary"))


def train_dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary of the pieces: trained, or their own content if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICT_BYTES]


def _by_hash(rate: float, *cols: str | Column) -> Column:
    """Keeps a row with probability ``rate``, by the hash of its columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) < F.lit(math.ceil(min(1.0, rate) * (1 << 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """``fold, good, text`` of a bounded sample of the labelled rows outside fold 1.

    Only label ids are sampled and broadcast (``4 * SAMPLE_DOCS`` in expectation), so
    the texts are not shuffled.  Ids that are null or labelled both ways are left out.
    """
    marked = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .where("low = high")
        .select("id", (F.col("high") == 1).alias("good"), fold_of("id").alias("fold"))
        .where("fold <> 1")
    )
    marked = materialize(marked)
    sizes = {(r["fold"], r["good"]): r["count"] for r in marked.groupBy("fold", "good").count().collect()}
    keep = F.lit(False)
    for (fold, good), n in sizes.items():
        keep = keep | ((F.col("fold") == fold) & (F.col("good") == good) & _by_hash(SAMPLE_DOCS / n, "id"))
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text")).where("length(text) > 0")
    return materialize(texts.join(F.broadcast(marked.where(keep)), "id").select("fold", "good", "text"))


def sample_pieces(sample: DataFrame) -> dict[bool, list[bytes]]:
    """Pieces for the two dictionaries, at most about ``SAMPLE_BYTES`` for each, in the order of their hash."""
    total = {r["good"]: r["n"] for r in sample.groupBy("good").agg(F.sum(F.length("text")).alias("n")).collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for good, text in zip(batch["good"].to_pylist(), batch["text"], strict=True):
                found = list(_cut(text.as_py()))
                yield pa.record_batch([pa.array([good] * len(found), pa.bool_()), pa.array(found, pa.binary())], ["good", "piece"])

    keep = F.lit(False)
    for good, n in total.items():
        keep = keep | ((F.col("good") == good) & _by_hash(SAMPLE_BYTES / n, "piece"))
    rows = sample.select("good", "text").mapInArrow(cut, "good boolean, piece binary").where(keep).collect()
    pieces: dict[bool, list[bytes]] = {True: [], False: []}
    for r in rows:
        pieces[r["good"]].append(bytes(r["piece"]))
    for found in pieces.values():  # a fixed order that has nothing to do with where a piece stood
        found.sort(key=lambda p: (zlib.crc32(p), p))
    return pieces


def fit_curve(x: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve by Newton steps, with a slight pull of the slope to zero."""
    total = weight.sum()
    if not total:
        return 0.0, 0.0
    share = (weight[good].sum() + 1) / (total + 2)
    scale = float(np.sqrt((weight * x * x).sum() / total))
    if not scale or good.all() or not good.any():
        return 0.0, float(np.log(share / (1 - share)))
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    at, pull = np.array([0.0, np.log(share / (1 - share))]), np.diag([1e-3, 1e-6]) * total
    loss = lambda b: (weight * np.logaddexp(0, np.where(good, -1, 1) * (design @ b))).sum() + b @ pull @ b / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -500, 500)))
        slope = design.T @ (weight * (p - good)) + pull @ at
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + pull, slope)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0] / scale), float(at[1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit dictionaries on fold 0 and the curve on fold 2 of the labelled rows; fold 1 is never read.

    Labels other than 0 and 1 and labels of null ids don't count; empty texts
    teach nothing.  Without labels of both classes the score is a constant.
    """
    sample = labelled_sample(docs, labels, doc_id, text, label)
    pieces = sample_pieces(sample.where("fold = 0"))
    good, bad = (train_dictionary(pieces[k]) if pieces[k] else b"" for k in (True, False))
    binned = sample.where("fold = 2").select("good", F.round(difference_column("text", good, bad), DECIMALS).alias("x"))
    held = binned.groupBy("x", "good").count().orderBy("x", "good").toPandas()
    slope, offset = fit_curve(held["x"].to_numpy(float), held["good"].to_numpy(bool), held["count"].to_numpy(float))
    return Model(good, bad, slope, offset)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: label 1 is likelier) and ``predicted`` (1 from 0.5 on).

    Null and empty texts have the difference 0 and get the curve's value there.
    Every row is scored by its text alone: equal texts have equal scores.  Columns
    that ``docs`` already has under these names come back under free names that
    begin with ``_``.
    """
    for name in ("score", "predicted"):
        if name in {c.lower() for c in docs.columns}:
            docs = docs.withColumnRenamed(next(c for c in docs.columns if c.lower() == name), unused(docs, name))
    x = difference_column(text, model.good, model.bad)
    curve = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(model.slope) * x + F.lit(model.offset))))
    scored = docs.withColumn("score", curve)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
