"""Secret scans (operator 6), with DataFrame functions only.

Fixed patterns give the base spans.  On top of them, two character Markov
models, one of random strings and one of ordinary identifiers, are compared on
every run of 12 or more key characters: the mean log-likelihood ratio per
character decides.  Both are trained on labelled samples from the table itself:
hex strings, access keys, and assigned values of 16 or more characters with a
digit are labelled random; words, identifiers, numbers, dates and paths outside
all base matches ordinary.  A quarter of the labelled strings is held out, and the
threshold lies between the two labels' ratios there.  Random strings of lower-case
letters only are mostly taken for ordinary.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, unused

#: Kinds in their order, with pattern, group and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
#: Runs that the models judge.
CANDIDATE, CANDIDATE_CHARS = r"[A-Za-z0-9+/_=-]{12,}", 12
#: What counts as an ordinary string outside all base matches: words, identifiers, numbers, dates, paths.
ORDINARY = r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{3,}"
#: Mean log-likelihood ratio per character (nats) from which a run counts as random, where no samples are held out.
THRESHOLD = 0.6
#: Shares of held-out random strings that may be missed, and of ordinary ones that may be found.
MISSED, FALSE = 0.02, 0.001
#: Documents from which ordinary identifiers are taken, in expectation, at most.
TRAIN_DOCS = 20_000


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Spans of all matches, as structs of start, kind and end in code points.

    The text between matches comes from a split at the same pattern, so each
    match begins where the lengths so far end.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), values.alias("value"))
    state = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(s: Column, r: Column) -> Column:
        start = s["at"] + F.length(r["gap"])
        end = start + F.coalesce(F.length(r["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(r["value"]) >= least, F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(rows, state, step, lambda s: s["out"])).otherwise(empty)


def _bigrams(tokens: DataFrame) -> dict[str, int]:
    """Counts of character pairs, a start mark included; at most alphabet squared rows."""
    marked = F.concat(F.lit("^"), F.col("token"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2)))
    return dict(tokens.select(F.explode(pairs).alias("pair")).groupBy("pair").count().collect())


def _conditional(counts: dict[str, int], flat: float) -> dict[str, float]:
    """Pair probabilities, smoothed by the single characters and those by ``flat``."""
    single: dict[str, float] = {}
    first: dict[str, int] = {}
    for pair, n in counts.items():
        single[pair[1]] = single.get(pair[1], 0) + n
        first[pair[0]] = first.get(pair[0], 0) + n
    total = sum(single.values())
    uni = {c: (single.get(c, 0) + flat) / (total + flat * len(ALPHABET)) for c in ALPHABET}
    back = 8.0
    return {a + b: (counts.get(a + b, 0) + back * uni[b]) / (first.get(a, 0) + back) for a in "^" + ALPHABET for b in ALPHABET}


def samples(docs: DataFrame, text: str = "text", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Distinct labelled strings: ``token, random, held_out``.

    Random ones come from the whole table, ordinary ones from ``train_docs``
    documents in expectation, chosen by the hash of key and text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    (_, assign, group, _), *others = BASE
    long = lambda v: (F.length(v) >= 16) & v.rlike("[0-9]")
    held = [F.filter(F.regexp_extract_all(t, F.lit(assign), F.lit(group)), long)]
    held += [F.filter(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda v, n=n: F.length(v) >= n) for _, p, _, n in others]
    hit = F.array(*[t.rlike(p) for _, p, _, _ in BASE])
    found = docs.where(F.array_contains(hit, True)).select(F.explode(F.concat(*held)).alias("token"), F.lit(True).alias("random"))
    clean = t
    for _, p, _, _ in BASE:
        clean = F.regexp_replace(clean, p, " ")
    share = min(1.0, train_docs / max(docs.count(), 1))
    chosen = docs.where(F.pmod(F.xxhash64(key, text, F.lit("train")), F.lit(1 << 52)) < F.lit(share) * F.lit(float(1 << 52)))
    plain = chosen.select(F.explode(F.regexp_extract_all(clean, F.lit(ORDINARY), F.lit(0))).alias("token"), F.lit(False).alias("random"))
    held_out = F.pmod(F.xxhash64("token"), F.lit(4)) == 0
    return materialize(found.union(plain).distinct().withColumn("held_out", held_out))


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", train_docs: int = TRAIN_DOCS) -> tuple[list[float], float]:
    """Log-likelihood ratio of each character pair, random against ordinary, and the threshold.

    Without any samples the ratio is that of flat models, and nothing is found.
    """
    known = samples(docs, text, key, train_docs)
    p = _conditional(_bigrams(known.where("random and not held_out")), 2.0)
    q = _conditional(_bigrams(known.where("not random and not held_out")), 0.5)
    ratios = [log(p[a + b] / q[a + b]) for a in "^" + ALPHABET for b in ALPHABET]
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    judged = known.where(F.col("held_out") & F.col("token").rlike(f"^{CANDIDATE}$"))
    steps = judged.groupBy("random", F.floor(_mean_ratio(F.col("token"), table) * 100).alias("step")).count()
    rows = sorted(map(tuple, steps.collect()))  # hundredths of a nat: a bounded number of rows
    drop_materialized(known)
    low = _quantile([(s, n) for r, s, n in rows if r], MISSED)
    high = _quantile([(s + 1, n) for r, s, n in rows if not r], 1 - FALSE)
    if low is None or high is None:
        return ratios, THRESHOLD
    return ratios, max(high, (low + high) / 2)


def _quantile(steps: list[tuple[int, int]], share: float) -> float | None:
    left = share * sum(n for _, n in steps)
    for step, n in steps:
        left -= n
        if left <= 0:
            return step / 100
    return None


def _mean_ratio(run: Column, table: Column) -> Column:
    size = len(ALPHABET)
    at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    state = F.struct(F.lit(0).alias("from"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        at,
        state,
        lambda s, i: F.struct(i.alias("from"), (s["sum"] + F.get(table, s["from"] * size + i - 1)).alias("sum")),
        lambda s: s["sum"],
    )
    return total / F.length(run)


def scan(docs: DataFrame, model: tuple[list[float], float], text: str = "text") -> DataFrame:
    """Add ``base`` and ``all_spans``, arrays of (start, kind, end).

    ``model`` is what :func:`train` gives: ratios and threshold.  Kinds are
    places in :data:`BASE`; 3 stands for the models.  Spans that the models add
    overlap no base span.  A null or empty text has no spans.  All columns of
    ``docs`` stay, except those two names; null and repeated ids are rows like
    any other.  No row leaves its partition.
    """
    ratios, threshold = model
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.drop(*[c for c in ("base", "all_spans") if c != text])
    base = F.array_sort(F.concat(*[_spans(t, k, p, g, n) for k, (_, p, g, n) in enumerate(BASE)]))
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    runs = F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))
    found = _spans(t, len(BASE), CANDIDATE, 0, CANDIDATE_CHARS)
    own = unused(docs, "runs")
    held = docs.withColumn("base", base).withColumn(own, F.when(t.rlike(CANDIDATE), F.arrays_zip(found.alias("span"), runs.alias("run"))))
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    more = F.filter(own, lambda r: clear(r["span"]) & (_mean_ratio(r["run"], table) > threshold))
    added = F.transform(more, lambda r: r["span"])
    return held.withColumn("all_spans", F.array_sort(F.concat("base", F.coalesce(added, F.array().cast("array<struct<start:int,kind:int,end:int>>"))))).drop(own)


def span_text(spans: Column, kinds: tuple[str, ...] = (*[b[0] for b in BASE], "random")) -> Column:
    """Spans as ``kind:start:end``, comma-joined, in the array's order."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count_kind(spans: Column, kind: int) -> Column:
    """How many spans are of a kind (long)."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
