"""Line-first cleaning (operator 3), with DataFrame functions only.

Every non-blank line is held against three rules; lines that fail one are
removed, and a document that loses more than ``max_lost`` of its text is
rejected.  The rules:

* punctuation: the line closes no sentence anywhere, or over ``max_marks`` of
  its words end in a symbol or an exclamation mark, as no prose does;
* navigation: a list of items between bars or arrows;
* boilerplate: a short line with one of the fixed phrases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, unused

#: Phrases of notices and page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "we use cookies", "accept cookies", "privacy policy",
    "terms of use", "terms of service", "terms and conditions", "sign up for our newsletter",
    "subscribe to our newsletter", "click here to", "read more", "share this", "skip to content",
    "back to top", "powered by", "enable javascript", "javascript is disabled", "lorem ipsum",
    "log in or register", "copyright ©", "©",
)
#: A boilerplate phrase counts in lines of so many words at most.
NOTICE_WORDS = 30
SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"


def line_fails(line: Column, max_marks: float = 0.25) -> Column:
    """Whether a non-blank line fails a rule."""
    no_sentence = ~line.rlike(r"[.!?…。！？][\"'”’»)\]]*(?=[\x20\x09-\x0D]|$)")
    n_words = F.regexp_count(line, F.lit(WORD))
    marked = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D](?:[#*$%&<>|]|!!)+(?=[\x20\x09-\x0D]|$)"))
    items = F.regexp_count(line, F.lit(r"(?<=[\x20\x09-\x0D])[|»›>→·•](?=[\x20\x09-\x0D])"))
    phrase = "(?i)" + "|".join(p.replace(".", r"\.") for p in BOILERPLATE)
    notice = line.rlike(phrase) & (n_words <= NOTICE_WORDS)
    # in this order: the cheap tests settle most lines
    has_marks = line.rlike(r"[#*$%&<>|!»›→·•]")
    return no_sentence | notice | (has_marks & ((marked > max_marks * n_words) | ((items >= 2) & (items * 4 >= n_words))))


def _repeat_words(grams: Column, n_words: Column) -> Column:
    """Words in 3-word windows whose hash occurs twice or more.

    ``grams`` is an array of (hash, place) structs sorted by both.
    """
    same = lambda i, j: F.get(grams, i)["h"] == F.get(grams, j)["h"]
    twice = F.filter(grams, lambda g, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda g: g["p"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        places,
        start,
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"].cast("long"),
    )


def clean_lines(docs: DataFrame, text: str = "text", max_lost: float = 0.4, max_marks: float = 0.25) -> DataFrame:
    """Measure, clean and judge every document; all columns of ``docs`` stay.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long),
    ``base_failed``, ``cleaned_text``, ``lost`` (share of the characters outside
    white space that the removed lines hold), and ``kept`` (boolean).  Columns
    of ``docs`` with these names are replaced.  A null or empty text counts as
    empty: no words, ``base_failed``, not kept, cleaned to the empty string.
    Rows are independent, so repeated rows get equal results and no data is
    shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned_text", "lost", "kept"]
    base = docs.drop(*[c for c in own if c != text])
    held, lines, full, grams = (unused(docs, c) for c in ("words", "lines", "filled", "grams"))
    words = base.withColumn(held, F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).withColumn(lines, F.split(t, "\n", -1))
    w = F.col(held)
    n = F.size(w)
    hashes = F.when(
        n >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
            )
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    filled = F.filter(F.col(lines), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = words.select(
        *base.columns,
        lines,
        n.cast("long").alias("n_words"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        filled.alias(full),
        hashes.alias(grams),
    )
    good = F.filter(F.col(lines), lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~line_fails(x, max_marks))
    judged = measured.select(
        *base.columns,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(grams), n).alias("n_repeat_words"),
        F.array_join(good, "\n").alias("cleaned_text"),
    )
    # a generated row: a filter on the results isn't pushed below it, into the array functions
    made = [c for c in judged.columns if c not in base.columns]
    judged = judged.select(*base.columns, F.inline(F.array(F.struct(*made))))
    left = F.length(F.translate("cleaned_text", " \t\n\x0b\x0c\r", ""))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        judged.withColumn("base_failed", failed)
        .withColumn("lost", F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(0.0))
        .withColumn("kept", ~failed & (F.col("lost") <= max_lost))
    )
