"""Line-first cleaning with column expressions only.

Every line is judged on its own (punctuation, navigation, boilerplate, repetition inside the document); failing lines
are removed and a document that loses too much of its text is rejected. Nothing is shuffled: lines and words stay
arrays of their row, so one hot source or a very long text costs what its characters cost.

Defined results: a null text is treated as an empty one, gives zero counts, ``base_failed`` true and ``cleaned`` empty. Lines without a
word are kept as they are and weigh nothing. Repeated rows each give their own row. Other columns of the input pass
through :func:`clean` unchanged; its own working columns start with ``__`` and are dropped.

The result of :func:`clean` leaves through ``explode`` of one struct. Spark moves no filter on a made column below that
step, so ``clean(...).where("kept")`` works every text out once instead of copying the rules into the filter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SHOUTS = "!?"
NAV_SEPARATORS = "|»›•·¦"

# Phrases of lines that stand around a text and are not part of it; compared in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "spdx-license-identifier", "copyright (c)", "copyright ©", "terms of use", "terms of service",
    "terms and conditions", "privacy policy", "cookie policy", "use of cookies", "uses cookies", "accept cookies", "enable javascript", "lorem ipsum",
)
NAVIGATION = (
    "skip to content", "skip to main content", "back to top", "read more", "sign in", "sign up", "log in", "click here", "next page", "previous page", "site map", "main menu",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; shares are of the word characters of a line or of a text."""

    terminal: str = r"""[.!?:;…。！？；：؟۔।]["'”’»)\]]*[\x20\x09-\x0D]*$"""
    inner: str = r"[.!?,;:…。！？，、؟،]"
    running_words: int = 12
    symbol_share: float = 0.10
    shout_share: float = 0.10
    separator_share: float = 0.20
    short_line_words: int = 12
    lost_share: float = 0.50
    boilerplate: tuple[str, ...] = BOILERPLATE
    navigation: tuple[str, ...] = NAVIGATION


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def only(text: Column, chars: str) -> Column:
    """The characters of ``text`` that are among ``chars``; one long match a text where there are none."""
    return F.regexp_replace(text, "[^" + "".join("\\" + c for c in chars) + "]+", "")


def marks_of(text: Column) -> Column:
    return only(text, SYMBOLS + SHOUTS + NAV_SEPARATORS)


def count_of(marks: Column, chars: str) -> Column:
    return F.length(only(marks, chars)).cast("long")


def any_phrase(line: Column, phrases: tuple[str, ...]) -> Column:
    return F.rlike(F.lower(line), F.lit("|".join(re.escape(p) for p in phrases)))


def line_parts(line: Column) -> Column:
    """What the rules ask of a line: its text, words, characters in words, and marks."""
    made = F.transform(F.array(words_of(line)), lambda words: F.struct(
        line.alias("line"), F.size(words).alias("words"), F.length(F.array_join(words, "")).alias("chars"), marks_of(line).alias("marks")))
    return made[0]


def line_verdict(x: Column, rules: LineRules) -> Column:
    """Why a line fails: null for a good line, else the rule's name. ``x`` comes from :func:`line_parts`."""
    line, words, chars, marks = x["line"], x["words"], x["chars"], x["marks"]
    marked = F.length(marks) > 0
    short = words <= rules.short_line_words
    return (
        F.when(chars == 0, None)
        .when(marked & (count_of(marks, SYMBOLS) > rules.symbol_share * chars), "punctuation")
        .when(marked & (count_of(marks, SHOUTS) > rules.shout_share * chars) & (count_of(marks, SHOUTS) > 3), "punctuation")
        .when(marked & (count_of(marks, NAV_SEPARATORS) > rules.separator_share * words), "navigation")
        .when(short & any_phrase(line, rules.navigation), "navigation")
        .when(short & any_phrase(line, rules.boilerplate), "boilerplate")
        .when(~F.rlike(line, F.lit(rules.terminal)) & ~((words >= rules.running_words) & F.rlike(line, F.lit(rules.inner))), "punctuation")
    )


def window_keys(hashes: Column, window: int = 5) -> Column:
    """One number for each run of ``window`` words, from one number per word; empty for shorter texts."""
    n = F.greatest(F.size(hashes) - (window - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice(hashes, k + 1, n).alias(f"h{k}") for k in range(window)])
    return F.transform(runs, lambda x: F.xxhash64(x))


def placed_windows(keys: Column) -> Column:
    """Windows in key order with their places, for texts in which a key repeats; else empty."""
    placed = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), placed).otherwise(F.array().cast("array<struct<k:bigint,p:int>>"))


def repeated_words(words: Column, placed: Column, window: int = 5) -> Column:
    """Number of words inside windows of ``window`` words that occur twice or more in the text, first ones included.

    ``placed`` comes from :func:`placed_windows`. Windows are compared by key, and those that agree by their words, so that
    a chance collision cannot count.
    """

    def same(a: Column, b: Column) -> Column:
        equal = a["k"] == b["k"]
        for k in range(window):
            equal = equal & (F.get(words, a["p"] + k) == F.get(words, b["p"] + k))
        return equal

    pairs = F.arrays_zip(F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0))).alias("row"), F.slice(placed, 1, F.greatest(F.size(placed) - 1, F.lit(0))).alias("before"))
    hits = F.filter(pairs, lambda x: same(x["row"], x["before"]))
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(x["row"]["p"], x["before"]["p"])))))
    zero = F.struct(F.lit(0).alias("covered"), F.lit(-window).alias("last"))
    return F.aggregate(
        starts, zero,
        lambda acc, p: F.struct((acc["covered"] + F.least(F.lit(window), p - acc["last"])).alias("covered"), p.alias("last")),
        lambda acc: acc["covered"]).cast("long")


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "failed_lines", "cleaned", "kept")


def clean(docs: DataFrame, text: str = "text", rules: LineRules | None = None, made: Sequence[str] = MADE) -> DataFrame:
    """Input columns and those of ``made``: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars,
    failed_lines (rule -> number), cleaned, kept``. Input columns of these names are replaced. What ``made`` leaves out is not worked out."""
    rules = rules or LineRules()
    own = MADE
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    t = F.coalesce(F.col(text), F.lit(""))
    # Each step is a projection of its own, so that what several columns ask of it is worked out once.
    cut = docs.select(*keep, words_of(t).alias("__words"), F.transform(F.split(t, "\n"), line_parts).alias("__lines"), marks_of(t).alias("__marks"))
    cut = cut.select(
        "*", F.transform("__words", lambda x: F.xxhash64(x)).alias("__hashes"), F.transform(F.filter("__lines", lambda x: x["chars"] > 0), lambda x: x["line"]).alias("__spoken"),
        F.transform("__lines", lambda x: F.struct(x["line"].alias("line"), x["chars"].alias("chars"), line_verdict(x, rules).alias("rule"))).alias("__judged"))
    cut = cut.withColumn("__keys", window_keys(F.col("__hashes")))
    cut = cut.withColumn("__placed", placed_windows(F.col("__keys"))).withColumn("__failed", F.filter("__judged", lambda x: x["rule"].isNotNull()))
    names = F.lit(["punctuation", "navigation", "boilerplate"])
    measured = cut.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"), count_of(F.col("__marks"), SYMBOLS).alias("n_symbols"),
        (F.size("__spoken") - F.size(F.array_distinct("__spoken"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words"), F.col("__placed")).alias("n_repeat_words"),
        F.aggregate("__failed", F.lit(0).cast("long"), lambda acc, x: acc + x["chars"]).alias("lost_chars"),
        F.map_from_arrays(names, F.transform(names, lambda name: F.size(F.filter("__failed", lambda x: x["rule"] == name)))).alias("failed_lines"),
        F.array_join(F.transform(F.filter("__judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("cleaned"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measured.withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (F.col("lost_chars") <= rules.lost_share * F.col("word_chars")))
    packed = judged.select(*keep, F.explode(F.array(F.struct(*made))).alias("__row"))
    return packed.select(*keep, *[F.col(f"__row.{c}").alias(c) for c in made])
