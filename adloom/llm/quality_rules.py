"""Operator 1: quality rules.

A threshold table of length, symbol, stop-word and line rules is compiled into one Spark
projection; no user function runs.  ``THRESHOLDS`` is data: each row names a metric and
the closed range it must lie in.  Metrics are ordinary columns over the whole text.

Defined results: a null or empty text has no words, hence all counts 0, ``base_failed``
true and ``kept`` false.  A text of any length is judged whole, in its row's memory.  Stop words are found whatever their case (A-Z) and the punctuation
around them.  Repeated rows are judged row by row; an empty table gives an
empty result.  Only ``doc_id`` and ``text`` are read, so columns of the same names as the
metrics cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import SPACE_CHARS, let, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages (English, French, German, Spanish).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "for", "with", "on",
    "le", "la", "de", "et", "les", "des", "que", "un", "une", "qui",
    "der", "die", "das", "und", "von", "den", "ist", "ein", "zu", "nicht",
    "el", "los", "las", "en", "y", "por", "del", "se", "con", "una",
)
#: What a word loses at both ends, and the case it is read in, before it is looked up there.
EDGE = """.,;:!?"'()[]{}<>*_-#"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Threshold:
    """``low <= metric <= high``; None leaves a side open."""
    rule: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Ratios are per word or per line; the base rule (50 words, half repeated) comes apart.
THRESHOLDS: tuple[Threshold, ...] = (
    Threshold("length", "mean_word_chars", 2.0, 12.0),
    Threshold("symbol", "symbols_per_word", None, 0.1),
    Threshold("symbol", "exclamations_per_word", None, 0.3),
    Threshold("stop_word", "stop_word_share", 0.02, None),
    Threshold("line", "dup_line_share", None, 0.5),
)


def _count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window whose three words occur again in the text.

    Hashes of all windows are sorted first; equal windows have equal hashes, so a text
    without equal hashes has no repeat.  Otherwise the windows with a hash seen twice are
    compared by their words."""
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        again = F.filter(at, lambda k: F.coalesce(F.get(s, k - 1)["w"] == F.get(s, k)["w"], F.lit(False))
                         | F.coalesce(F.get(s, k + 1)["w"] == F.get(s, k)["w"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(again, lambda k: F.array(
            F.get(s, k)["i"], F.get(s, k)["i"] + 1, F.get(s, k)["i"] + 2)))))

    def by_twice(h: Column, twice: Column) -> Column:
        # few hashes: look each window's hash up; many: compare all windows
        picked = F.when(F.size(twice) <= 64, F.filter(starts, lambda i: F.array_contains(twice, F.get(h, i)))) \
                  .otherwise(starts)
        windows = F.sort_array(F.transform(picked, lambda i: F.struct(
            F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))
        return F.when(F.size(twice) == 0, F.lit(0)).otherwise(let(windows, covered))

    def by_hashes(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(
            F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1) == x, F.lit(False)))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(twice, lambda t: by_twice(h, t)))

    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, by_hashes)).cast("long")


def _line_counts(text: Column) -> Column:
    """(lines with a word, those equal to an earlier line)."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id and all metrics of each row, as plain columns."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def is_stop(w: Column) -> Column:
        return F.btrim(F.translate(w, UPPER, LOWER), F.lit(EDGE)).isin(*STOP_WORDS)

    def by_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"),
                        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        F.size(F.filter(w, is_stop)).cast("long").alias("n_stop_words"))

    flat = docs.select("doc_id", text.alias("__t")).select(
        "doc_id",
        let(words_of(F.col("__t")), by_words).alias("__w"),
        _line_counts(F.col("__t")).alias("__l"),
        sum((_count_char(F.col("__t"), c) for c in SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        _count_char(F.col("__t"), "!").cast("long").alias("n_exclamations"))
    one = F.greatest(F.col("__w.n_words"), F.lit(1))
    return flat.select(
        "doc_id", "__w.n_words", "__w.word_chars", "n_symbols", F.col("__l.dup").alias("n_dup_lines"),
        "__w.n_repeat_words", (F.col("__w.word_chars") / one).alias("mean_word_chars"),
        (F.col("n_symbols") / one).alias("symbols_per_word"),
        (F.col("n_exclamations") / one).alias("exclamations_per_word"),
        (F.col("__w.n_stop_words") / one).alias("stop_word_share"),
        (F.col("__l.dup") / F.greatest(F.col("__l.lines"), F.lit(1))).alias("dup_line_share"))


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """Array of the names of the rules that a row breaks."""
    broken = []
    for t in thresholds:
        inside = F.lit(True)
        if t.low is not None:
            inside = inside & (F.col(t.metric) >= t.low)
        if t.high is not None:
            inside = inside & (F.col(t.metric) <= t.high)
        broken.append(F.when(~inside, F.lit(f"{t.rule}:{t.metric}")))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """Metrics, ``base_failed``, ``kept`` and the broken rules of each row of ``docs``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = base_metrics(docs).withColumn("base_failed", base).withColumn("broken", compile_rules(thresholds))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
