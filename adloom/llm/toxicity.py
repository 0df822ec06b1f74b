"""Operator 10: a counterfactual-regularised toxicity classifier.

Features are the words (letter runs, lower-cased) that a text holds, and the first five
letters of the longer ones, which inflected and compound forms share.  Spark counts them
by label over the training rows and keeps the informative ones; a logistic regression is
then fitted in numpy on at most ``max_rows`` labelled rows (the documented bound; rows
are chosen by a hash of their id).  Besides log loss and an L2 term the loss holds a
counterfactual term: each training text with an identity term is paired with the same
text whose term is swapped for another of its group, and the squared change of the score
is penalised, so that a neutral mention of a group does not raise a score.

Only the text is an input of a score.  Scoring is one pass without shuffle.

Defined results: null and empty texts have no words and get the intercept's score; labels
that are null take no part; repeated labels count each; without both classes among the
training rows every score is the (smoothed) share of label 1.  Clashing columns do not
matter: only doc_id, text and toxic are read, and ``score_texts`` refuses to overwrite.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.llm.common import small_slices

WORD = re.compile(r"[^\W\d_]+")
#: Groups of identity terms that may stand for each other in a sentence (lower-cased words);
#: the default of ``groups`` in train_toxicity.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


def swaps_of(groups: Iterable[Iterable[str]]) -> dict[str, list[str]]:
    """term -> the terms that may stand for it, of all groups that hold it."""
    out: dict[str, list[str]] = {}
    for g in groups:
        terms = list(dict.fromkeys(t.lower() for t in g))
        if bad := [t for t in terms if not WORD.fullmatch(t)]:
            raise ValueError(f"identity terms must be single words: {bad}")
        for t in terms:
            known = out.setdefault(t, [])
            known.extend(x for x in terms if x != t and x not in known)
    return out


SWAPS = swaps_of(IDENTITY_GROUPS)


def word_features(words: set[str]) -> set[str]:
    return words | {w[:5] + "*" for w in words if len(w) > 5}


def text_features(text: str | None) -> set[str]:
    return word_features(set(WORD.findall((text or "").lower())))


@dataclass
class ToxicityModel:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        found = text_features(text)
        z = self.bias + sum(self.weights[w] for w in sorted(w for w in found if w in self.weights))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_words(docs: DataFrame, labels: DataFrame, max_rows: int, seed: int) -> DataFrame:
    """(doc_id, toxic, words) of at most ``max_rows`` labelled rows that are not held out."""
    chosen = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter(F.col("__id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("__id"))) \
        .orderBy(F.xxhash64(F.lit(seed), "__id"), "__id", "toxic").limit(max_rows)
    # at most max_rows narrow rows: broadcast, so that texts stay where they are
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))

    def words(batches: Iterator[pa.RecordBatch]):
        for b in small_slices(batches):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id").cast(pa.int64()), "toxic": b.column("toxic"),
                "words": pa.array([sorted(text_features(t)) for t in texts], pa.list_(pa.string()))})

    return rows.select("doc_id", "toxic", "text").mapInArrow(words, "doc_id long, toxic int, words array<string>")


def informative_words(rows: DataFrame, n_pos: int, n_neg: int, max_words: int, least_docs: int, least_chi2: float,
                      terms: Iterable[str] = tuple(SWAPS)) -> list[str]:
    """Words whose presence depends on the label (chi-square), and the identity terms seen."""
    n = float(n_pos + n_neg)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    off = a * (n_neg - b) - b * (n_pos - a)
    chi2 = n * off * off / ((a + b) * (n - a - b + 1e-9) * n_pos * n_neg)
    counts = rows.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    top = counts.withColumn("chi2", chi2).filter((a + b >= least_docs) & (F.col("chi2") >= least_chi2)) \
        .orderBy(F.col("chi2").desc(), "w").limit(max_words).select("w")
    named = counts.filter(F.col("w").isin(sorted(word_features(set(terms))))).select("w")
    return sorted({r["w"] for r in top.collect()} | {r["w"] for r in named.collect()})


def fit_logistic(x: list[list[int]], y: np.ndarray, flips: list[tuple[list[int], list[int]]], n_words: int,
                 l2: float, fairness: float, steps: int = 300, rate: float = 0.1) -> tuple[float, np.ndarray]:
    """Adam on mean log loss + l2 |w|^2 / 2 + fairness * mean (w . (x' - x))^2 / 2.

    ``flips``: for each counterfactual pair the features that leave and those that enter."""
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.fromiter((c for r in x for c in r), dtype=np.int64, count=len(rows))
    f_rows = np.repeat(np.arange(len(flips)), [len(a) + len(b) for a, b in flips])
    f_cols = np.fromiter((c for a, b in flips for c in (*a, *b)), dtype=np.int64, count=len(f_rows))
    f_sign = np.fromiter((s for a, b in flips for s in (*[-1.0] * len(a), *[1.0] * len(b))), dtype=float, count=len(f_rows))
    w, bias = np.zeros(n_words), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m = np.zeros(n_words + 1)
    v = np.zeros(n_words + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(rows, w[cols], len(x))
        d = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
        g = np.bincount(cols, d[rows], n_words) + l2 * w
        if len(flips):
            change = np.bincount(f_rows, f_sign * w[f_cols], len(flips)) / len(flips)
            g += fairness * np.bincount(f_cols, f_sign * change[f_rows], n_words)
        grad = np.append(g, d.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return bias, w


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_words: int = 4096,
                   least_docs: int = 3, least_chi2: float = 12.0, l2: float = 1e-4, fairness: float = 1.0,
                   seed: int = 7, groups: Iterable[Iterable[str]] = IDENTITY_GROUPS) -> ToxicityModel:
    """The model of the labelled rows.  ``groups``: the identity terms of the corpus, each group
    holding words that may stand for each other; without any in the training texts the
    counterfactual term is 0 and the model a plain logistic regression."""
    from adloom.session import materialize
    swaps = swaps_of(groups)
    rows = materialize(training_words(docs, labels, max_rows, seed), "toxicity")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        share = (n_pos + 0.5) / (n_pos + n_neg + 1.0)
        return ToxicityModel(bias=float(np.log(share / (1 - share))) if n_pos + n_neg else -5.0)
    words = informative_words(rows, n_pos, n_neg, max_words, least_docs, least_chi2, swaps)
    at = {w: i for i, w in enumerate(words)}
    keep = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    kept = rows.select("doc_id", "toxic", F.array_intersect("words", keep).alias("words")) \
        .orderBy("doc_id", "toxic").collect()   # at most max_rows short rows
    x = [sorted(at[w] for w in r["words"]) for r in kept]
    y = np.array([float(r["toxic"]) for r in kept])
    flips = []
    for k, r in enumerate(kept):
        for term in r["words"]:
            others = [o for o in swaps.get(term, ()) if o not in r["words"]]
            if others:
                other = others[k % len(others)]
                leave, enter = word_features({term}), word_features({other})
                flips.append(([at[w] for w in sorted(leave) if w in at], [at[w] for w in sorted(enter) if w in at]))
    bias, w = fit_logistic(x, y, flips, len(words), l2, fairness)
    return ToxicityModel(bias, {t: float(v) for t, v in zip(words, w)})


def score_texts(docs: DataFrame, model: ToxicityModel, carry: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The ``carry`` columns of each row and the score of its ``text``."""
    if name in carry:
        raise ValueError(f"column {name!r} is there already")
    fields = [docs.schema[c] for c in carry]
    schema = T.StructType([*fields, T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)   # at most max_words weights

    def score(batches):
        m = sent.value
        for b in small_slices(batches):
            columns = {c: b.column(i) for i, c in enumerate(carry)}
            columns[name] = pa.array([m.score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    at = carry.index("text") if "text" in carry else len(carry)      # a carried text is sent once
    return docs.select(*carry, *([] if "text" in carry else [F.col("text").alias("__text")])).mapInArrow(score, schema)
