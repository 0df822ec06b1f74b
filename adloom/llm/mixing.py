"""Operator 5: mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target of words (weights, capped at ``cap`` times the source's size,
the excess reshared by weight).  floor(target / size) complete epochs come first; the
rest of the target is a weighted sample without replacement: documents of a source are
sorted by an exponential key, -ln(u) / quality, where u is a hash of the document and
the seed, and taken while the prefix sum of sizes stays within the budget.

``last="cut"`` takes just the words that still fit from the document at the border, so
that a source's words equal its rounded target.  ``last="nearest"`` takes whole documents
only and keeps the border document if that comes nearer to the target.

Only (row, size, key) rows are shuffled, never texts.  A source with a third of all rows
spreads over range partitions (common.running_total).  Sources are configuration: one row
each, at most ``max_sources`` of them, checked, go through the driver.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of
its own, last in order; repeated rows are documents of their own (ties of the key break
by document id, then size, and equal rows share a total so that reruns agree); a source
of size 0 has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.llm.common import running_total, words_of
from adloom.session import materialize


def cycle_weights(n: int) -> list[float]:
    return [float(i % 3 + 1) for i in range(n)]


def fill_targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Share sum(sizes) by weight, none above ``cap`` times its size."""
    total, targets = float(sum(sizes)), [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    while open_:
        share = total / math.fsum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * share > cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = weights[i] * share
            break
        for i in full:
            targets[i] = cap * sizes[i]
        total -= cap * sum(sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def text_quality(text: Column) -> Column:
    """Share of the characters that are not symbols, between 0.1 and 1."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), 1 - symbols / F.greatest(F.length(t), F.lit(1)))


def source_targets(sized: DataFrame, weights=cycle_weights, cap: float = 3.0, max_sources: int = 100_000) -> list:
    """(source, size, target) rows; sources by code point, null last."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources: group them first")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "")))
    sizes = [int(r["size"]) for r in rows]
    targets = fill_targets(sizes, weights(len(rows)), cap)
    return [(r["source"], s, t) for r, s, t in zip(rows, sizes, targets)]


def mix_sources(docs: DataFrame, weights=cycle_weights, cap: float = 3.0, seed: int = 17,
                quality=text_quality, last: str = "cut", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), and the ``carry`` columns."""
    spark = docs.sparkSession
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))),
                F.lit(2**53)) + F.lit(1)) / F.lit(float(2**53 + 1))
    sized = materialize(docs.select(
        "doc_id", "source", *carry, F.size(words_of(F.col("text"))).cast("long").alias("size"),
        (-F.log(u) / quality(F.col("text"))).alias("key")), "mix")
    targets = source_targets(sized, weights, cap)
    plan = spark.createDataFrame(
        [(s, z, float(t), int(t // z) if z else 0) for s, z, t in targets],
        T.StructType([T.StructField("__source", T.StringType()),
                      T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
                      T.StructField("epochs", T.LongType())]))
    before = running_total(sized, ["source"], ["key", "doc_id", "size", *carry], "size", "before")
    rows = before.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rest = F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    left = F.greatest(F.lit(0), rest - F.col("before"))
    if last == "cut":
        part = F.least(F.col("size"), left)
    else:
        part = F.when((left >= F.col("size")) | (2 * left >= F.col("size")) & (left > 0), F.col("size")).otherwise(0)
    return rows.select("doc_id", "source", *carry, "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
