"""Globally ordered operators (W1-W5) that never funnel a large table into one task.

``Window.orderBy(...)`` without a partition key moves every row to a single
partition.  The operators here keep the same results but split the work:

* **Sequencing.**  The table is range-partitioned on the declared total order
  (``repartitionByRange`` samples the keys, so a hot date is spread over many
  buckets as long as the later order keys differ) and sorted there once; the
  bucket id (``spark_partition_id()``) and the row's place are fixed by a
  reliable checkpoint, so every later job sees the same buckets and orders by
  one number.  A row number alone follows from the places without a window.
* **Slices.**  A shuffle lies on the disks until it is read.  Beyond ``OrderConfig.cells_per_range``
  the order is cut into slices that are shuffled and written one after the other.
* **Prefix sums (W3).**  Per-bucket totals (one row per bucket) give each
  bucket an offset; a window *partitioned by bucket* adds the offset to the
  running sum.  Integers add up in 64 bits, other numbers as doubles, whatever
  their magnitude; infinities stay.
* **Groups.**  With ``partition_by`` the range runs over (groups, order); totals and halos
  stop at a group's border, and only a group that goes on from an earlier bucket carries
  anything: at most one carry per bucket.
* **Rolling days.**  Calendar frames run over sums by (group, day), see ``rolling_days``.
* **Rolling rows (W2).**  The last ``k-1`` rows before each bucket (its *halo*)
  are found by their places (a filter, tiny shuffle) and unioned into that
  bucket; the sliding frame then sees its true predecessors and the halo rows
  are dropped afterwards.
* **Average rank (W1) and quantiles (F25/W5, medians).**  One table of
  (column, value, count, rows below) serves all columns: ``groupBy`` collapses
  hot values map-side and running totals come from range partitions.  A
  percentile is rounded to four digits, so it takes at most 10,001 values and
  grows with the value: the least value of each step is all a row needs, looked
  up by binary search in the row's own task.  The wide frame is not shuffled.

There is one code path for every size; a small table is one slice and one bucket.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions.exprs import pround, ref
from adloom.session import brief_shuffles, materialize, materialize_parts

BUCKET = "_seq_b"
PLACE = "_seq_p"
HALO = "_seq_halo"


@dataclass
class OrderConfig:
    """Sizing of the distributed ordered operators."""
    rows_per_bucket: int = 50_000      # target rows handled by one window task
    # rows times columns that are shuffled at a time, as a shuffle lies on the disks until it is read:
    cells_per_range: int = 2_000_000_000    # by the range shuffle; a slice costs two scans of its input
    cells_per_part: int = 800_000_000       # by the windows of a part of a cleaned table, by dropping copies


#: A table of more buckets than ``MANY_BUCKETS`` gets larger ones first, up to ``GROWN`` times the
#: target: the blocks of a shuffle are map tasks times buckets, and both grow with the table.
MANY_BUCKETS, GROWN = 240, 5

#: More range partitions than this slow the driver; beyond it they grow.
MOST_BUCKETS = 20_000


#: Tables by (group, day) of at most this many rows are broadcast.
FEW_ROWS = 500_000


def n_buckets(n_rows: int, cfg: OrderConfig) -> int:
    wanted = math.ceil(n_rows / cfg.rows_per_bucket)
    return min(MOST_BUCKETS, max(1, min(wanted, MANY_BUCKETS), math.ceil(wanted / GROWN)))


def n_parts(n_rows: int, n_columns: int, cells: int) -> int:
    return max(1, math.ceil(n_rows * n_columns / cells))


def sort_orders(order_cols: list[str]) -> list[Column]:
    return [ref(c).asc_nulls_last() for c in order_cols]


#: Keys drawn for each slice to find its border; as in a range partitioning, they decide how
#: even the slices are, never which rows there are.
DRAWN_PER_SLICE = 1000


def order_slices(df: DataFrame, order_cols: list[str], k: int, n_rows: int) -> list[DataFrame]:
    """``df`` cut into at most ``k`` slices that follow one another in the order (ascending, nulls last).

    A slice holds the rows from its border up to the next one, so every row is in exactly one."""
    if k == 1:
        return [df]
    order, names = sort_orders(order_cols), [f"_k{i}" for i in range(len(order_cols))]
    drawn = df.select(*map(ref, order_cols)).sample(min(1.0, DRAWN_PER_SLICE * k / max(1, n_rows)), seed=7)
    tiles = drawn.withColumn("_tile", F.ntile(k).over(Window.orderBy(*order)))      # of some thousand keys
    first = F.row_number().over(Window.partitionBy("_tile").orderBy(*order))
    with brief_shuffles(df.sparkSession):
        borders = materialize(tiles.withColumn("_first", first).where("_first = 1 AND _tile > 1")
                              .select("_tile", *[ref(c).alias(x) for c, x in zip(order_cols, names)]), "borders")
    at = sorted(r["_tile"] for r in borders.select("_tile").collect())
    reached = _reached(order_cols, names)

    def slice_of(lower: int | None, upper: int | None) -> DataFrame:
        out = df
        for tile, inside in ((lower, reached), (upper, ~reached)):
            if tile is not None:
                out = out.join(F.broadcast(borders.where(F.col("_tile") == tile)), inside).select(*map(ref, df.columns))
        return out

    return [slice_of(a, b) for a, b in zip([None, *at], [*at, None])]


def _reached(order_cols: list[str], border: list[str]) -> Column:
    """Whether a row is at the border or after it, nulls last."""
    out = F.lit(True)
    for c, b in reversed(list(zip(order_cols, border))):
        after = F.when(F.col(b).isNull(), F.lit(False)).otherwise(F.coalesce(ref(c) > F.col(b), F.lit(True)))
        out = after | (ref(c).eqNullSafe(F.col(b)) & out)
    return out


def _is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def _sum_expr(c: str, dt: T.DataType) -> Column:
    return ref(c).cast("long" if _is_integral(dt) else "double")


def _finish_sum(e: Column, dt: T.DataType) -> Column:
    return e.cast("long") if _is_integral(dt) else e.cast("double")


def sequence_ops(df: DataFrame, order_cols: list[str], *, n_rows: int,
                 cum_cols: list[str] = (), roll_cols: list[str] = (),
                 windows: tuple[int, ...] = (3, 7), row_number_col: str | None = None,
                 cfg: OrderConfig | None = None, cum_names: dict | None = None,
                 partition_by: list[str] = (), place_col: str | None = None, bucket_col: str | None = None,
                 derived: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums (``<c>_cumulative``), trailing row averages
    (``<c>_ma<k>``) and optionally a 1-based row number, all in the
    declared order ``order_cols`` (ascending, nulls last), within the groups of
    ``partition_by`` (any columns of ``df``; null is a group) or over the whole table.
    ``place_col`` adds a number that grows with the order (with gaps): once stored, a later
    step sorts by it alone.  ``bucket_col`` adds the bucket, 0 and up in the order: a filter on it
    reaches the stage table.  ``derived``: columns that follow from those of ``df``, and are
    as good as its own but for the order; they are made after the shuffle.

    Semantics: a null value gets a null running sum but the sum continues;
    rolling means ignore nulls inside the frame (min_periods = 1).
    """
    cfg = cfg or OrderConfig()
    groups = list(partition_by)
    cum_names, derived = cum_names or {}, derived or {}
    order_cols = [c for c in order_cols if c not in groups]
    order = sort_orders(order_cols)
    keys = [ref(g) for g in groups]

    # 1. Range-partition on (groups, total order), sort once and pin bucket ids and places: a
    #    group with a third of the rows spreads over a third of the buckets.  Places grow with the
    #    order over all buckets, without gaps inside one, so that no later step compares the keys.
    #    What is derived is made after the shuffle.  A very large table is shuffled slice by slice.
    slices = order_slices(df, groups + order_cols, n_parts(n_rows, len(df.columns), cfg.cells_per_range), n_rows)
    nb = math.ceil(n_buckets(n_rows, cfg) / len(slices))
    plain = list(dict.fromkeys([*df.columns, *derived]))

    def placed(rows: DataFrame, start: int) -> DataFrame:
        return rows.repartitionByRange(nb, *sort_orders(groups), *order) \
            .sortWithinPartitions(*sort_orders(groups), *order) \
            .withColumns({**derived, BUCKET: F.spark_partition_id() + F.lit(start),
                          PLACE: F.monotonically_increasing_id() + F.lit(start << 33)})

    staged = materialize_parts((placed(rows, i * nb) for i, rows in enumerate(slices)), "sequenced")
    types = {f.name: f.dataType for f in staged.schema.fields}

    # 2. Totals of each (bucket, group).  A group that goes on in a bucket carries the totals
    #    of its earlier buckets; only the first group of a bucket can, so there is at most one
    #    carry per bucket.
    tot = [F.count(F.lit(1)).alias("_cnt"), F.max(PLACE).alias("_last")]
    tot += [F.sum(_sum_expr(c, types[c])).alias(f"_tot{i}") for i, c in enumerate(cum_cols)]
    stats = staged.groupBy(BUCKET, *keys).agg(*tot)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    named = [ref(g).alias(f"_g{k}") for k, g in enumerate(groups)]
    carries = stats.select(F.col(BUCKET).alias("_b"), *named, F.sum("_cnt").over(before).alias("_off"),
                           *[F.coalesce(F.sum(f"_tot{i}").over(before), F.lit(0)).alias(f"_ooff{i}") for i in range(len(cum_cols))]) \
        .filter("_off > 0")
    with brief_shuffles(df.sparkSession):
        carries = F.broadcast(materialize(carries, "carries"))     # at most MOST_BUCKETS rows

    def same_group(row: DataFrame | None = None):
        out = F.lit(True)
        for k, g in enumerate(groups):
            out = out & ref(g).eqNullSafe(F.col(f"_g{k}"))
        return out

    if row_number_col and not (groups or cum_cols or roll_cols):
        # the low 33 bits of a place count the rows of its bucket from 0: no window, no shuffle
        rn = F.coalesce(F.col("_off"), F.lit(0)) + F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(1)
        return staged.join(carries, F.col(BUCKET) == F.col("_b"), "left") \
            .select(*[ref(c) for c in plain], rn.cast("long").alias(row_number_col), *([F.col(PLACE).alias(place_col)] if place_col else []),
                    *([F.col(BUCKET).alias(bucket_col)] if bucket_col else []))

    body = staged.withColumn(HALO, F.lit(False))
    h = max(windows) - 1 if roll_cols else 0
    if h > 0:
        # 3. Halo: the h rows of a group just before a bucket that goes on with it.  Each
        #    bucket's last h rows of the group (by their places: a filter, no sort) contain
        #    every such row, even when buckets are tiny or empty.
        keep = list(dict.fromkeys(groups + list(roll_cols)))
        # ranks in the group, from its start: rows up to the end of the bucket less the rows after it there
        ends = stats.select(F.col(BUCKET).alias("_b"), "_last", *named, F.sum("_cnt").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("_end"))
        last = F.broadcast(ends.join(carries.select(*[F.col(f"_g{k}").alias(f"_h{k}") for k in range(len(groups))],
                                                    *([] if groups else [F.lit(1).alias("_one")])).distinct(),
                                     _pairs("_g", "_h", len(groups)), "left_semi"))   # groups of several buckets only
        near = (F.col(BUCKET) == F.col("_b")) & same_group() & (F.col(PLACE) > F.col("_last") - F.lit(h))
        placed = staged.select(BUCKET, PLACE, *[ref(c) for c in keep]).join(last, near).drop("_b", *[f"_g{k}" for k in range(len(groups))]) \
            .withColumn("_pos", F.col("_end") - (F.col("_last") - F.col(PLACE)))
        starts = carries.select(F.col("_b").alias("_tb"), *[f"_g{k}" for k in range(len(groups))], (F.col("_off") + 1).alias("_start"))
        halo = (placed.withColumn("_q", F.explode(F.sequence(F.col("_pos") + 1, F.col("_pos") + h)))
                .join(F.broadcast(starts), (F.col("_q") == F.col("_start")) & same_group())
                .select(F.col("_tb").alias(BUCKET), PLACE, *[ref(c) for c in keep])
                .withColumn(HALO, F.lit(True)))
        body = body.unionByName(halo, allowMissingColumns=True)

    # 4. One window pass per (bucket, group); what is carried is looked up after its shuffle.
    w = Window.partitionBy(BUCKET, *keys).orderBy(PLACE)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    real = ~F.col(HALO)
    own = [F.sum(F.when(real, _sum_expr(c, types[c]))).over(run).alias(f"_part{i}") for i, c in enumerate(cum_cols)]
    # Trailing means over at most k values: plain double averages (a sliding frame
    # re-aggregates its rows for every output row, so the cheap type matters; k <= 7
    # values cannot drift).
    means = {f"{c}_ma{k}": F.avg(ref(c).cast("double")).over(w.rowsBetween(-(k - 1), Window.currentRow)) for c in roll_cols for k in windows}
    own += [e.alias(f"_mean{i}") for i, e in enumerate(means.values())]
    if row_number_col:
        own.append(F.sum(F.when(real, F.lit(1)).otherwise(F.lit(0))).over(run).alias("_nth"))
    body = body.select(*map(ref, dict.fromkeys([BUCKET, PLACE, HALO, *plain])), *own).filter(real) \
        .join(carries, (F.col(BUCKET) == F.col("_b")) & same_group(), "left")
    cols = [ref(c) for c in plain]
    for i, c in enumerate(cum_cols):
        total = F.coalesce(F.col(f"_ooff{i}"), F.lit(0)) + F.coalesce(F.col(f"_part{i}"), F.lit(0))
        cols.append(F.when(ref(c).isNotNull(), _finish_sum(total, types[c])).alias(cum_names.get(c, f"{c}_cumulative")))
    cols += [F.col(f"_mean{i}").alias(name) for i, name in enumerate(means)]
    if row_number_col:
        cols.append((F.coalesce(F.col("_off"), F.lit(0)) + F.col("_nth")).cast("long").alias(row_number_col))
    if place_col:
        cols.append(F.col(PLACE).alias(place_col))
    if bucket_col:
        cols.append(F.col(BUCKET).alias(bucket_col))
    return body.select(*cols)


def _pairs(a: str, b: str, n: int) -> Column:
    out = F.lit(True)
    for k in range(n):
        out = out & F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}"))
    return out


def rolling_days(df: DataFrame, date_col: str, cols: list[str], windows: tuple[int, ...] = (3, 7),
                 partition_by: list[str] = ()) -> DataFrame:
    """Add ``<c>_ma<k>d``: the mean of the rows of the last k calendar days, the row's own
    day included, within the groups of ``partition_by``.

    Days without rows count as days; all rows of a day have the same mean; nulls are
    ignored; a row without a date gets none.  Rows are summed up by (group, day) before any
    shuffle, so a hot day is one row per task, and the frames run over days, of which a
    group has no more than the calendar; the means are then joined back by (group, day)."""
    day = F.unix_date(F.to_date(ref(date_col)))
    keys = [ref(g).alias(f"__g{k}") for k, g in enumerate(partition_by)]
    sums = [x for i, c in enumerate(cols) for x in (F.sum(ref(c).cast("double")).alias(f"__s{i}"), F.count(ref(c)).alias(f"__n{i}"))]
    days = df.groupBy(*keys, day.alias("__day")).agg(*sums).filter("__day IS NOT NULL")
    names = [f"__g{k}" for k in range(len(keys))]
    frame = Window.partitionBy(*names).orderBy("__day")
    means = [F.try_divide(F.sum(f"__s{i}").over(frame.rangeBetween(-(k - 1), 0)), F.sum(f"__n{i}").over(frame.rangeBetween(-(k - 1), 0)))
             .alias(f"{c}_ma{k}d") for i, c in enumerate(cols) for k in windows]
    with brief_shuffles(df.sparkSession):
        table = materialize(days.select(*names, "__day", *means), "days")
    if table.count() <= FEW_ROWS:          # then the rows stay where they are
        table = F.broadcast(table)
    same = day == F.col("__day")
    for k, g in enumerate(partition_by):
        same = same & ref(g).eqNullSafe(F.col(f"__g{k}"))
    return df.join(table, same, "left").drop("__day", *names)


def running_total(df: DataFrame, groups: list[str], order: list[str], value: str,
                  out: str, partitions: int | None = None) -> DataFrame:
    """``out`` = sum of ``value`` over the earlier rows of the group (exclusive).

    Rows are range-partitioned by (groups, order), so that a group with a third of all
    rows spreads over a third of the partitions, and written once, which freezes the
    partition ids.  Each partition's total for a group is then one row; offsets come from
    a window over those few rows, local sums from a window inside (partition, group).
    ``order`` should determine the order of rows within a group.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = materialize(df.repartitionByRange(n, *groups, *order)
                         .withColumn("__part", F.spark_partition_id()), "ranged")
    sums = staged.groupBy("__part", *groups).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("__part").alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in groups],
                          F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    local = Window.partitionBy("__part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return staged.join(offsets, same) \
        .withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(local), F.lit(0))) \
        .drop("__part", "__p", "__before", *[f"__g_{g}" for g in groups])


# ---------------------------------------------------------------------------
# Ranks of values: average rank percentile (W1), exact quantiles (F25), medians
# ---------------------------------------------------------------------------

def rank_table(df: DataFrame, cols: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, target, value, cnt, before) for the distinct non-null values of numeric columns:
    how often a value occurs and how many smaller ones there are, for each group of the
    columns ``by``.  Written once."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("target"), ref(c).cast("double").alias("value"))
                                for c in cols])).alias("cell")
    counts = df.select(*by, cells).select(*by, "cell.target", "cell.value").where(F.col("value").isNotNull()) \
        .groupBy(*by, "target", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return materialize(running_total(counts, [*by, "target"], ["value"], "cnt", "before"), "ranks")


def percentile_steps(table: DataFrame, sizes: dict[str, int]) -> dict[str, list[tuple[float, float]]]:
    """Per column the steps (least value, percentile), ascending; at most 10,001 each.

    ``rank(pct=True)`` with average ties, rounded to 4 places, times 100."""
    n = F.create_map(*[F.lit(x) for c, k in sizes.items() for x in (c, float(k))]) if sizes else F.lit(None)
    pct = pround((F.col("before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)) / n[F.col("target")], 4) * F.lit(100.0)
    steps: dict[str, list[tuple[float, float]]] = {c: [] for c in sizes}
    if sizes:
        rows = table.where(F.col("target").isin(list(sizes))).groupBy("target", pct.alias("pct")) \
            .agg(F.min("value").alias("least")).collect()
        for r in rows:
            steps[r["target"]].append((r["least"], r["pct"]))
    return {c: sorted(s) for c, s in steps.items()}


def attach_percentiles(df: DataFrame, steps: dict[str, list[tuple[float, float]]], names: dict[str, str]) -> DataFrame:
    """Add ``names[c]``: the percentile of each value of column ``c``, null for null."""
    plain = list(df.columns)
    searched = {c: s for c, s in steps.items() if len([e for e, _ in s if e != math.inf]) > 1}
    if searched:
        splits = [[-math.inf, *[e for e, _ in s[1:] if e != math.inf], math.inf] for s in searched.values()]
        df = Bucketizer(splitsArray=splits, inputCols=list(searched), outputCols=[f"__b_{c}" for c in searched],
                        handleInvalid="keep").transform(df)
    out = []
    for c, s in steps.items():
        e = F.lit(None).cast("double")
        if s:
            finite = [p for least, p in s if least != math.inf] or [s[-1][1]]
            # one foldable text instead of thousands of literals in the plan
            table = F.from_json(F.lit(json.dumps(finite)), "array<double>")
            e = F.element_at(table, F.col(f"__b_{c}").cast("int") + 1) if c in searched else F.lit(finite[0])
            e = F.when(ref(c).cast("double") == math.inf, F.lit(s[-1][1])).when(ref(c).isNotNull(), e)
        out.append(e.alias(names[c]))
    return df.select(*map(ref, plain), *out)


def _lerp(a: float, b: float, t: float) -> float:
    # numpy's linear interpolation, including its t >= 0.5 branch
    d = b - a
    return b - d * (1 - t) if t >= 0.5 else a + d * t


def exact_quantiles(table: DataFrame, sizes: dict[str, int], qs: list[float]) -> dict[str, list[float]]:
    """Linear-interpolated quantiles (numpy 'linear') of columns in a rank table.

    One job; only the <= 2 * len(qs) order statistics of each column are fetched."""
    places = {c: [(math.floor((n - 1) * q), min(math.floor((n - 1) * q) + 1, n - 1), (n - 1) * q - math.floor((n - 1) * q))
                  for q in qs] for c, n in sizes.items() if n > 0}
    if not places:
        return {}
    wanted = {c: sorted({p for lo, hi, _ in ps for p in (lo, hi)}) for c, ps in places.items()}
    arrays = F.create_map(*[x for c, ps in wanted.items()
                            for x in (F.lit(c), F.array(*[F.lit(p).cast("long") for p in ps]))])
    hit = F.exists(arrays[F.col("target")], lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("cnt")))
    rows = table.where(F.col("target").isin(list(wanted)) & hit).collect()
    at = {(r["target"], p): r["value"] for r in rows for p in wanted[r["target"]]
          if r["before"] <= p < r["before"] + r["cnt"]}
    return {c: [_lerp(at[c, lo], at[c, hi], g) for lo, hi, g in ps] for c, ps in places.items()}
