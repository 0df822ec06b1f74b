"""Reports over a cleaned table.

Each report is an aggregate or a bounded ordered read pushed into the scan of
the cleaned table; column roles come from the schema only (no job).  Results
are small DataFrames.  Per-row series (trends) stay distributed; only the
paging / top-k reports carry a limit, and the limit is the feature.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions import exprs as X
from adloom.functions.exprs import ref
from adloom.operators.clean import date_layouts
from adloom.operators.ordered import BUCKET, OrderConfig, n_buckets, sequence_ops
from adloom.operators.roles import detect_roles
from adloom.session import materialize

# ---- fixed values: columns hidden from the flagged-row table, flag columns ------
DISPLAY_SKIP_PREFIXES = ("z_",)
DISPLAY_SKIP_SUFFIXES = ("_cumulative", "_ma3", "_ma7", "_percentile")
FLAG_COLUMNS = ["is_suspicious_traffic", "is_ctr_anomaly", "is_outlier"]


def _roles(df: DataFrame, roles: dict | None) -> dict:
    return roles if roles is not None else detect_roles(df.schema)


def _empty(df: DataFrame, schema: str) -> DataFrame:
    """What a report on a table without its roles gives: no rows, the usual columns."""
    return df.sparkSession.createDataFrame([], schema)


def _dated(df: DataFrame, d: str) -> DataFrame:
    """``df`` with a date column that is text read by the layout that fits most cells."""
    if not isinstance(df.schema[d].dataType, T.StringType):
        return df
    layouts = date_layouts(F.col(d))
    found = df.agg(*[F.count(e).alias(f"n{i}") for i, e in enumerate(layouts)]).first()
    return df.withColumn(d, layouts[max(range(len(layouts)), key=lambda i: (found[i], -i))])


def _ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` (a small aggregate) in a declared order, with its 1-based place."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order))).orderBy(name)


def _day(c: str) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd")


def _scaled_mean(c: str) -> Column:
    """Mean of a rate column, times 100 when it is below 1."""
    m = F.avg(F.col(c))
    return F.round(F.when(m < 1, m * 100).otherwise(m), 2)


# ---- A1-A4 ----------------------------------------------------------------
def kpi_totals(df: DataFrame, roles: dict | None = None) -> DataFrame:
    r = _roles(df, roles)
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    if "revenue" in r:
        aggs += [F.round(F.sum(r["revenue"]), 2).alias("total_revenue"),
                 F.round(F.avg(r["revenue"]), 2).alias("avg_revenue")]
    if "clicks" in r:
        aggs.append(F.sum(r["clicks"]).cast("long").alias("total_clicks"))
    if "impressions" in r:
        aggs.append(F.sum(r["impressions"]).cast("long").alias("total_impressions"))
    if "ctr" in r:
        aggs.append(_scaled_mean(r["ctr"]).alias("avg_ctr"))
    if "conversions" in r:
        aggs.append(F.sum(r["conversions"]).cast("long").alias("total_conversions"))
    if "conversion_rate" in df.columns:
        aggs.append(F.round(F.avg("conversion_rate") * 100, 2).alias("avg_conversion_rate"))
    return df.agg(*aggs)


# ---- A5-A8 ----------------------------------------------------------------
def revenue_by_date(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """A5: revenue per day, in date order."""
    r = _roles(df, roles)
    d, v = r.get("date"), r.get("revenue")
    if not d or not v:
        return _empty(df, "date_label string, revenue double, day_rank int")
    df = _dated(df, d)
    daily = (df.where(F.col(d).isNotNull()).groupBy(_day(d).alias("date_label"))
             .agg(F.round(F.sum(v), 2).alias("revenue")))
    return _ranked(daily, "day_rank", "date_label")


def revenue_by_weekday(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """Fixed Monday..Sunday domain (7-row broadcast table), missing -> 0."""
    r = _roles(df, roles)
    d, v = r.get("date"), r.get("revenue")
    if not d or not v:
        return _empty(df, "weekday_order int, weekday string, revenue double")
    df = _dated(df, d)
    spark = df.sparkSession
    domain = spark.createDataFrame(list(enumerate(X.WEEKDAYS, start=1)), "weekday_order int, weekday string")
    sums = (df.where(F.col(d).isNotNull()).groupBy(X.day_name(d).alias("weekday"))
            .agg(F.sum(v).alias("_rev")))
    return (F.broadcast(domain).join(sums, "weekday", "left")
            .select("weekday_order", "weekday", F.round(F.coalesce("_rev", F.lit(0.0)), 2).alias("revenue")))


def funnel(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """Stage totals as rows."""
    r = _roles(df, roles)
    stages = [s for s in ("impressions", "clicks", "conversions") if s in r]
    if not stages:
        return _empty(df, "stage string, value long")
    one = df.agg(*[F.sum(r[s]).cast("long").alias(s) for s in stages])
    return one.unpivot([], stages, "stage", "value")


def monthly_revenue(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """Revenue (and clicks) per month, in time order."""
    r = _roles(df, roles)
    d, v = r.get("date"), r.get("revenue")
    if not d or not v:
        return _empty(df, "month_label string, month_start string, revenue double, month_rank int")
    df = _dated(df, d)
    aggs = [F.round(F.sum(v), 2).alias("revenue")]
    if "clicks" in r:
        aggs.append(F.sum(r["clicks"]).cast("long").alias("clicks"))
    g = (df.where(F.col(d).isNotNull())
         .groupBy(F.date_format(F.date_trunc("month", F.col(d)), "yyyy-MM").alias("month_start"))
         .agg(*aggs))
    label = F.date_format(F.to_date(F.concat(F.col("month_start"), F.lit("-01"))), "MMM yyyy")
    return _ranked(g.select(label.alias("month_label"), *g.columns), "month_rank", "month_start")


# ---- A9, A10 histograms ----------------------------------------------------
def ctr_histogram(df: DataFrame, roles: dict | None = None, bins: int = 20) -> DataFrame:
    """Equal-width bins between the least and the greatest rate, the last one closed.

    A value belongs to the bin whose edges hold it, as they are in floating point."""
    r = _roles(df, roles)
    c = r.get("ctr")
    mm = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first() if c else None
    if mm is None or mm["lo"] is None:
        return _empty(df, "bin int, label string, count long")
    scale = 100.0 if mm["hi"] < 1 else 1.0
    lo, hi = float(mm["lo"]) * scale, float(mm["hi"]) * scale
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    edges = np.linspace(lo, hi, bins + 1).tolist()
    value = F.col(c) * F.lit(scale)
    inner = sum(((value >= F.lit(e)).cast("int") for e in edges[1:-1]), F.lit(0))
    counts = df.where(F.col(c).isNotNull()).groupBy(inner.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    labels = [(i, f"{edges[i]:.1f}-{edges[i + 1]:.1f}") for i in range(bins)]
    dom = df.sparkSession.createDataFrame(labels, "bin int, label string")
    return (F.broadcast(dom).join(counts, "bin", "left")
            .select("bin", "label", F.coalesce("_n", F.lit(0)).cast("long").alias("count")))


def engagement_histogram(df: DataFrame) -> DataFrame:
    if "engagement_score" not in df.columns:
        return _empty(df, "bin int, label string, count long")
    spark = df.sparkSession
    width = 10.0
    v = F.col("engagement_score")
    b = F.least(F.floor(v / F.lit(width)).cast("int"), F.lit(9))
    counts = (df.where(v.isNotNull() & (v >= 0) & (v <= 100)).groupBy(b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("count")))
    dom = spark.createDataFrame([(i, f"{i * 10}-{i * 10 + 10}") for i in range(10)], "bin int, label string")
    return (F.broadcast(dom).join(counts, "bin", "left")
            .select("bin", "label", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


# ---- A11-A20 ---------------------------------------------------------------
def channel_revenue(df: DataFrame) -> DataFrame:
    """Revenue per channel, greatest first (ties by name)."""
    if not {"channel", "revenue"} <= set(df.columns):
        return _empty(df, "channel string, revenue double, channel_rank int")
    sums = df.groupBy("channel").agg(F.round(F.sum("revenue"), 2).alias("revenue"))
    return _ranked(sums, "channel_rank", F.desc("revenue"), "channel")


def tier_distribution(df: DataFrame) -> DataFrame:
    if "spend_efficiency_tier" not in df.columns:
        return _empty(df, "tier_order int, tier string, count long")
    dom = df.sparkSession.createDataFrame(list(enumerate(X.TIER_LABELS, start=1)), "tier_order int, tier string")
    counts = (df.where(F.col("spend_efficiency_tier").isNotNull())
              .groupBy(F.col("spend_efficiency_tier").alias("tier")).agg(F.count(F.lit(1)).alias("_n")))
    return (F.broadcast(dom).join(counts, "tier", "left")
            .select("tier_order", "tier", F.coalesce("_n", F.lit(0)).cast("long").alias("count")))


# ---- fixed values: columns that make a table an "advanced" one ------------------
ADVANCED_COLUMNS = ["roas", "cpa", "cpc", "cpm", "profit_margin", "engagement_score",
                    "is_suspicious_traffic", "is_outlier", "is_retargeting", "channel",
                    "spend_efficiency_tier", "day_of_week"]


def advanced_kpis(df: DataFrame) -> DataFrame:
    cols = set(df.columns)
    aggs = []
    for c in ("roas", "cpa", "cpc", "cpm"):
        if c in cols:
            aggs.append(F.round(F.avg(c), 4).alias(f"avg_{c}"))
    if "profit_margin" in cols:
        aggs.append(F.round(F.avg("profit_margin") * 100, 2).alias("avg_profit_margin"))
    if "engagement_score" in cols:
        aggs.append(F.round(F.avg("engagement_score"), 4).alias("avg_engagement_score"))
    for c, name in (("is_suspicious_traffic", "bot_traffic_count"), ("is_ctr_anomaly", "ctr_anomaly_count"),
                    ("is_outlier", "outlier_count"), ("is_retargeting", "retargeting_count")):
        if c in cols:
            aggs.append(F.count_if(F.col(c)).cast("long").alias(name))
    if "profit" in cols:
        aggs.append(F.round(F.sum("profit"), 2).alias("total_profit"))
    existing = [c for c in ADVANCED_COLUMNS if c in cols]
    aggs.append(F.lit(len(existing) > 0).alias("has_advanced"))
    aggs.append(F.lit(",".join(existing)).alias("available_columns"))
    return df.agg(*aggs)


def summary(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """A14-A17 in one aggregate."""
    r = _roles(df, roles)
    rev, d, clk, imp, conv, ctr = (r.get(k) for k in ("revenue", "date", "clicks", "impressions",
                                                       "conversions", "ctr"))
    aggs = []
    if rev and clk:
        aggs.append(F.round(F.sum(rev) / F.greatest(F.sum(clk), F.lit(1)), 2).alias("revenue_per_click"))
    if rev and d:
        dt = df.schema[d].dataType
        span = F.floor((F.max(X.epoch_micros(d, dt)) - F.min(X.epoch_micros(d, dt))) / F.lit(86_400_000_000))
        aggs.append(F.when(F.count(d) > 0, F.round(F.sum(rev) / F.greatest(span, F.lit(1)), 2))
                    .alias("avg_daily_revenue"))
    if ctr:
        aggs.append(_scaled_mean(ctr).alias("click_through_rate"))
    elif imp and clk:
        aggs.append(F.round(F.sum(clk) / F.greatest(F.sum(imp), F.lit(1)) * 100, 2).alias("click_through_rate"))
    if conv and clk:
        aggs.append(F.round(F.sum(conv) / F.greatest(F.sum(clk), F.lit(1)) * 100, 2).alias("avg_conversion_rate"))
    return df.agg(*aggs)


def gauge(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """Average conversion rate in %, else (none or 0) average ctr, else 0."""
    r = _roles(df, roles)
    rates = []
    if "conversion_rate" in df.columns:
        rates.append(F.round(F.avg("conversion_rate") * 100, 2))
    if "ctr" in r:
        rates.append(_scaled_mean(r["ctr"]))
    rate = F.coalesce(*[F.nullif(x.cast("double"), F.lit(0.0)) for x in rates], F.lit(0.0))
    g = df.agg(rate.alias("rate"))
    return g.select("rate", F.greatest(F.lit(100.0) - F.col("rate"), F.lit(0.0)).alias("remaining"))


def anomaly_total(df: DataFrame) -> DataFrame:
    """Sum of the three flag counts (a row with two flags counts twice)."""
    flags = [c for c in ("is_suspicious_traffic", "is_ctr_anomaly", "is_outlier") if c in df.columns]
    tot = F.lit(0)
    for c in flags:
        tot = tot + F.count_if(F.col(c))
    return df.agg(tot.cast("long").alias("anomaly_total"))


def digest(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Per numeric column min/max/mean/std (2 dp), long form."""
    aggs = []
    for c in numeric:
        aggs += [F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"),
                 F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                         F.round(F.col(f"{c}__min"), 2).alias("min"),
                                         F.round(F.col(f"{c}__max"), 2).alias("max"),
                                         F.round(F.col(f"{c}__mean"), 2).alias("mean"),
                                         F.round(F.col(f"{c}__std"), 2).alias("std")) for c in numeric]))
    return wide.select(stack.alias("s")).select("s.*")


def digest_text(df: DataFrame, name: str = "table", roles: dict | None = None) -> DataFrame:
    """One text column with the facts a report writer gets, in one aggregate: size,
    columns, statistics of each numeric column, key totals and averages, date range.
    (The sample rows are :func:`digest_sample`.)"""
    r = _roles(df, roles)
    fixed = lambda x: F.format_string("%.2f", x.cast("double"))
    whole = lambda x: F.format_number(x.cast("long"), 0)
    lines = [F.lit(f"Dataset: {name}"), F.concat(F.lit("Total Records: "), F.count(F.lit(1)).cast("string")),
             F.lit("Columns: " + ", ".join(df.columns))]
    for f in df.schema.fields:
        if X.is_numeric_type(f.dataType):
            c = F.col(f.name)
            lines.append(F.concat(F.lit(f"{f.name}: min="), fixed(F.min(c)), F.lit(", max="), fixed(F.max(c)), F.lit(", mean="),
                                  fixed(F.avg(c)), F.lit(", std="), F.coalesce(fixed(F.stddev_samp(c)), F.lit("nan"))))
    for c, label in (("clicks", "Total Clicks"), ("impressions", "Total Impressions"), ("conversions", "Total Conversions")):
        if c in df.columns:
            lines.append(F.concat(F.lit(f"{label}: "), whole(F.sum(c))))
    if "revenue" in df.columns:
        lines += [F.concat(F.lit("Total Revenue: $"), F.format_number(F.sum("revenue"), 2)),
                  F.concat(F.lit("Avg Revenue per Record: $"), F.format_number(F.avg("revenue"), 2))]
    for c, label in (("ctr", "Average CTR"), ("conversion_rate", "Avg Conversion Rate")):
        if c in df.columns:
            lines.append(F.concat(F.lit(f"{label}: "), fixed(F.avg(c) * 100), F.lit("%")))
    if "date" in r and not isinstance(df.schema[r["date"]].dataType, T.StringType):
        lines.append(F.concat(F.lit("Date Range: "), F.min(_day(r["date"])), F.lit(" to "), F.max(_day(r["date"]))))
    return df.agg(F.concat_ws("\n", *lines).alias("digest"))


def digest_sample(df: DataFrame, order_cols: list[str], k: int = 5) -> DataFrame:
    """The first ``k`` rows in the declared order (per-task top-k, no global sort)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order_cols]).limit(k)


# ---- T1-T10 ----------------------------------------------------------------
def top_days(df: DataFrame, k: int, roles: dict | None = None, ascending: bool = False) -> DataFrame:
    """K best days by revenue, ties keep the earliest date; pct of the best.

    ``row_index`` is the place in the output: best day last (``ascending``) or first."""
    r = _roles(df, roles)
    d, v = r.get("date"), r.get("revenue")
    if not d or not v:
        return _empty(df, "date_label string, revenue double, pct_of_best double, row_index int")
    df = _dated(df, d)
    daily = (df.where(F.col(d).isNotNull()).groupBy(_day(d).alias("date_label")).agg(F.sum(v).alias("_v")))
    top = daily.orderBy(F.desc("_v"), F.asc("date_label")).limit(k)
    best = F.max("_v").over(Window.partitionBy())  # over <= k rows
    place = Window.orderBy(F.asc("_v") if ascending else F.desc("_v"), F.desc("date_label") if ascending else F.asc("date_label"))
    return top.select("date_label", F.round("_v", 2).alias("revenue"),
                      F.round(F.col("_v") / F.nullif(best, F.lit(0.0)) * 100, 1).alias("pct_of_best"),
                      (F.row_number().over(place) - 1).alias("row_index")).orderBy("row_index")


def trend(df: DataFrame, value_cols: list[Column], drop_null: list[str], roles: dict | None = None,
          order_cols: list[str] | None = None, n_rows: int | None = None) -> DataFrame:
    """Per-row series in date order (null dates dropped), with ``row_index``.

    Rows of one date follow ``order_cols`` (default: all other columns).  Places come from
    range partitions (operators/ordered.py), not from one task.  Without a date column
    the series is labelled by position, in the order of ``order_cols``."""
    d = _roles(df, roles).get("date")
    if d:
        df = _dated(df, d)
        drop_null = [d, *drop_null]
    keep = df.na.drop(subset=drop_null) if drop_null else df
    order = [c for c in ([d] if d else []) + list(order_cols or df.columns)]
    keys = [F.col(c).alias(f"__o{i}") for i, c in enumerate(dict.fromkeys(order))]
    label = [_day(d).alias("date_label")] if d else []
    narrow = keep.select(*keys, *label, *value_cols)
    seq = sequence_ops(narrow, [f"__o{i}" for i in range(len(keys))], n_rows=n_rows or keep.count(), row_number_col="__rn")
    return seq.select((F.col("__rn") - 1).alias("row_index"), *[c for c in narrow.columns if not c.startswith("__o")]) \
        .orderBy("row_index")


def position_series(df: DataFrame, order_cols: list[str], value_cols: list[str], n_rows: int) -> DataFrame:
    """Values labelled 0..n-1 by position in the declared order (the
    global row number comes from the distributed sequencing, not one task)."""
    seq = sequence_ops(df.select(*dict.fromkeys(order_cols + value_cols)), order_cols, n_rows=n_rows,
                       row_number_col="_rn")
    return seq.select((F.col("_rn") - 1).alias("row_index"), *value_cols)


def flagged_rows(df: DataFrame, order_cols: list[str], limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """rows with any flag, first ``limit`` in the declared order, display columns only."""
    flags = [c for c in FLAG_COLUMNS if c in df.columns]
    cond = F.lit(False)
    for c in flags:
        cond = cond | F.col(c)
    flagged = df.where(cond)
    display = [c for c in df.columns if not c.startswith(DISPLAY_SKIP_PREFIXES)
               and not c.endswith(DISPLAY_SKIP_SUFFIXES)]
    page = flagged.orderBy(*[F.col(c).asc_nulls_last() for c in order_cols]).limit(limit).select(*display)
    total = flagged.agg(F.count(F.lit(1)).alias("total_flagged"))
    return page, total


def _cell_text(c: str, dt: T.DataType) -> Column:
    """A cell as a reader sees it: numbers of usual size without an exponent."""
    text = F.col(c).cast("string")
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        size = F.abs(F.col(c).cast("double"))
        plain = F.regexp_replace(text.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
        text = F.when(text.contains("E") & (size >= 1e-4) & (size < 1e16), plain).otherwise(text)
    return text


def search(df: DataFrame, query: str) -> DataFrame:
    """case-insensitive substring over all cells as text (nulls never match)."""
    q = query.lower()
    cells = [F.coalesce(F.lower(_cell_text(f.name, f.dataType)).contains(q), F.lit(False)) for f in df.schema.fields]
    cond = cells[0]
    for c in cells[1:]:
        cond = cond | c
    return df.where(cond)


def _sort_keys(df: DataFrame, sort_col: str, tie_cols: list[str]) -> list[tuple]:
    """(column of the key, key of a value, from empty) of a sorted page, the sort column first.

    Text sorts by the Unicode collation (a A b e-acute Z), an empty cell as an empty text;
    texts that collate alike by their characters.  Then come the declared ties."""
    keys = []
    if isinstance(df.schema[sort_col].dataType, T.StringType):
        blank = lambda c: F.coalesce(c, F.lit(""))
        keys += [(lambda c: F.collate(blank(c), "UNICODE"), sort_col, True), (blank, sort_col, True)]
    else:
        keys.append((lambda c: c, sort_col, True))
    return keys + [(lambda c: c, c, False) for c in tie_cols if c != sort_col]


def page_order(df: DataFrame, sort_col: str, ascending: bool, tie_cols: list[str]) -> list[Column]:
    """Empty cells first, or last if descending; ties by ``tie_cols``, ascending, nulls last."""
    out = []
    for key, c, sorted_ in _sort_keys(df, sort_col, tie_cols):
        e = key(ref(c))
        out.append(e.asc_nulls_last() if not sorted_ else e.asc_nulls_first() if ascending else e.desc_nulls_last())
    return out


def page(df: DataFrame, sort_col: str, ascending: bool, page_no: int, tie_cols: list[str],
         page_size: int = 50) -> DataFrame:
    """Sorted page n (1-based); ties broken by ``tie_cols`` for a stable order.

    For the first pages; ``Pages`` gives any page by number."""
    return df.orderBy(*page_order(df, sort_col, ascending, tie_cols)).offset((page_no - 1) * page_size).limit(page_size)


def page_after(df: DataFrame, sort_col: str, ascending: bool, tie_cols: list[str], last: dict,
               page_size: int = 50) -> DataFrame:
    """T10 for deep pages: the rows after the last row of the page before (its values of the
    order columns in ``last``).  No rows before it are carried, however deep the page."""
    beyond, same = F.lit(False), F.lit(True)
    for key, c, sorted_ in _sort_keys(df, sort_col, tie_cols):
        e, v = key(ref(c)), key(F.lit(last[c]).cast(df.schema[c].dataType))
        up, empty_first = ascending or not sorted_, sorted_ and ascending
        further = (e > v) if up else (e < v)
        if empty_first:
            further = F.when(v.isNull(), e.isNotNull()).otherwise(F.coalesce(further, F.lit(False)))
        else:
            further = F.when(v.isNull(), F.lit(False)).otherwise(F.coalesce(further, F.lit(True)))
        beyond = beyond | (same & further)
        same = same & e.eqNullSafe(v)
    return df.where(beyond).orderBy(*page_order(df, sort_col, ascending, tie_cols)).limit(page_size)


class Pages:
    """Any page of a sorted table by its number.

    The table is range-partitioned once in its order and written, a folder per bucket; the
    fences (rows and first key of each bucket, at most ``MOST_BUCKETS`` of them) say which
    buckets hold a page, so that only these are read, and no task gets the rows before it.
    ``columns`` (default: all) are those a page shows: only they and the columns of the order
    are shuffled and stored."""

    def __init__(self, df: DataFrame, sort_col: str, ascending: bool, tie_cols: list[str], page_size: int = 50,
                 cfg: OrderConfig | None = None, n_rows: int | None = None, columns: list[str] | None = None):
        self.size, self._order = page_size, page_order(df, sort_col, ascending, tie_cols)
        n = df.count() if n_rows is None else n_rows
        self._columns = df.columns if columns is None else list(columns)
        kept = df.select(*[ref(c) for c in dict.fromkeys([*self._columns, sort_col, *tie_cols])])
        buckets = kept.repartitionByRange(n_buckets(n, cfg or OrderConfig()), *self._order).withColumn(BUCKET, F.spark_partition_id())
        self._table = materialize(buckets, "pages", by=BUCKET)
        self.fences = materialize(self._table.groupBy(BUCKET).agg(
            F.count(F.lit(1)).alias("rows"), (F.min(ref(sort_col)) if ascending else F.max(ref(sort_col))).alias("first")), "fences")
        self._starts, self.rows = [], 0
        for r in sorted(self.fences.select(BUCKET, "rows").collect()):
            self._starts.append((self.rows, r[BUCKET], r["rows"]))
            self.rows += r["rows"]

    @property
    def count(self) -> int:
        return max(1, -(-self.rows // self.size))

    def buckets_of(self, page_no: int) -> list[int]:
        at = (page_no - 1) * self.size
        return [b for start, b, n in self._starts if start < at + self.size and at < start + n]

    def page(self, page_no: int) -> DataFrame:
        """Page ``page_no`` (from 1); beyond the last one: no rows."""
        found = self.buckets_of(page_no)
        start = min((s for s, b, _ in self._starts if b in found), default=0)
        part = self._table.where(F.col(BUCKET).isin(found) if found else F.lit(False)).select(*map(ref, self._columns))
        return part.orderBy(*self._order).offset(max(0, (page_no - 1) * self.size - start) if found else 0).limit(self.size)


def search_pages(df: DataFrame, query: str, sort_col: str, ascending: bool, tie_cols: list[str], page_size: int = 50) -> Pages:
    """F28 + T9 + T10: the rows that match, in the chosen sort, by page number; ``rows`` and ``count`` beside them."""
    return Pages(search(df, query), sort_col, ascending, tie_cols, page_size)


def page_count(df: DataFrame, page_size: int = 50) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(page_size)), F.lit(1)).cast("long").alias("pages"))
