"""The query catalogue: one Spark builder per operator, (spark, sf_dir) -> DataFrame.

Queries over a cleaned table share one cleaned table per session (the
reference writes the cleaned table once and every report reads it); it is
written to the checkpoint folder, so reports read a materialized table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.operators import profile as P
from adloom.operators import reports as R
from adloom.operators.ordered import PLACE, rolling_days, sequence_ops
from adloom.operators.roles import (CAMPAIGN_COLUMNS, SPEND_COLUMNS, first_in_column_order,
                                    metric_keyword_columns, roles_frame)
from adloom.plans.pipeline import CleanOptions, CleanResult, clean_dataset
from adloom.plans.views import AD_ORDER, SALES_ORDER, source_state, view
from adloom.functions.exprs import pround, ref
from adloom.session import materialize_parts, stage_scope

_CACHE: dict = {}

ROW_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
SALES_NUMERIC = ["impressions", "clicks", "conversions", "spend", "price", "quantity",
                 "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"]


def cleaned(spark: SparkSession, sf_dir: str, name: str) -> CleanResult:
    """The cleaned table for a view, built once per session and state of the source files."""
    key = (spark.sparkContext.applicationId, name, source_state(spark, sf_dir, name))
    if key not in _CACHE:
        order = {"ad_facts": AD_ORDER}.get(name, SALES_ORDER)
        with stage_scope(spark) as stages:     # its stage tables go once the cleaned table is written
            res = clean_dataset(view(spark, sf_dir, name), CleanOptions(order_keys=[c for c in order if c != "date"]))
            stored = materialize_parts(res.parts or [res.df])
            if res.placed is not None:
                res.placed = stored
            res.df = stored.select(*map(ref, res.df.columns))
            stages.pop()                       # the cleaned table itself, the last one written
        _CACHE[key] = res
    return _CACHE[key]


def _in_order(res: CleanResult) -> tuple[DataFrame, list[str]]:
    """The cleaned table and the columns of its declared order: where it stores the place of each
    row in that order, the place alone, so that no report compares the keys again."""
    return (res.df, res.order_cols) if res.placed is None else (res.placed, [PLACE])


def _sales(spark, sf):
    return cleaned(spark, sf, "sales_facts").df


def _ads(spark, sf):
    return cleaned(spark, sf, "ad_facts").df


def _day(c="date"):
    return F.date_format(F.col(c), "yyyy-MM-dd")


def _r(c, n):
    return pround(F.col(c), n).alias(c)


def _trend(values, drop_null=()):
    """A sales series in date order, rows of a day in the declared order."""
    def run(spark, sf):
        res = cleaned(spark, sf, "sales_facts")
        df, order = _in_order(res)
        return R.trend(df, values(), list(drop_null), order_cols=order, n_rows=res.report["rows"])
    return run


def q_cumulative_totals(spark, sf):
    df = _sales(spark, sf)
    return df.select(*ROW_KEYS, "clicks_cumulative", "conversions_cumulative",
                     pround("spend_cumulative", 4).alias("spend_cumulative"))


def q_moving_averages(spark, sf):
    df = _sales(spark, sf)
    ma = [f"{c}_ma{k}" for c in ("revenue", "clicks", "conversions", "roas") for k in (3, 7)]
    return df.select(_day().alias("date_label"), "l_orderkey", "l_linenumber", *ma)


def q_channel_running(spark, sf):
    """W2 and W3 within each channel, a derived column."""
    res = cleaned(spark, sf, "sales_facts")
    df, order = _in_order(res)
    cols = list(dict.fromkeys(order + ROW_KEYS + ["channel", "revenue", "clicks"]))
    seq = sequence_ops(df.select(*cols), order, n_rows=res.report["rows"], cum_cols=["revenue", "clicks"],
                       roll_cols=["revenue", "clicks"], row_number_col="channel_row", partition_by=["channel"])
    return seq.select(*ROW_KEYS, "channel", "channel_row", _r("revenue_cumulative", 2), "clicks_cumulative",
                      *[_r(f"{c}_ma{k}", 4) for c in ("revenue", "clicks") for k in (3, 7)])


def q_moving_averages_by_day(spark, sf):
    """W2 over calendar days: the rows of the last 3 and 7 days, for all and by channel.

    Revenue in whole cents, whose sums are exact in any order."""
    cents = F.rint(F.col("revenue") * 100).cast("long")
    df = _sales(spark, sf).select(*ROW_KEYS, "date", "channel", cents.alias("cents"), "clicks", cents.alias("in_channel"))
    whole = rolling_days(df, "date", ["cents", "clicks"])
    both = rolling_days(whole, "date", ["in_channel"], partition_by=["channel"])
    return both.select(*ROW_KEYS, *[_r(f"{c}_ma{k}d", 3) for c in ("cents", "clicks", "in_channel") for k in (3, 7)])


def q_percentile_ranks(spark, sf):
    df = _sales(spark, sf)
    return df.select(*ROW_KEYS, *[f"{c}_percentile" for c in ("revenue", "clicks", "conversions", "roas")])


def q_zscores(spark, sf):
    df = _sales(spark, sf)
    return df.select(*ROW_KEYS, *[f"z_{c}" for c in SALES_NUMERIC], "is_outlier")


def q_flagged_rows(spark, sf):
    res = cleaned(spark, sf, "sales_facts")
    page, _ = R.flagged_rows(res.df, res.order_cols, 50)
    return page.select(_day().alias("date_label"), "campaign_name", "l_orderkey", "l_linenumber",
                       "is_suspicious_traffic", "is_ctr_anomaly", "is_outlier")


def q_flagged_total(spark, sf):
    res = cleaned(spark, sf, "sales_facts")
    return R.flagged_rows(res.df, res.order_cols, 50)[1]


def q_funnel_metrics(spark, sf):
    df = _sales(spark, sf)
    six = ["ctr", "conversion_rate", "roas", "cpa", "cpc", "cpm", "profit_margin"]
    return df.select(*ROW_KEYS, _r("revenue", 4), *[_r(c, 6) for c in six[:6]], _r("profit", 4),
                     _r("profit_margin", 6))


def q_temporal(spark, sf):
    return _sales(spark, sf).select(*ROW_KEYS, "day_of_week", "is_weekend", "month", "quarter",
                                    "week_number", "days_since_start")


def q_campaign(spark, sf):
    return _sales(spark, sf).select(*ROW_KEYS, "campaign_prefix", "is_retargeting", "channel")


def q_engagement_tiers(spark, sf):
    return _sales(spark, sf).select(*ROW_KEYS, "engagement_score", "spend_efficiency_tier")


def q_suspicious_by_channel(spark, sf):
    return (_sales(spark, sf).groupBy("channel")
            .agg(F.count_if("is_suspicious_traffic").alias("suspicious"),
                 F.count_if("is_ctr_anomaly").alias("ctr_anomalies"),
                 F.count_if("is_retargeting").alias("retargeting")))


def q_clicks_impressions_series(spark, sf):
    """T3 + W4: per-row series labelled by 0-based position in the declared order."""
    res = cleaned(spark, sf, "sales_facts")
    df, order = _in_order(res)
    return R.position_series(df, order, ["clicks", "impressions"], res.report["rows"])


def q_digest_sample(spark, sf):
    res = cleaned(spark, sf, "sales_facts")
    return R.digest_sample(res.df, res.order_cols).select(
        _day().alias("date_label"), "campaign_name", pround("revenue", 2).alias("revenue"),
        "clicks", "impressions", "conversions")


def q_page(spark, sf):
    res = cleaned(spark, sf, "sales_facts")
    pg = R.page(res.df, "revenue", False, 3, res.order_cols)
    return pg.select(*ROW_KEYS, pround("revenue", 2).alias("revenue"))


def q_deep_page(spark, sf):
    """A page far from the start, by its number; the least revenue last."""
    res = cleaned(spark, sf, "sales_facts")
    pages = R.Pages(res.df, "revenue", True, res.order_cols, n_rows=res.report["rows"], columns=[*ROW_KEYS, "revenue"])
    return pages.page(pages.count // 2).select(*ROW_KEYS, pround("revenue", 2).alias("revenue"))


def q_page_count(spark, sf):
    return R.page_count(_sales(spark, sf))


def q_top_days(k: int):
    def run(spark, sf):
        t = R.top_days(_sales(spark, sf), k, ascending=k == 10)
        return t if k == 5 else t.drop("pct_of_best")
    return run


# ---- dirty_orders: validation, profiling, cleaning ---------------------------
def _dirty(spark, sf):
    return view(spark, sf, "dirty_orders")


def _date_str(df: DataFrame, c: str = "o_orderdate") -> DataFrame:
    return df.withColumn(c, F.date_format(F.col(c), "yyyy-MM-dd"))


def q_dedup(spark, sf):
    return _date_str(_dirty(spark, sf).dropDuplicates())


def q_fill(numeric: str, categorical: str):
    def run(spark, sf):
        opts = CleanOptions(strategy_numeric=numeric, strategy_categorical=categorical,
                            blocks=frozenset(), checkpoint_base=False)
        res = clean_dataset(_dirty(spark, sf), opts)
        out = _date_str(res.df.select(*res.raw_columns))
        if numeric == "mean":
            out = out.withColumn("o_totalprice", pround("o_totalprice", 4))
        return out
    return run


def q_typed_orders(spark, sf):
    """C7 + C8 + F4-F6: a text date column is parsed, 'amount' becomes 'price'."""
    res = clean_dataset(view(spark, sf, "orders_text"),
                        CleanOptions(blocks=frozenset({"temporal"}), checkpoint_base=False))
    return res.df.select("o_orderkey", F.date_format("order_date", "yyyy-MM-dd").alias("order_day"),
                         "price", "day_of_week", "month", "is_weekend")


def q_dayfirst_orders(spark, sf):
    """A column of day-first dates is read day first throughout."""
    res = clean_dataset(view(spark, sf, "orders_dayfirst"),
                        CleanOptions(blocks=frozenset({"temporal"}), checkpoint_base=False))
    return res.df.select("o_orderkey", F.date_format("order_date", "yyyy-MM-dd").alias("order_day"), "month")


def q_overwrite_features(spark, sf):
    """Derived columns replace input columns of the same name."""
    df = cleaned(spark, sf, "sales_overwrite").df
    return df.select(*ROW_KEYS, _r("revenue", 4), _r("ctr", 6), "month", "quarter", _r("roas", 6), _r("profit", 4), "z_revenue", "z_ctr")


def q_overwrite_windows(spark, sf):
    """W1-W3 over replaced columns."""
    df = cleaned(spark, sf, "sales_overwrite").df
    return df.select(*ROW_KEYS, "revenue_percentile", "revenue_ma3", "revenue_ma7",
                     pround("revenue_cumulative", 2).alias("revenue_cumulative"))


def q_tiny_prices(spark, sf):
    """W3 on values far below one: digits are kept whatever the magnitude."""
    df = cleaned(spark, sf, "sales_tiny").df
    scaled = pround(F.col("revenue_cumulative") * F.lit(1e6), 2)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", scaled.alias("revenue_cumulative_e6"))


def q_rate_histogram(spark, sf):
    """A9 on rates of small denominators, where many values lie on bin edges."""
    return R.ctr_histogram(view(spark, sf, "small_rates"), {"ctr": "rate"})


def q_zero_gauge(spark, sf):
    """A conversion rate of 0 falls through to the ctr."""
    return R.gauge(view(spark, sf, "zero_rates"))


def q_long_search(spark, sf):
    """large doubles are searched by their digits."""
    return R.search(view(spark, sf, "large_numbers"), "00000.0").select("o_orderkey", "scaled")


def q_quality_score(spark, sf):
    """F23 over cells that stay empty after cleaning (dates are not invented)."""
    res = clean_dataset(view(spark, sf, "sparse_orders"), CleanOptions(blocks=frozenset({"quality"}), checkpoint_base=False))
    return res.df.select("o_orderkey", "data_quality_score")


def q_empty_column(spark, sf):
    """A column without any value is filled with 0 or Unknown."""
    res = clean_dataset(view(spark, sf, "empty_columns"), CleanOptions(blocks=frozenset(), checkpoint_base=False))
    return res.df.select("o_orderkey", "nothing", "no_text")


def q_keyword_columns(spark, sf):
    """C9 and C11 on the columns of the sales view."""
    df = view(spark, sf, "sales_facts")
    metrics, revenue = metric_keyword_columns(df.columns)
    found = [("metric", c) for c in metrics] + [("revenue", c) for c in revenue]
    found += [("spend", first_in_column_order(df.columns, SPEND_COLUMNS)),
              ("campaign", first_in_column_order(df.columns, CAMPAIGN_COLUMNS))]
    rows = spark.createDataFrame(found, "kind string, column string")
    return rows.crossJoin(df.agg(F.count(F.lit(1)).alias("rows")))


def q_roles(spark, sf):
    """Roles, their columns and labels, and how many cells each column holds."""
    df = _sales(spark, sf)
    held = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "cells")
    return roles_frame(spark, df).join(held, "column", "left")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ad_channel_revenue": lambda s, sf: R.channel_revenue(_ads(s, sf)),
    "ad_kpi_totals": lambda s, sf: R.kpi_totals(_ads(s, sf)),
    "ad_tier_distribution": lambda s, sf: R.tier_distribution(_ads(s, sf)),
    "kpi_totals": lambda s, sf: R.kpi_totals(_sales(s, sf)),
    "tier_distribution": lambda s, sf: R.tier_distribution(_sales(s, sf)),
    "revenue_by_date": lambda s, sf: R.revenue_by_date(_sales(s, sf)),
    "revenue_by_weekday": lambda s, sf: R.revenue_by_weekday(_sales(s, sf)),
    "funnel": lambda s, sf: R.funnel(_sales(s, sf)),
    "monthly_revenue": lambda s, sf: R.monthly_revenue(_sales(s, sf)),
    "ctr_histogram": lambda s, sf: R.ctr_histogram(_sales(s, sf)),
    "engagement_histogram": lambda s, sf: R.engagement_histogram(_sales(s, sf)),
    "channel_revenue": lambda s, sf: R.channel_revenue(_sales(s, sf)),
    "advanced_kpis": lambda s, sf: R.advanced_kpis(_sales(s, sf)),
    "summary": lambda s, sf: R.summary(_sales(s, sf)),
    "gauge": lambda s, sf: R.gauge(_sales(s, sf)),
    "anomaly_total": lambda s, sf: R.anomaly_total(_sales(s, sf)),
    "digest": lambda s, sf: R.digest(_sales(s, sf), SALES_NUMERIC),
    "digest_sample": q_digest_sample,
    "top10_days": q_top_days(10),
    "top5_days": q_top_days(5),
    "roas_trend": _trend(lambda: [pround("roas", 4).alias("roas"), F.col("roas_ma3")], ["roas"]),
    "profit_trend": _trend(lambda: [pround(F.col("profit_margin") * 100, 2).alias("profit_margin_pct")]),
    "cumulative_revenue": _trend(lambda: [pround("revenue_cumulative", 2).alias("revenue_cumulative")]),
    "cumulative_totals": q_cumulative_totals,
    "moving_averages": q_moving_averages,
    "channel_running": q_channel_running,
    "moving_averages_by_day": q_moving_averages_by_day,
    "percentile_ranks": q_percentile_ranks,
    "zscores": q_zscores,
    "flagged_rows": q_flagged_rows,
    "flagged_total": q_flagged_total,
    "funnel_metrics": q_funnel_metrics,
    "temporal_features": q_temporal,
    "campaign_parse": q_campaign,
    "engagement_tiers": q_engagement_tiers,
    "suspicious_by_channel": q_suspicious_by_channel,
    "page_by_revenue": q_page,
    "page_count": q_page_count,
    "deep_page": q_deep_page,
    "revenue_trend": _trend(lambda: [pround("revenue", 2).alias("revenue")]),
    "clicks_impressions_series": q_clicks_impressions_series,
    "dataset_summary": lambda s, sf: P.dataset_summary(_dirty(s, sf)),
    "null_columns": lambda s, sf: P.null_columns(_dirty(s, sf)),
    "typed_orders": q_typed_orders,
    "dedup": q_dedup,
    "duplicate_rate": lambda s, sf: P.duplicate_rate(_dirty(s, sf)),
    "fill_zero_mode": q_fill("zero", "mode"),
    "fill_mean_constant": q_fill("mean", "constant"),
    "profile": lambda s, sf: P.column_profile(_dirty(s, sf)),
    "top_values": lambda s, sf: P.top_values(_dirty(s, sf), 3),
    "quality_snapshot": lambda s, sf: P.quality_snapshot(_dirty(s, sf)),
    "outliers": lambda s, sf: P.outlier_summary(view(s, sf, "sales_facts")),
    "change_report": lambda s, sf: P.change_report(_dirty(s, sf)),
    "dayfirst_orders": q_dayfirst_orders,
    "overwrite_features": q_overwrite_features,
    "overwrite_windows": q_overwrite_windows,
    "tiny_prices": q_tiny_prices,
    "rate_histogram": q_rate_histogram,
    "zero_gauge": q_zero_gauge,
    "large_number_search": q_long_search,
    "quality_score": q_quality_score,
    "empty_columns": q_empty_column,
    "keyword_columns": q_keyword_columns,
    "roles": q_roles,
    "validation_report": lambda s, sf: P.validation_report(view(s, sf, "odd_orders")),
    "search_urgent": lambda s, sf: _date_str(R.search(_dirty(s, sf), "urgent")),
}
