"""Feature engineering (F1-F25): a planner that reads the schema plus one-row
statistics and returns column expressions.  Every block fires only when its
input columns exist; nothing is dropped."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions import exprs as X
from adloom.operators.roles import (CAMPAIGN_COLUMNS, SPEND_COLUMNS,
                                    first_in_column_order)

TEMPORAL_NAMES = ["day_of_week", "is_weekend", "month", "quarter", "week_number", "days_since_start"]
ENGAGEMENT_PARTS = ["ctr", "conversion_rate", "roas"]


class Columns(OrderedDict):
    """name -> Column, replacing in place like ``withColumn``; ``replaced`` remembers what was."""

    def __init__(self, items=()):
        self.replaced: set[str] = set()
        super().__init__(items)

    def __setitem__(self, name, value):
        if name in self:
            self.replaced.add(name)
        super().__setitem__(name, value)

    def frame(self, df: DataFrame) -> DataFrame:
        return df.select(*[e.alias(n) for n, e in self.items()])


def base_columns(df: DataFrame) -> Columns:
    return Columns((c, X.ref(c)) for c in df.columns)


def add_funnel_basics(cols: Columns) -> None:
    """F1-F3."""
    if "price" in cols and "quantity" in cols:
        cols["revenue"] = F.col("price") * F.col("quantity")
    if "clicks" in cols and "impressions" in cols:
        cols["ctr"] = X.ratio("clicks", "impressions")
    if "conversions" in cols and "clicks" in cols:
        cols["conversion_rate"] = X.ratio("conversions", "clicks")


def add_temporal(cols: Columns, dt_col: str, dt_type: T.DataType, min_micros: int | None) -> None:
    """F4-F9 from the first date/time column."""
    d = X.ref(dt_col)
    cols["day_of_week"] = X.day_name(d)
    cols["is_weekend"] = X.is_weekend(d)
    cols["month"] = X.year_month(d)
    cols["quarter"] = X.quarter_label(d)
    cols["week_number"] = X.iso_week(d)
    if min_micros is None:
        cols["days_since_start"] = F.lit(None).cast("long")
    else:
        cols["days_since_start"] = X.days_between(d, min_micros, dt_type)


def spend_column(columns: list[str]) -> str | None:
    return first_in_column_order(columns, SPEND_COLUMNS)


def campaign_column(columns: list[str]) -> str | None:
    return first_in_column_order(columns, CAMPAIGN_COLUMNS)


def add_efficiency(cols: Columns, spend: str | None) -> None:
    """F10-F15 (roas, cpa, cpc, cpm, profit, profit_margin)."""
    if not spend:
        return
    s = X.ref(spend)
    if "revenue" in cols:
        cols["roas"] = X.ratio(cols["revenue"], s)
    if "conversions" in cols:
        cols["cpa"] = X.ratio(s, "conversions")
    if "clicks" in cols:
        cols["cpc"] = X.ratio(s, "clicks")
    if "impressions" in cols:
        cols["cpm"] = X.ratio(s, "impressions") * F.lit(1000.0)
    if "revenue" in cols:
        profit = cols["revenue"] - s
        cols["profit"] = profit
        cols["profit_margin"] = X.ratio(profit, cols["revenue"])


def add_flags(cols: Columns) -> None:
    """F16, F17."""
    if "clicks" in cols and "conversions" in cols:
        cols["is_suspicious_traffic"] = X.suspicious_traffic("clicks", "conversions")
    if "clicks" in cols and "impressions" in cols:
        cols["is_ctr_anomaly"] = X.ctr_anomaly("clicks", "impressions")


def add_zscores(cols: Columns, zstats: dict) -> list[str]:
    """F18, F19.  ``zstats``: column -> (mean, std) for eligible columns."""
    names = []
    for c, (mean, std) in zstats.items():
        z = f"z_{c}"
        cols[z] = X.pround((X.ref(c).cast("double") - F.lit(mean)) / F.lit(std), 4)
        names.append(z)
    if names:
        absz = [F.abs(X.ref(n)) for n in names]
        top = absz[0] if len(absz) == 1 else F.greatest(*absz)
        cols["is_outlier"] = F.coalesce(top > 3, F.lit(False))
    return names


def tier_expr(roas: Column, edges: list[float]) -> Column:
    """right-closed quartile bins, the lowest edge included."""
    labels = X.TIER_LABELS
    e = F.when(roas.isNull(), F.lit(None).cast("string"))
    for i, label in enumerate(labels):
        e = e.when(roas <= F.lit(edges[i + 1]), F.lit(label))
    return e


def add_engagement(cols: Columns, minmax: dict) -> None:
    """mean of min-max normalised ctr / conversion_rate / roas, 0-100.

    ``minmax``: column -> (min, max), numbers or columns."""
    parts = [p for p in ENGAGEMENT_PARTS if p in cols]
    if len(parts) < 2:
        return
    terms = []
    for p in parts:
        lo, hi = minmax.get(p, (None, None))
        if isinstance(lo, Column):
            terms.append(F.when(hi - lo == 0, F.when(lo.isNotNull(), F.lit(0.5))).otherwise((X.ref(p) - lo) / (hi - lo)))
        elif lo is None or hi is None:
            terms.append(F.lit(None).cast("double"))
        elif hi - lo == 0:
            terms.append(F.lit(0.5))
        else:
            terms.append((X.ref(p) - F.lit(lo)) / F.lit(hi - lo))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    cols["engagement_score"] = X.pround(total / F.lit(float(len(parts))) * F.lit(100.0), 2)


def add_campaign(cols: Columns, camp: str | None) -> None:
    """F20-F22."""
    if not camp:
        return
    cols["campaign_prefix"] = X.campaign_prefix(camp)
    cols["is_retargeting"] = X.is_retargeting(camp)
    cols["channel"] = X.channel(camp)


def add_quality_score(cols: Columns) -> None:
    """non-null cells / columns x 100, one decimal (after imputation)."""
    names = list(cols.keys())
    present = [X.ref(n).isNotNull().cast("int") for n in names]
    total = present[0]
    for p in present[1:]:
        total = total + p
    cols["data_quality_score"] = X.pround(total / F.lit(float(len(names))) * F.lit(100.0), 1)
