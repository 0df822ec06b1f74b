"""Scalar column expressions (all JVM built-ins, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values (must equal the behaviour being matched) -----------------
# Channel words, in match-priority order of a leftmost regex search.
CHANNEL_PATTERN = "(search|display|social|email|video)"
RETARGETING_WORDS = ["retargeting", "rmkt", "rtg"]
# Tokens a CSV reader treats as missing (pandas read_csv defaults).
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
               "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
TIER_LABELS = ["Poor", "Below Avg", "Above Avg", "Excellent"]
SUSPICIOUS_CLICKS = 200


def ref(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def col(c) -> Column:
    return ref(c) if isinstance(c, str) else c


def safe_den(c) -> Column:
    """Denominator rule: 0 becomes 1, null stays null (x / 0 yields x)."""
    c = col(c)
    return F.when(c == 0, F.lit(1)).otherwise(c)


def ratio(num, den) -> Column:
    return col(num).cast("double") / safe_den(den).cast("double")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                           T.FloatType, T.DoubleType, T.DecimalType))


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType))


def nan_to_null(c, dt: T.DataType) -> Column:
    """Spark counts NaN as a value; the engine treats it as missing."""
    c = col(c)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(F.isnan(c), F.lit(None).cast(dt)).otherwise(c)
    return c


def plain_zero(c, dt: T.DataType) -> Column:
    """-0.0 as 0.0, as grouping has it."""
    c = col(c)
    return c + F.lit(0.0).cast(dt) if isinstance(dt, (T.DoubleType, T.FloatType)) else c


# ---- temporal (F4-F9); d is a timestamp / timestamp_ntz column ------------
def day_name(d) -> Column:
    # dayofweek: 1 = Sunday ... 7 = Saturday; an array lookup is much cheaper
    # than a date formatter per row
    names = F.array(*[F.lit(n) for n in WEEKDAYS[-1:] + WEEKDAYS[:-1]])
    return F.element_at(names, F.dayofweek(col(d)))


def is_weekend(d) -> Column:
    # dayofweek: 1 = Sunday ... 7 = Saturday; a null date is not a weekend
    return F.coalesce(F.dayofweek(col(d)).isin(1, 7), F.lit(False))


def year_month(d) -> Column:
    d = col(d)
    return F.concat(F.lpad(F.year(d).cast("string"), 4, "0"), F.lit("-"),
                    F.lpad(F.month(d).cast("string"), 2, "0"))


def quarter_label(d) -> Column:
    d = col(d)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def iso_week(d) -> Column:
    return F.weekofyear(col(d))


def epoch_micros(d, dt: T.DataType) -> Column:
    """Time-zone independent micro-second count for date / timestamp types."""
    d = col(d)
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(d)
    if isinstance(dt, T.DateType):
        return F.unix_date(d).cast("long") * F.lit(86_400_000_000)
    # timestamp_ntz: wall-clock arithmetic, no zone conversion
    secs = F.date_part(F.lit("SECOND"), d)  # decimal seconds with fraction
    return (F.unix_date(F.to_date(d)).cast("long") * F.lit(86_400_000_000)
            + F.hour(d).cast("long") * F.lit(3_600_000_000)
            + F.minute(d).cast("long") * F.lit(60_000_000)
            + (secs * F.lit(1_000_000)).cast("long"))


def days_between(d, start_micros, dt: T.DataType) -> Column:
    """Whole days since ``start`` (floored), like a timedelta's ``.days``.

    ``start`` is the column minimum (a number, or a column of numbers), so the difference
    is never negative."""
    if isinstance(dt, (T.TimestampNTZType, T.DateType)):
        # wall-clock arithmetic without any time zone: whole days elapsed
        if isinstance(start_micros, Column):
            seconds = (start_micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
            start = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
        else:
            start = F.lit(micros_to_text(start_micros)).cast("timestamp_ntz")
        return F.timestamp_diff("DAY", start, col(d).cast("timestamp_ntz")).cast("long")
    return F.floor((epoch_micros(d, dt) - F.lit(start_micros)) / F.lit(86_400_000_000)).cast("long")


def micros_to_text(micros: int) -> str:
    """Epoch micro-seconds -> 'YYYY-MM-DD HH:MM:SS.ffffff' (wall clock, UTC rule)."""
    import datetime as _dt
    t = _dt.datetime(1970, 1, 1) + _dt.timedelta(microseconds=int(micros))
    return t.strftime("%Y-%m-%d %H:%M:%S.%f")


# ---- campaign parsing (F20-F22) -------------------------------------------
def campaign_prefix(c) -> Column:
    """Text before the first '_' (whole text if none)."""
    return F.substring_index(col(c), "_", 1)


def is_retargeting(c) -> Column:
    """Lower-cased text contains any retargeting word (plain substring tests,
    same answer as the alternation regex, no regex engine per row)."""
    lc = F.lower(col(c))
    hit = lc.contains(RETARGETING_WORDS[0])
    for w in RETARGETING_WORDS[1:]:
        hit = hit | lc.contains(w)
    return F.coalesce(hit, F.lit(False))


def channel(c) -> Column:
    """First channel word in the text (leftmost match), title case; else 'Other'."""
    found = F.regexp_extract(F.lower(col(c)), CHANNEL_PATTERN, 1)
    return F.initcap(F.coalesce(F.nullif(found, F.lit("")), F.lit("other")))


# ---- flags (F16, F17) -----------------------------------------------------
def suspicious_traffic(clicks, conversions) -> Column:
    return F.coalesce((col(clicks) > SUSPICIOUS_CLICKS) & (col(conversions) == 0), F.lit(False))


def ctr_anomaly(clicks, impressions) -> Column:
    return F.coalesce(ratio(clicks, impressions) > 1.0, F.lit(False))


def pround(c, d: int) -> Column:
    """Round like pandas/numpy ``.round(d)``: half-to-even on the binary value of
    ``x * 10**d`` (``rint``), then divided back; ``+ 0.0`` turns -0.0 into 0.0."""
    scale = float(10 ** d)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale) + F.lit(0.0)
