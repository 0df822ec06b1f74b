"""DuckDB SQL for the query catalogue: independent re-statements of each
operator over the same views, used as the correctness oracle.

Each query states the rule of the operator, not the engine's way to it.  Floats are
rounded on both sides, as sums may associate differently.
"""

from __future__ import annotations

from adloom.plans.views import view_sql

SALES_KEYS = ("date, campaign_name, impressions, clicks, conversions, spend, price, quantity, "
              "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, l_returnflag, l_linestatus")
SALES_ORDER = ", ".join(f"{c.strip()} ASC NULLS LAST" for c in SALES_KEYS.split(","))
SALES_NUMERIC = ["impressions", "clicks", "conversions", "spend", "price", "quantity",
                 "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"]


def pr(e: str, d: int) -> str:
    """numpy-style rounding: half-to-even of the binary value of e * 10^d."""
    y = f"(({e}) * {float(10 ** d)!r})"
    return (f"((CASE WHEN {y} - FLOOR({y}) = 0.5 THEN (CASE WHEN FLOOR({y}) % 2 = 0 THEN FLOOR({y}) "
            f"ELSE FLOOR({y}) + 1 END) ELSE ROUND({y}) END) / {float(10 ** d)!r} + 0.0)")


def _den(x: str) -> str:
    return f"CAST(CASE WHEN {x} = 0 THEN 1 ELSE {x} END AS DOUBLE)"


def features_cte(view: str, numeric: list[str]) -> str:
    """Cleaned + stateless features (F1-F17, F20-F22) + z-scores."""
    z = ",\n    ".join(
        f"{pr(f'(CAST({c} AS DOUBLE) - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER ()', 4)} AS z_{c}"
        for c in numeric)
    absz = ", ".join(f"ABS(z_{c})" for c in numeric)
    return f"""
base AS (SELECT DISTINCT * FROM ({view_sql(view)}) v),
f0 AS (
  SELECT *,
    price * quantity AS revenue,
    CAST(clicks AS DOUBLE) / {_den('impressions')} AS ctr,
    CAST(conversions AS DOUBLE) / {_den('clicks')} AS conversion_rate
  FROM base),
f1 AS (
  SELECT *,
    revenue / {_den('spend')} AS roas,
    spend / {_den('conversions')} AS cpa,
    spend / {_den('clicks')} AS cpc,
    spend / {_den('impressions')} * 1000.0 AS cpm,
    revenue - spend AS profit,
    (revenue - spend) / {_den('revenue')} AS profit_margin,
    COALESCE(clicks > 200 AND conversions = 0, false) AS is_suspicious_traffic,
    COALESCE(CAST(clicks AS DOUBLE) / {_den('impressions')} > 1.0, false) AS is_ctr_anomaly,
    dayname(date) AS day_of_week,
    COALESCE(dayofweek(date) IN (0, 6), false) AS is_weekend,
    strftime(date, '%Y-%m') AS month,
    CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR) AS quarter,
    CAST(weekofyear(date) AS INTEGER) AS week_number,
    CAST(FLOOR((epoch_us(date) - MIN(epoch_us(date)) OVER ()) / 86400000000) AS BIGINT) AS days_since_start,
    split_part(campaign_name, '_', 1) AS campaign_prefix,
    COALESCE(regexp_matches(lower(campaign_name), 'retargeting|rmkt|rtg'), false) AS is_retargeting,
    COALESCE(NULLIF(regexp_extract(lower(campaign_name), '(search|display|social|email|video)', 1), ''), 'other') AS _ch,
    {z}
  FROM f0),
f AS (
  SELECT * EXCLUDE (_ch),
    upper(substr(_ch, 1, 1)) || substr(_ch, 2) AS channel,
    COALESCE(greatest({absz}) > 3, false) AS is_outlier
  FROM f1)"""


def engagement_cte(src: str = "f") -> str:
    parts = []
    for p in ("ctr", "conversion_rate", "roas"):
        parts.append(f"CASE WHEN MAX({p}) OVER () - MIN({p}) OVER () = 0 THEN 0.5 "
                     f"ELSE ({p} - MIN({p}) OVER ()) / (MAX({p}) OVER () - MIN({p}) OVER ()) END")
    return f"""
q AS (
  SELECT quantile_cont(roas, 0.0) AS e0, quantile_cont(roas, 0.25) AS e1, quantile_cont(roas, 0.5) AS e2,
         quantile_cont(roas, 0.75) AS e3, MAX(roas) AS e4, COUNT(*) AS n FROM {src}),
e AS (
  SELECT {src}.*,
    {pr(f"({' + '.join(parts)}) / 3.0 * 100.0", 2)} AS engagement_score,
    CASE WHEN roas IS NULL OR q.n < 4 OR NOT (q.e0 < q.e1 AND q.e1 < q.e2 AND q.e2 < q.e3 AND q.e3 < q.e4) THEN NULL
         WHEN roas <= q.e1 THEN 'Poor'
         WHEN roas <= q.e2 THEN 'Below Avg'
         WHEN roas <= q.e3 THEN 'Above Avg'
         WHEN roas <= q.e4 THEN 'Excellent' END AS spend_efficiency_tier
  FROM {src}, q)"""


def pct_rank(c: str) -> str:
    inner = (f"(RANK() OVER (ORDER BY {c} ASC NULLS LAST) - 1 "
             f"+ (COUNT(*) OVER (PARTITION BY {c}) + 1) / 2.0) / COUNT({c}) OVER ()")
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE {pr(inner, 4)} * 100.0 END"


def roll(c: str, k: int, order: str) -> str:
    w = f"OVER (ORDER BY {order} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return pr(f"AVG(CAST({c} AS DOUBLE)) {w}", 4)


def cum_double(c: str, order: str) -> str:
    w = f"OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"SUM(CAST({c} AS DOUBLE)) {w}"


def cum_long(c: str, order: str) -> str:
    w = f"OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CAST(SUM({c}) {w} AS BIGINT)"


def with_sales(select: str, engagement: bool = False) -> str:
    ctes = features_cte("sales_facts", SALES_NUMERIC)
    if engagement:
        ctes += "," + engagement_cte("f")
    return f"WITH {ctes}\n{select}"


def with_ads(select: str, engagement: bool = False) -> str:
    ctes = features_cte("ad_facts", ["impressions", "clicks", "conversions", "spend", "price", "quantity"])
    if engagement:
        ctes += "," + engagement_cte("f")
    return f"WITH {ctes}\n{select}"


DAY = "strftime(date, '%Y-%m-%d')"
WEEKDAYS_VALUES = ("(VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), "
                   "(5, 'Friday'), (6, 'Saturday'), (7, 'Sunday')) AS d(weekday_order, weekday)")
TIERS_VALUES = "(VALUES (1, 'Poor'), (2, 'Below Avg'), (3, 'Above Avg'), (4, 'Excellent')) AS t(tier_order, tier)"

DIRTY = view_sql("dirty_orders")
DIRTY_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
DIRTY_NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice"]
DIRTY_TEXT = ["o_orderstatus", "o_orderpriority"]


def _mode_sql(c: str, src: str) -> str:
    return (f"(SELECT {c} FROM (SELECT {c}, COUNT(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}) "
            f"ORDER BY n DESC, {c} ASC LIMIT 1)")


def histogram(table: str, c: str, bins: int = 20) -> str:
    """Bins by their edges: a value belongs where lower edge <= value < upper edge (last: <=)."""
    return (f"SELECT CAST(i AS INTEGER) AS bin, printf('%.1f-%.1f', lower, upper) AS label, CAST(COUNT(v) AS BIGINT) AS count FROM ("
            f"  SELECT i, lo + i * ((hi - lo) / {bins}) AS lower, CASE WHEN i = {bins - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {bins}) END AS upper "
            f"  FROM range({bins}) r(i), (SELECT MIN({c}) * (CASE WHEN MAX({c}) < 1 THEN 100 ELSE 1 END) AS lo, "
            f"                              MAX({c}) * (CASE WHEN MAX({c}) < 1 THEN 100 ELSE 1 END) AS hi FROM {table}) m) e "
            f"LEFT JOIN (SELECT {c} * (SELECT CASE WHEN MAX({c}) < 1 THEN 100.0 ELSE 1.0 END FROM {table}) AS v FROM {table}) x "
            f"ON v >= lower AND (v < upper OR i = {bins - 1}) GROUP BY i, lower, upper")


KPI_SELECT = (
    "SELECT COUNT(*) AS total_rows, ROUND(SUM(revenue), 2) AS total_revenue, ROUND(AVG(revenue), 2) AS avg_revenue, "
    "CAST(SUM(clicks) AS BIGINT) AS total_clicks, CAST(SUM(impressions) AS BIGINT) AS total_impressions, "
    "ROUND(CASE WHEN AVG(ctr) < 1 THEN AVG(ctr) * 100 ELSE AVG(ctr) END, 2) AS avg_ctr, "
    "CAST(SUM(conversions) AS BIGINT) AS total_conversions, ROUND(AVG(conversion_rate) * 100, 2) AS avg_conversion_rate FROM f")
TIER_SELECT = (
    f"SELECT t.tier_order, t.tier, CAST(COALESCE(c.n, 0) AS BIGINT) AS count FROM {TIERS_VALUES} "
    "LEFT JOIN (SELECT spend_efficiency_tier AS tier, COUNT(*) AS n FROM e WHERE spend_efficiency_tier IS NOT NULL GROUP BY 1) c "
    "ON t.tier = c.tier WHERE EXISTS (SELECT 1 FROM e WHERE spend_efficiency_tier IS NOT NULL)")


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    by_channel = ("SELECT channel, revenue, CAST(ROW_NUMBER() OVER (ORDER BY revenue DESC, channel) AS INTEGER) AS channel_rank "
                  "FROM (SELECT channel, ROUND(SUM(revenue), 2) AS revenue FROM f GROUP BY channel)")
    q["ad_channel_revenue"] = with_ads(by_channel)
    q["ad_kpi_totals"] = with_ads(KPI_SELECT)
    q["kpi_totals"] = with_sales(KPI_SELECT)
    q["ad_tier_distribution"] = with_ads(TIER_SELECT, engagement=True)
    q["tier_distribution"] = with_sales(TIER_SELECT, engagement=True)

    q["revenue_by_date"] = with_sales(
        "SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY date_label) AS INTEGER) AS day_rank FROM ("
        f"SELECT {DAY} AS date_label, ROUND(SUM(revenue), 2) AS revenue FROM f WHERE date IS NOT NULL GROUP BY 1)")
    q["revenue_by_weekday"] = with_sales(
        f"SELECT d.weekday_order, d.weekday, ROUND(COALESCE(s.r, 0.0), 2) AS revenue FROM {WEEKDAYS_VALUES} "
        "LEFT JOIN (SELECT dayname(date) AS weekday, SUM(revenue) AS r FROM f WHERE date IS NOT NULL GROUP BY 1) s "
        "ON d.weekday = s.weekday")
    q["funnel"] = with_sales(
        "SELECT 'impressions' AS stage, CAST(SUM(impressions) AS BIGINT) AS value FROM f UNION ALL "
        "SELECT 'clicks', CAST(SUM(clicks) AS BIGINT) FROM f UNION ALL "
        "SELECT 'conversions', CAST(SUM(conversions) AS BIGINT) FROM f")
    q["monthly_revenue"] = with_sales(
        "SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY month_start) AS INTEGER) AS month_rank FROM (SELECT strftime(date_trunc('month', date), '%b %Y') AS month_label, strftime(date, '%Y-%m') AS month_start, "
        "ROUND(SUM(revenue), 2) AS revenue, CAST(SUM(clicks) AS BIGINT) AS clicks FROM f WHERE date IS NOT NULL GROUP BY 1, 2)")
    q["ctr_histogram"] = with_sales(histogram("f", "ctr"))
    q["engagement_histogram"] = with_sales(
        "SELECT CAST(i AS INTEGER) AS bin, CAST(i * 10 AS VARCHAR) || '-' || CAST(i * 10 + 10 AS VARCHAR) AS label, "
        "CAST(COALESCE(c.n, 0) AS BIGINT) AS count FROM range(10) r(i) "
        "LEFT JOIN (SELECT CAST(LEAST(FLOOR(engagement_score / 10), 9) AS INTEGER) AS bin, COUNT(*) AS n FROM e "
        "  WHERE engagement_score BETWEEN 0 AND 100 GROUP BY 1) c ON r.i = c.bin", engagement=True)
    q["channel_revenue"] = with_sales(by_channel)
    q["advanced_kpis"] = with_sales(
        "SELECT ROUND(AVG(roas), 4) AS avg_roas, ROUND(AVG(cpa), 4) AS avg_cpa, ROUND(AVG(cpc), 4) AS avg_cpc, "
        "ROUND(AVG(cpm), 4) AS avg_cpm, ROUND(AVG(profit_margin) * 100, 2) AS avg_profit_margin, "
        "ROUND(AVG(engagement_score), 4) AS avg_engagement_score, "
        "CAST(COUNT_IF(is_suspicious_traffic) AS BIGINT) AS bot_traffic_count, CAST(COUNT_IF(is_ctr_anomaly) AS BIGINT) AS ctr_anomaly_count, "
        "CAST(COUNT_IF(is_outlier) AS BIGINT) AS outlier_count, CAST(COUNT_IF(is_retargeting) AS BIGINT) AS retargeting_count, "
        "ROUND(SUM(profit), 2) AS total_profit, true AS has_advanced, "
        "'roas,cpa,cpc,cpm,profit_margin,engagement_score,is_suspicious_traffic,is_outlier,is_retargeting,channel,spend_efficiency_tier,day_of_week' "
        "AS available_columns FROM e", engagement=True)
    q["summary"] = with_sales(
        "SELECT ROUND(SUM(revenue) / GREATEST(SUM(clicks), 1), 2) AS revenue_per_click, "
        "ROUND(SUM(revenue) / GREATEST(FLOOR((MAX(epoch_us(date)) - MIN(epoch_us(date))) / 86400000000), 1), 2) AS avg_daily_revenue, "
        "ROUND(CASE WHEN AVG(ctr) < 1 THEN AVG(ctr) * 100 ELSE AVG(ctr) END, 2) AS click_through_rate, "
        "ROUND(SUM(conversions) / GREATEST(SUM(clicks), 1) * 100, 2) AS avg_conversion_rate FROM f")
    gauge = ("SELECT rate, GREATEST(100.0 - rate, 0.0) AS remaining FROM (SELECT CASE WHEN conv <> 0 THEN conv WHEN ctr <> 0 THEN ctr ELSE 0.0 END AS rate "
             "FROM (SELECT ROUND(AVG(conversion_rate) * 100, 2) AS conv, ROUND(AVG(ctr) * (CASE WHEN AVG(ctr) < 1 THEN 100 ELSE 1 END), 2) AS ctr FROM f))")
    q["gauge"] = with_sales(gauge)
    q["zero_gauge"] = f"WITH f AS ({view_sql('zero_rates')}) {gauge}"
    q["rate_histogram"] = f"WITH f AS ({view_sql('small_rates')}) {histogram('f', 'rate')}"
    q["anomaly_total"] = with_sales(
        "SELECT CAST(COUNT_IF(is_suspicious_traffic) + COUNT_IF(is_ctr_anomaly) + COUNT_IF(is_outlier) AS BIGINT) AS anomaly_total FROM f")
    q["digest"] = with_sales(" UNION ALL ".join(
        f"SELECT '{c}' AS column, ROUND(CAST(MIN({c}) AS DOUBLE), 2) AS min, ROUND(CAST(MAX({c}) AS DOUBLE), 2) AS max, "
        f"ROUND(AVG({c}), 2) AS mean, ROUND(STDDEV_SAMP({c}), 2) AS std FROM f" for c in SALES_NUMERIC))
    q["digest_sample"] = with_sales(
        f"SELECT {DAY} AS date_label, campaign_name, {pr('revenue', 2)} AS revenue, clicks, impressions, conversions "
        f"FROM f ORDER BY {SALES_ORDER} LIMIT 5")
    q["top10_days"] = with_sales(
        "SELECT date_label, ROUND(v, 2) AS revenue, CAST(ROW_NUMBER() OVER (ORDER BY v ASC, date_label DESC) - 1 AS INTEGER) AS row_index FROM ("
        f"SELECT {DAY} AS date_label, SUM(revenue) AS v FROM f WHERE date IS NOT NULL GROUP BY 1 ORDER BY v DESC, 1 ASC LIMIT 10)")
    q["top5_days"] = with_sales(
        f"SELECT date_label, ROUND(v, 2) AS revenue, ROUND(v / NULLIF(MAX(v) OVER (), 0) * 100, 1) AS pct_of_best, "
        f"CAST(ROW_NUMBER() OVER (ORDER BY v DESC, date_label) - 1 AS INTEGER) AS row_index FROM ("
        f"SELECT {DAY} AS date_label, SUM(revenue) AS v FROM f WHERE date IS NOT NULL GROUP BY 1 ORDER BY v DESC, 1 ASC LIMIT 5)")
    q["roas_trend"] = with_sales(
        f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY {SALES_ORDER}) - 1 AS BIGINT) AS row_index, {DAY} AS date_label, {pr('roas', 4)} AS roas, roas_ma3 "
        f"FROM (SELECT *, {roll('roas', 3, SALES_ORDER)} AS roas_ma3 FROM f) WHERE date IS NOT NULL AND roas IS NOT NULL")
    q["profit_trend"] = with_sales(
        f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY {SALES_ORDER}) - 1 AS BIGINT) AS row_index, {DAY} AS date_label, {pr('profit_margin * 100', 2)} AS profit_margin_pct FROM f WHERE date IS NOT NULL")
    q["cumulative_revenue"] = with_sales(
        f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY {SALES_ORDER}) - 1 AS BIGINT) AS row_index, {DAY} AS date_label, {pr('c', 2)} AS revenue_cumulative "
        f"FROM (SELECT *, {cum_double('revenue', SALES_ORDER)} AS c FROM f) WHERE date IS NOT NULL")
    q["cumulative_totals"] = with_sales(
        f"SELECT l_orderkey, l_linenumber, l_partkey, {cum_long('clicks', SALES_ORDER)} AS clicks_cumulative, "
        f"{cum_long('conversions', SALES_ORDER)} AS conversions_cumulative, "
        f"{pr(cum_double('spend', SALES_ORDER), 4)} AS spend_cumulative FROM f")
    ma = ", ".join(f"{roll(c, k, SALES_ORDER)} AS {c}_ma{k}" for c in ("revenue", "clicks", "conversions", "roas")
                   for k in (3, 7))
    q["moving_averages"] = with_sales(f"SELECT {DAY} AS date_label, l_orderkey, l_linenumber, {ma} FROM f")
    inside = f"PARTITION BY channel ORDER BY {SALES_ORDER}"
    run = f"({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ma = ", ".join(f"{pr(f'AVG(CAST({c} AS DOUBLE)) OVER ({inside} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)', 4)} AS {c}_ma{k}"
                   for c in ("revenue", "clicks") for k in (3, 7))
    q["channel_running"] = with_sales(
        f"SELECT l_orderkey, l_linenumber, l_partkey, channel, ROW_NUMBER() OVER ({inside}) AS channel_row, "
        f"{pr(f'CASE WHEN revenue IS NOT NULL THEN SUM(CAST(revenue AS DOUBLE)) OVER {run} END', 2)} AS revenue_cumulative, "
        f"CAST(CASE WHEN clicks IS NOT NULL THEN SUM(clicks) OVER {run} END AS BIGINT) AS clicks_cumulative, {ma} FROM f")
    cents = "CAST(ROUND(revenue * 100) AS BIGINT)"
    within = "RANGE BETWEEN INTERVAL {} DAYS PRECEDING AND CURRENT ROW"
    by_day = ", ".join(
        pr(f"CASE WHEN date IS NOT NULL THEN AVG({c}) OVER ({group} ORDER BY CAST(date AS DATE) {within.format(k - 1)}) END", 3)
        + f" AS {name}_ma{k}d" for c, name, group in ((cents, "cents", ""), ("clicks", "clicks", ""), (cents, "in_channel", "PARTITION BY channel"))
        for k in (3, 7))
    q["moving_averages_by_day"] = with_sales(f"SELECT l_orderkey, l_linenumber, l_partkey, {by_day} FROM f")
    prk = ", ".join(f"{pct_rank(c)} AS {c}_percentile" for c in ("revenue", "clicks", "conversions", "roas"))
    q["percentile_ranks"] = with_sales(f"SELECT l_orderkey, l_linenumber, l_partkey, {prk} FROM f")
    zc = ", ".join(f"z_{c}" for c in SALES_NUMERIC)
    q["zscores"] = with_sales(f"SELECT l_orderkey, l_linenumber, l_partkey, {zc}, is_outlier FROM f")
    q["flagged_rows"] = with_sales(
        f"SELECT {DAY} AS date_label, campaign_name, l_orderkey, l_linenumber, is_suspicious_traffic, is_ctr_anomaly, is_outlier "
        f"FROM f WHERE is_suspicious_traffic OR is_ctr_anomaly OR is_outlier ORDER BY {SALES_ORDER} LIMIT 50")
    q["flagged_total"] = with_sales(
        "SELECT COUNT(*) AS total_flagged FROM f WHERE is_suspicious_traffic OR is_ctr_anomaly OR is_outlier")
    six = ["ctr", "conversion_rate", "roas", "cpa", "cpc", "cpm"]
    q["funnel_metrics"] = with_sales(
        f"SELECT l_orderkey, l_linenumber, l_partkey, {pr('revenue', 4)} AS revenue, "
        + ", ".join(f"{pr(c, 6)} AS {c}" for c in six)
        + f", {pr('profit', 4)} AS profit, {pr('profit_margin', 6)} AS profit_margin FROM f")
    q["temporal_features"] = with_sales(
        "SELECT l_orderkey, l_linenumber, l_partkey, day_of_week, is_weekend, month, quarter, week_number, days_since_start FROM f")
    q["campaign_parse"] = with_sales(
        "SELECT l_orderkey, l_linenumber, l_partkey, campaign_prefix, is_retargeting, channel FROM f")
    q["engagement_tiers"] = with_sales(
        "SELECT l_orderkey, l_linenumber, l_partkey, engagement_score, spend_efficiency_tier FROM e", engagement=True)
    q["suspicious_by_channel"] = with_sales(
        "SELECT channel, CAST(COUNT_IF(is_suspicious_traffic) AS BIGINT) AS suspicious, "
        "CAST(COUNT_IF(is_ctr_anomaly) AS BIGINT) AS ctr_anomalies, CAST(COUNT_IF(is_retargeting) AS BIGINT) AS retargeting "
        "FROM f GROUP BY channel")
    q["page_by_revenue"] = with_sales(
        f"SELECT l_orderkey, l_linenumber, l_partkey, {pr('revenue', 2)} AS revenue FROM f "
        f"ORDER BY revenue DESC NULLS LAST, {SALES_ORDER} LIMIT 50 OFFSET 100")
    q["deep_page"] = with_sales(
        f"SELECT l_orderkey, l_linenumber, l_partkey, {pr('f.revenue', 2)} AS revenue FROM f ORDER BY f.revenue ASC NULLS FIRST, {SALES_ORDER} "
        "LIMIT 50 OFFSET (SELECT CAST((GREATEST(CEIL(COUNT(*) / 50), 1) // 2 - 1) * 50 AS BIGINT) FROM f)")
    q["revenue_trend"] = with_sales(f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY {SALES_ORDER}) - 1 AS BIGINT) AS row_index, {DAY} AS date_label, {pr('revenue', 2)} AS revenue FROM f WHERE date IS NOT NULL")
    q["clicks_impressions_series"] = with_sales(
        f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY {SALES_ORDER}) - 1 AS BIGINT) AS row_index, clicks, impressions FROM f")
    q["page_count"] = with_sales("SELECT COUNT(*) AS rows, CAST(GREATEST(CEIL(COUNT(*) / 50), 1) AS BIGINT) AS pages FROM f")

    # ---- dirty_orders: validation, profiling, cleaning ----------------------
    raw = f"WITH raw AS ({DIRTY})\n"
    q["dedup"] = raw + ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, "
                        "o_orderpriority FROM (SELECT DISTINCT * FROM raw)")
    q["duplicate_rate"] = raw + (
        "SELECT COUNT(*) AS rows, CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw)) AS BIGINT) AS duplicates, "
        "ROUND((COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw))) * 100.0::DOUBLE / COUNT(*), 1) AS dup_pct FROM raw")
    dd = f"WITH raw AS ({DIRTY}), d AS (SELECT DISTINCT * FROM raw)\n"
    q["fill_zero_mode"] = dd + (
        "SELECT o_orderkey, o_custkey, o_orderstatus, COALESCE(o_totalprice, 0.0) AS o_totalprice, "
        f"strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, COALESCE(o_orderpriority, {_mode_sql('o_orderpriority', 'd')}) AS o_orderpriority FROM d")
    q["fill_mean_constant"] = dd + (
        f"SELECT o_orderkey, o_custkey, o_orderstatus, {pr('COALESCE(o_totalprice, (SELECT AVG(o_totalprice) FROM d))', 4)} AS o_totalprice, "
        "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, COALESCE(o_orderpriority, 'Unknown') AS o_orderpriority FROM d")
    prof = []
    for c in DIRTY_COLS:
        dtype = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double",
                 "o_orderdate": "timestamp_ntz"}.get(c, "string")
        if c in DIRTY_NUMERIC:
            stats = (f"ROUND(CAST(MIN({c}) AS DOUBLE), 4) AS min, ROUND(CAST(MAX({c}) AS DOUBLE), 4) AS max, "
                     f"ROUND(AVG({c}), 4) AS mean, ROUND(quantile_cont({c}, 0.5), 4) AS median, "
                     f"ROUND(STDDEV_SAMP({c}), 4) AS std")
        else:
            stats = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("min", "max", "mean", "median", "std"))
        prof.append(f"(SELECT '{c}' AS column, '{dtype}' AS dtype, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count, "
                    f"ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 1) AS null_pct, "
                    f"CAST(COUNT(DISTINCT {c}) AS BIGINT) AS unique_count, "
                    f"ROUND(COUNT(DISTINCT {c}) * 100.0::DOUBLE / COUNT(*), 1) AS unique_pct, {stats} FROM raw)")
    q["profile"] = raw + " UNION ALL ".join(prof)
    q["top_values"] = raw + " UNION ALL ".join(
        f"(SELECT '{c}' AS column, v AS value, n AS count, CAST(rn AS INTEGER) AS rank FROM ("
        f"SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) ASC) AS rn "
        f"FROM raw WHERE {c} IS NOT NULL GROUP BY 1) WHERE rn <= 3)" for c in DIRTY_COLS if c not in DIRTY_NUMERIC)
    q["quality_snapshot"] = raw + " UNION ALL ".join(
        f"(SELECT '{c}' AS column, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS nulls, "
        + (f"COALESCE(ROUND(CAST(MIN({c}) AS DOUBLE), 4), 0) AS min, COALESCE(ROUND(CAST(MAX({c}) AS DOUBLE), 4), 0) AS max, "
           f"COALESCE(ROUND(AVG({c}), 4), 0) AS mean, COALESCE(ROUND(STDDEV_SAMP({c}), 4), 0) AS std"
           if c in DIRTY_NUMERIC else
           "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std")
        + " FROM raw)" for c in DIRTY_COLS)
    sraw = f"WITH raw AS ({view_sql('sales_facts')})\n"
    q["outliers"] = sraw + " UNION ALL ".join(
        f"(SELECT '{c}' AS column, CAST(COUNT(*) AS BIGINT) AS count, ROUND(COUNT(*) * 100.0::DOUBLE / MAX(n), 2) AS pct, "
        f"ROUND(CAST(MIN({c}) AS DOUBLE), 2) AS min_val, ROUND(CAST(MAX({c}) AS DOUBLE), 2) AS max_val FROM ("
        f"SELECT {c}, COUNT({c}) OVER () AS n, ABS(({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER ()) AS az FROM raw WHERE {c} IS NOT NULL) "
        f"WHERE az > 3 HAVING COUNT(*) > 0)" for c in SALES_NUMERIC)
    q["change_report"] = raw + (
        "SELECT CAST((SELECT COUNT(*) FROM raw) AS BIGINT) AS rows_before, "
        "CAST((SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw)) AS BIGINT) AS rows_after, "
        "CAST((SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw)) AS BIGINT) AS rows_removed, "
        "CAST((SELECT COUNT(*) FROM raw) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw)) AS BIGINT) AS duplicates_removed, "
        "CAST((SELECT " + " + ".join(f"COUNT(*) - COUNT({c})" for c in DIRTY_COLS) + " FROM (SELECT DISTINCT * FROM raw)) AS BIGINT) AS nulls_filled, "
        "'zero' AS strategy_numeric, 'mode' AS strategy_categorical, CAST(6 AS INTEGER) AS columns_before, "
        "CAST(6 AS INTEGER) AS columns_after, '' AS columns_added, '' AS columns_dropped")
    q["dataset_summary"] = raw + (
        "SELECT COUNT(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns, CAST(3 AS BIGINT) AS numeric_columns, "
        "CAST(2 AS BIGINT) AS categorical_columns, CAST(" + " + ".join(f"COUNT(*) - COUNT({c})" for c in DIRTY_COLS)
        + " AS BIGINT) AS total_nulls, CAST(COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw)) AS BIGINT) "
        "AS total_duplicates FROM raw")
    q["null_columns"] = raw + " UNION ALL ".join(
        f"(SELECT '{c}' AS column, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count, "
        f"ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 1) AS null_pct, COUNT({c}) = 0 AS all_null, "
        f"(COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*) >= 50 AS high_null FROM raw)" for c in DIRTY_COLS)
    q["typed_orders"] = (
        f"WITH t AS ({view_sql('orders_text')}), p AS (SELECT DISTINCT * FROM t) "
        "SELECT o_orderkey, strftime(CAST(order_date AS TIMESTAMP), '%Y-%m-%d') AS order_day, amount AS price, "
        "dayname(CAST(order_date AS TIMESTAMP)) AS day_of_week, strftime(CAST(order_date AS TIMESTAMP), '%Y-%m') AS month, "
        "dayofweek(CAST(order_date AS TIMESTAMP)) IN (0, 6) AS is_weekend FROM p")
    q["dayfirst_orders"] = ("SELECT DISTINCT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
    q["large_number_search"] = "SELECT o_orderkey, o_orderkey * 100000.0::DOUBLE AS scaled FROM orders WHERE o_orderkey > 0"
    q["empty_columns"] = "SELECT DISTINCT o_orderkey, 0.0::DOUBLE AS nothing, 'Unknown' AS no_text FROM orders"
    q["quality_score"] = (f"SELECT o_orderkey, {pr('((2 + (o_orderdate IS NOT NULL)::INT + (updated IS NOT NULL)::INT) / 4.0 * 100.0)', 1)} AS data_quality_score "
                          f"FROM (SELECT DISTINCT * FROM ({view_sql('sparse_orders')}))")
    q["keyword_columns"] = ("SELECT kind, v.column, rows FROM (VALUES ('metric', 'impressions'), ('metric', 'clicks'), ('metric', 'conversions'), "
                            "('spend', 'spend'), ('campaign', 'campaign_name')) v(kind, \"column\"), "
                            f"(SELECT COUNT(*) AS rows FROM ({view_sql('sales_facts')}))")
    q["roles"] = with_sales(
        "SELECT role, v.column, label, CAST(CASE v.column WHEN 'date' THEN COUNT(date) WHEN 'ctr' THEN COUNT(ctr) ELSE COUNT(*) END AS BIGINT) AS cells "
        "FROM f, (VALUES ('date', 'date', 'Date'), ('revenue', 'revenue', 'Revenue'), ('clicks', 'clicks', 'Clicks'), ('impressions', 'impressions', 'Impressions'), "
        "('ctr', 'ctr', 'Ctr'), ('conversions', 'conversions', 'Conversions')) v(role, \"column\", label) GROUP BY 1, 2, 3")
    odd = f"WITH raw AS ({view_sql('odd_orders')})\n"
    q["validation_report"] = odd + (
        "SELECT 'empty_column' AS rule, 'nothing' AS column, 100.0::DOUBLE AS measure "
        "UNION ALL SELECT 'half_empty', 'sometimes', ROUND(100.0::DOUBLE * COUNT(*) FILTER (sometimes IS NULL) / COUNT(*), 1) FROM raw "
        "UNION ALL SELECT 'duplicates', '*', ROUND(100.0::DOUBLE * (COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw))) / COUNT(*), 1) FROM raw "
        + "".join(f"UNION ALL SELECT 'outliers', '{c}', COUNT(*)::DOUBLE FROM raw, (SELECT AVG({c}) AS m, STDDEV_SAMP({c}) AS s FROM raw) "
                  f"WHERE ABS({c} - m) / s > 3 HAVING COUNT(*) > 0 " for c in ("sometimes", "amount_paid")))
    over = (f"WITH base AS (SELECT DISTINCT * EXCLUDE (revenue, ctr, month, quarter) FROM ({view_sql('sales_overwrite')})), "
            f"f AS (SELECT *, price * quantity AS revenue, clicks / {_den('impressions')} AS ctr, strftime(date, '%Y-%m') AS month, "
            "CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR) AS quarter FROM base)\n")
    z = lambda c: pr(f"({c} - AVG({c}) OVER ()) / STDDEV_SAMP({c}) OVER ()", 4)
    q["overwrite_features"] = over + (
        f"SELECT l_orderkey, l_linenumber, l_partkey, {pr('revenue', 4)} AS revenue, {pr('ctr', 6)} AS ctr, month, quarter, "
        f"{pr('revenue / ' + _den('spend'), 6)} AS roas, {pr('revenue - spend', 4)} AS profit, {z('revenue')} AS z_revenue, {z('ctr')} AS z_ctr FROM f")
    q["overwrite_windows"] = over + (
        f"SELECT l_orderkey, l_linenumber, l_partkey, {pct_rank('revenue')} AS revenue_percentile, {roll('revenue', 3, SALES_ORDER)} AS revenue_ma3, "
        f"{roll('revenue', 7, SALES_ORDER)} AS revenue_ma7, {pr(cum_double('revenue', SALES_ORDER), 2)} AS revenue_cumulative FROM f")
    q["tiny_prices"] = (
        f"WITH f AS (SELECT DISTINCT * FROM ({view_sql('sales_tiny')})) SELECT l_orderkey, l_linenumber, l_partkey, "
        f"{pr('(' + cum_double('price * quantity', SALES_ORDER) + ') * 1e6', 2)} AS revenue_cumulative_e6 FROM f")
    q["search_urgent"] = raw + (
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority "
        "FROM raw WHERE " + " OR ".join(f"COALESCE(contains(lower(CAST({c} AS VARCHAR)), 'urgent'), false)" for c in DIRTY_COLS))
    return q

