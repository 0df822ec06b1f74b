"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Each timing is the median of $BENCH_RUNS runs after one
warm-up; queries are forced with the ``noop`` sink (full compute, nothing
collected to the driver).  ``clean_sales`` is the ETL (dedup, imputation,
features, ranks, ordered windows, materialized cleaned table); report queries
then read the cleaned table, as the dashboard does.  Ordered sums, moving averages,
percentiles and z-scores are timed as operators on the raw rows, not as finished columns.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from adloom.operators import profile as P  # noqa: E402
from adloom.operators import reports as R  # noqa: E402
from adloom.operators.ordered import attach_percentiles, percentile_steps, rank_table, sequence_ops  # noqa: E402
from adloom.plans import catalog  # noqa: E402
from adloom.plans.pipeline import CleanOptions, clean_dataset  # noqa: E402
from adloom.plans.views import SALES_ORDER, view  # noqa: E402
from adloom.session import get_spark, materialize  # noqa: E402


def force(df):
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs):
    fn()  # warm-up
    out = []
    for _ in range(runs):
        t = time.perf_counter()
        fn()
        out.append(time.perf_counter() - t)
    return round(statistics.median(out), 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                             "spark.driver.memory": "8g"})
    q = {}
    keys = [c for c in SALES_ORDER if c != "date"]

    def clean_sales():
        res = clean_dataset(view(spark, sf_dir, "sales_facts"), CleanOptions(order_keys=keys))
        materialize(res.df)
    q["clean_sales"] = timed(clean_sales, runs)

    # reports over the cleaned table (built once, as the dashboard reads it)
    for name in ("channel_revenue", "kpi_totals", "revenue_by_weekday", "monthly_revenue",
                 "tier_distribution", "top10_days", "ctr_histogram", "advanced_kpis", "revenue_trend", "flagged_rows"):
        fn = catalog.QUERIES[name]
        q[name] = timed(lambda fn=fn: force(fn(spark, sf_dir)), runs)

    raw = view(spark, sf_dir, "sales_facts").withColumn("revenue", F.col("price") * F.col("quantity"))
    raw = materialize(raw)
    n = raw.count()
    order = ["date"] + keys

    q["cumulative_revenue"] = timed(lambda: force(sequence_ops(
        raw, order, n_rows=n, cum_cols=["revenue", "clicks"])), runs)
    q["moving_averages"] = timed(lambda: force(sequence_ops(
        raw, order, n_rows=n, roll_cols=["revenue", "clicks"])), runs)

    def percentiles():
        cols = ["revenue", "clicks", "conversions", "spend"]
        steps = percentile_steps(rank_table(raw, cols), {c: n for c in cols})
        force(attach_percentiles(raw, steps, {c: f"{c}_percentile" for c in cols}))
    q["percentile_ranks"] = timed(percentiles, runs)

    def zscores():
        cols = ["revenue", "clicks", "conversions", "spend", "impressions", "price"]
        st = raw.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
        force(raw.select("*", *[((F.col(c) - st[f"m_{c}"]) / st[f"s_{c}"]).alias(f"z_{c}") for c in cols]))
    q["zscores"] = timed(zscores, runs)

    dirty = view(spark, sf_dir, "dirty_orders")
    q["profile"] = timed(lambda: P.column_profile(dirty).collect(), runs)
    q["dedup"] = timed(lambda: force(dirty.dropDuplicates()), runs)
    q["duplicate_rate"] = timed(lambda: P.duplicate_rate(dirty).collect(), runs)
    q["ad_channel_revenue"] = timed(lambda: force(R.channel_revenue(
        clean_dataset(view(spark, sf_dir, "ad_facts")).df)), runs)

    headline = ["clean_sales", "channel_revenue", "cumulative_revenue", "moving_averages",
                "percentile_ranks", "zscores", "profile", "dedup"]
    total = round(sum(q[k] for k in headline), 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": q,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf_dir,
                      "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
