"""The distributed ordered operators equal the naive single-partition windows."""
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from adloom.operators.ordered import (OrderConfig, attach_percentiles, exact_quantiles, order_slices, percentile_steps,
                                      rank_table, rolling_days, running_total, sequence_ops)
from adloom.plans.views import view
from adloom.session import materialize
from conftest import SF001


@pytest.fixture(scope="module")
def facts(spark):
    df = view(spark, SF001, "sales_facts").withColumn("revenue", F.col("price") * F.col("quantity"))
    # inject nulls and ties: null dates, null measures, a hot date
    df = (df.withColumn("date", F.when(F.col("l_orderkey") % 17 == 0, F.lit(None)).otherwise(F.col("date")))
            .withColumn("revenue", F.when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("revenue")))
            .withColumn("date", F.when(F.col("l_orderkey") % 5 == 0, F.lit("1996-01-01").cast("timestamp_ntz"))
                        .otherwise(F.col("date"))))
    return df.cache()


ORDER = ["date", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "quantity", "price", "l_discount",
         "l_tax", "l_returnflag", "l_linestatus"]


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("rows_per_bucket", [97, 500, 10 ** 9])
def test_prefix_and_rolling_match_plain_windows(facts, rows_per_bucket):
    n = facts.count()
    got = sequence_ops(facts, ORDER, n_rows=n, cum_cols=["revenue", "clicks"], roll_cols=["revenue", "clicks"],
                       row_number_col="rn", cfg=OrderConfig(rows_per_bucket=rows_per_bucket))
    w = Window.orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = facts.select("*", F.row_number().over(w).alias("rn"),
                         *[F.when(F.col(c).isNotNull(), F.sum(c).over(run)).alias(f"{c}_cumulative") for c in ("revenue", "clicks")],
                         *[F.avg(c).over(w.rowsBetween(1 - k, 0)).alias(f"{c}_ma{k}") for c in ("revenue", "clicks") for k in (3, 7)])
    cols = ["rn", "l_orderkey", "l_linenumber", "revenue_cumulative", "clicks_cumulative",
            "revenue_ma3", "revenue_ma7", "clicks_ma3", "clicks_ma7"]
    a, b = _rows(plain, cols), _rows(got, cols)
    assert len(a) == len(b) == n
    for x, y in zip(a, b):
        assert x[:3] == y[:3] and x[4] == y[4]
        for u, v in zip(x[3:], y[3:]):
            assert (u is None and v is None) or u == pytest.approx(v, rel=1e-12)


@pytest.mark.parametrize("scale", [1e-10, 1e20, 1.0])
def test_running_sums_keep_every_magnitude(spark, scale):
    df = spark.createDataFrame([(i, scale) for i in range(40)], "i long, x double")
    out = sequence_ops(df, ["i"], n_rows=40, cum_cols=["x"], cfg=OrderConfig(rows_per_bucket=7)).orderBy("i").collect()
    assert [r["x_cumulative"] for r in out] == pytest.approx([scale * (i + 1) for i in range(40)], rel=1e-12)


def test_running_sums_keep_infinities(spark):
    df = spark.createDataFrame([(1, 1.0), (2, math.inf), (3, 2.0), (4, None)], "i long, x double")
    out = sequence_ops(df, ["i"], n_rows=4, cum_cols=["x"]).orderBy("i").collect()
    assert [r["x_cumulative"] for r in out] == [1.0, math.inf, math.inf, None]


def test_running_total_by_group(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i, 1 + i % 5) for i in range(200)], "g string, i long, v long")
    got = {r["i"]: r["t"] for r in running_total(df, ["g"], ["i"], "v", "t", partitions=7).collect()}
    sums: dict = {}
    for i in range(200):
        g = "a" if i % 3 else None
        assert got[i] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + 1 + i % 5


def test_average_rank_matches_pandas(facts):
    df = facts.select("revenue", "clicks", F.when(F.col("l_linenumber") == 1, F.lit(math.inf)).otherwise(F.col("quantity")).alias("q"),
                      F.lit(4.0).alias("same"), F.lit(None).cast("double").alias("none"))
    df = materialize(df)
    pdf = df.toPandas()
    cols = list(df.columns)
    sizes = {c: int(pdf[c].notna().sum()) for c in cols}
    steps = percentile_steps(rank_table(df, cols), sizes)
    assert all(len(s) <= 10_001 for s in steps.values())
    out = attach_percentiles(df, steps, {c: f"p_{c}" for c in cols})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan          # the wide frame stays in place
    got = out.toPandas()
    for c in cols:
        want = (pdf[c].rank(pct=True).round(4) * 100).fillna(-1)
        a, b = (np.array(sorted(zip(x.fillna(-1), p))) for x, p in ((pdf[c], want), (got[c], got[f"p_{c}"].fillna(-1))))
        assert (a[:, 0] == b[:, 0]).all() and np.allclose(a[:, 1], b[:, 1], atol=1e-9), c


def test_exact_quantiles_match_numpy(facts):
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    cols = ["revenue", "clicks", "quantity"]
    vals = {c: np.array([r[0] for r in facts.select(c).where(F.col(c).isNotNull()).collect()], float) for c in cols}
    got = exact_quantiles(rank_table(facts, cols), {c: len(v) for c, v in vals.items()}, qs)
    for c in cols:
        assert got[c] == pytest.approx(list(np.quantile(vals[c], qs)), rel=1e-12)


def test_no_single_partition_exchange(spark, facts):
    out = sequence_ops(facts, ORDER, n_rows=facts.count(), cum_cols=["clicks"], roll_cols=["clicks"],
                       cfg=OrderConfig(rows_per_bucket=500))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the only un-keyed windows run over the per-bucket offset table (one row per bucket)
    assert "hashpartitioning(_seq_b" in plan


@pytest.mark.parametrize("rows_per_bucket", [3, 41, 500, 10 ** 9])
def test_windows_by_group_match_plain_windows(facts, rows_per_bucket):
    """A third of the rows in one group, tiny groups, a null group, a derived column as the group."""
    group = F.when(F.col("l_orderkey") % 3 == 0, "hot").when(F.col("l_orderkey") % 7 == 0, F.lit(None)).otherwise((F.col("l_orderkey") % 40).cast("string"))
    df = facts.withColumn("grp", group)
    if rows_per_bucket == 3:
        df = df.where("l_orderkey < 400")
    df = materialize(df)
    n = df.count()
    got = sequence_ops(df, ORDER, n_rows=n, cum_cols=["revenue", "clicks"], roll_cols=["revenue"], row_number_col="rn",
                       cfg=OrderConfig(rows_per_bucket=rows_per_bucket), partition_by=["grp"])
    w = Window.partitionBy("grp").orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = df.select("*", F.row_number().over(w).alias("rn"),
                      *[F.when(F.col(c).isNotNull(), F.sum(c).over(run)).alias(f"{c}_cumulative") for c in ("revenue", "clicks")],
                      *[F.avg("revenue").over(w.rowsBetween(1 - k, 0)).alias(f"revenue_ma{k}") for k in (3, 7)])
    cols = ["l_orderkey", "l_linenumber", "rn", "clicks_cumulative", "revenue_cumulative", "revenue_ma3", "revenue_ma7"]
    a, b = _rows(plain, cols), _rows(got, cols)
    assert len(a) == len(b) == n
    for x, y in zip(a, b):
        assert x[:4] == y[:4]
        for u, v in zip(x[4:], y[4:]):
            assert (u is None and v is None) or u == pytest.approx(v, rel=1e-9)


def test_a_hot_group_spreads_over_buckets(facts):
    df = facts.withColumn("grp", F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(F.col("l_orderkey").cast("string")))
    out = sequence_ops(df, ORDER, n_rows=facts.count(), cum_cols=["clicks"], cfg=OrderConfig(rows_per_bucket=300), partition_by=["grp"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_seq_b" in plan and "hashpartitioning(grp" not in plan
    from adloom.session import checkpoint_dir
    import glob
    import os
    root = checkpoint_dir(df.sparkSession).removeprefix("file:")
    newest = max(glob.glob(f"{root}/adloom-tables/sequenced-*"), key=os.path.getmtime)
    buckets = df.sparkSession.read.parquet(newest).where("grp = 'hot'").groupBy("_seq_b").count().collect()
    assert len(buckets) >= 5 and max(r["count"] for r in buckets) < 700


def test_bucket_count_is_bounded():
    from adloom.operators.ordered import MOST_BUCKETS, n_buckets
    assert n_buckets(10 ** 12, OrderConfig()) == MOST_BUCKETS and n_buckets(1, OrderConfig()) == 1


def test_large_tables_get_larger_buckets():
    from adloom.operators.ordered import GROWN, n_buckets
    cfg = OrderConfig()
    assert n_buckets(600_000, cfg) == 12 and n_buckets(12_000_000, cfg) == 240
    for n in (36_000_000, 216_000_000):
        assert n_buckets(n, cfg) < n / cfg.rows_per_bucket / 2 and n / n_buckets(n, cfg) <= GROWN * cfg.rows_per_bucket


@pytest.mark.parametrize("rows_per_bucket", [97, 10 ** 9])
def test_places_grow_with_the_order(facts, rows_per_bucket):
    out = sequence_ops(facts, ORDER, n_rows=facts.count(), cum_cols=["clicks"], roll_cols=["revenue"], row_number_col="rn",
                       place_col="place", cfg=OrderConfig(rows_per_bucket=rows_per_bucket)).select("rn", "place").orderBy("rn").collect()
    places = [r["place"] for r in out]
    assert len(places) == facts.count() and all(a < b for a, b in zip(places, places[1:]))


def test_rolling_days_match_pandas(spark):
    rng = np.random.default_rng(4)
    day = np.where(rng.random(400) < 0.33, 7, rng.integers(0, 60, 400))       # a hot day, gaps
    rows = [(i, None if i % 41 == 0 else f"2024-01-01 0{i % 9}:00:00", int(d), "a" if i % 3 else None, None if i % 13 == 0 else float(v))
            for i, (d, v) in enumerate(zip(day, rng.normal(0, 100, 400)))]
    df = spark.createDataFrame(rows, "i long, t string, d int, g string, x double") \
        .select("i", (F.col("t").cast("timestamp_ntz") + F.make_dt_interval("d")).alias("date"), "d", "g", "x")
    whole = {r["i"]: r for r in rolling_days(df, "date", ["x"]).collect()}
    grouped = {r["i"]: r for r in rolling_days(df, "date", ["x"], (2,), ["g"]).collect()}
    for i, t, d, g, x in rows:
        for got, k, same in ((whole[i]["x_ma3d"], 3, lambda q: True), (whole[i]["x_ma7d"], 7, lambda q: True), (grouped[i]["x_ma2d"], 2, lambda q: q == g)):
            near = [r[4] for r in rows if r[1] and d - k < r[2] <= d and r[4] is not None and same(r[3])]
            want = sum(near) / len(near) if t and near else None
            assert got == (None if want is None else pytest.approx(want, rel=1e-9)), (i, k)
    assert rolling_days(df.limit(0), "date", ["x"]).collect() == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_order_by_stored_places_only(spark, facts):
    """Sorted once, before the stage table: later steps carry and compare one number, not the keys."""
    out = sequence_ops(facts, ORDER, n_rows=facts.count(), cum_cols=["clicks"], roll_cols=["clicks"],
                       cfg=OrderConfig(rows_per_bucket=500)).select("clicks_cumulative", "clicks_ma7")
    plan = _plan(out)
    assert "_seq_p" in plan and "l_partkey" not in plan and "WindowGroupLimit" not in plan


@pytest.mark.parametrize("rows_per_bucket", [97, 10 ** 9])
def test_row_numbers_alone_need_no_window(facts, rows_per_bucket):
    n = facts.count()
    out = sequence_ops(facts, ORDER, n_rows=n, row_number_col="rn", cfg=OrderConfig(rows_per_bucket=rows_per_bucket))
    assert "Window" not in _plan(out) and "hashpartitioning" not in _plan(out)
    w = Window.orderBy(*[F.col(c).asc_nulls_last() for c in ORDER])
    cols = ["rn", "l_orderkey", "l_linenumber", "l_partkey"]
    assert _rows(out, cols) == _rows(facts.withColumn("rn", F.row_number().over(w)), cols)


def test_rolling_days_leave_the_rows_in_place(spark):
    df = spark.range(3000).select("id", (F.lit("2024-01-01").cast("date") + (F.col("id") % 90).cast("int")).alias("date"), "id")
    plan = _plan(rolling_days(df.toDF("id", "date", "x"), "date", ["x"]))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("k", [2, 5])
def test_slices_follow_the_order(spark, k):
    """Nulls, a hot first key and equal keys: every row in one slice, no slice begins before the last one ends."""
    rng = np.random.default_rng(8)
    rows = [(i, None if i % 11 == 0 else 5 if i % 3 else int(rng.integers(0, 40)), None if i % 13 == 0 else float(rng.integers(0, 9)),
             None if i % 7 == 0 else "xyz"[i % 3]) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, a int, b double, c string")
    slices = order_slices(df, ["a", "b", "c"], k, 1500)
    got = [s.collect() for s in slices]
    assert 1 < len(got) <= k and sorted(r["i"] for s in got for r in s) == list(range(1500))
    key = lambda r: [(x is None, x or type(x)()) if x is not None else (True,) for x in r[1:]]
    full = [s for s in got if s]
    assert all(max(map(key, x)) < min(map(key, y)) for x, y in zip(full, full[1:]))
    assert max(len(s) for s in got) < 1500 * 0.8


def test_windows_over_slices_match_plain_windows(facts):
    n = facts.count()
    cfg = OrderConfig(rows_per_bucket=300, cells_per_range=n * len(facts.columns) // 3)
    got = sequence_ops(facts.drop("revenue"), ORDER, n_rows=n, cum_cols=["revenue", "clicks"], roll_cols=["revenue", "clicks"], row_number_col="rn",
                       cfg=cfg, place_col="place", bucket_col="bucket",
                       derived={"revenue": F.when(F.col("l_linenumber") != 3, F.col("price") * F.col("quantity"))})
    plain = sequence_ops(facts, ORDER, n_rows=n, cum_cols=["revenue", "clicks"], roll_cols=["revenue", "clicks"], row_number_col="rn")
    cols = ["rn", "l_orderkey", "l_linenumber", "clicks_cumulative", "clicks_ma3", "clicks_ma7", "revenue_ma3", "revenue_ma7", "revenue_cumulative"]
    for x, y in zip(_rows(got, cols), _rows(plain, cols), strict=True):
        none = [[math.nan if v is None else v for v in r[6:]] for r in (x, y)]
        assert x[:6] == y[:6] and none[0] == pytest.approx(none[1], rel=1e-12, nan_ok=True)
    at = [tuple(r) for r in got.orderBy("rn").select("place", "bucket").collect()]
    assert len(at) == n and all(a[0] < b[0] and a[1] <= b[1] for a, b in zip(at, at[1:]))
    assert len({b for _, b in at}) > 10


def test_channel_running_carries_no_totals_through_its_shuffle(facts):
    """What earlier buckets carry is joined after the windows; it went through their shuffle and sort with each row."""
    out = sequence_ops(facts, ORDER, n_rows=facts.count(), cum_cols=["clicks"], roll_cols=["revenue"], row_number_col="rn",
                       cfg=OrderConfig(rows_per_bucket=500), partition_by=["l_returnflag"])
    plan = _plan(out)
    below = plan[plan.index("hashpartitioning(_seq_b"):]
    assert "_ooff" in plan[:plan.index("hashpartitioning(_seq_b")] and "_ooff0#" not in below.split("Union")[0]
