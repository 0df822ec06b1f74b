"""Edge cases: zero denominators, all-null / constant columns, ties, duplicates, dates, aliases."""
import pytest
from pyspark.sql import functions as F

from adloom.operators import profile as P
from adloom.plans.pipeline import CleanOptions, clean_dataset

SCHEMA = ("date string, campaign string, impressions bigint, clicks bigint, conversions bigint, "
          "spend double, price double, quantity bigint")


def _df(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_zero_denominators(spark):
    rows = [("2024-01-01", "a_search", 0, 0, 0, 0.0, 0.0, 0),
            ("2024-01-02", "b_video", 10, 5, 0, 2.0, 1.0, 1),
            ("2024-01-03", "c", 20, 2, 1, 4.0, 3.0, 2)]
    out = clean_dataset(_df(spark, rows)).df.orderBy("date").collect()
    assert out[0]["ctr"] == 0.0 and out[0]["roas"] == 0.0 and out[0]["profit_margin"] == 0.0
    assert out[1]["cpa"] == 2.0  # spend / (0 -> 1)
    assert out[0]["channel"] == "Search" and out[2]["channel"] == "Other"


def test_all_null_and_constant_columns(spark):
    rows = [("2024-01-0%d" % i, None, 5, i, 1, 1.0, 2.0, i) for i in range(1, 6)]
    res = clean_dataset(_df(spark, rows))
    cols = res.df.columns
    assert "z_impressions" not in cols and "z_conversions" not in cols  # constant
    assert "z_clicks" in cols
    assert res.df.select("campaign").distinct().collect()[0][0] == "Unknown"


def test_tied_roas_has_no_tier(spark):
    rows = [("2024-01-0%d" % i, "x", 10, 1, 1, 1.0, 1.0, 1) for i in range(1, 7)]
    res = clean_dataset(_df(spark, rows))
    assert "spend_efficiency_tier" not in res.df.columns


def test_duplicates_with_nulls(spark):
    rows = [("2024-01-01", None, 1, 1, 1, None, 1.0, 1)] * 3 + [("2024-01-02", "b", 2, 2, 2, 2.0, 2.0, 2)]
    df = _df(spark, rows)
    r = P.duplicate_rate(df).first()
    assert (r["rows"], r["duplicates"]) == (4, 2)
    assert clean_dataset(df).df.count() == 2


def test_mode_ties_take_smallest(spark):
    rows = [("2024-01-01", "b", 1, 1, 1, 1.0, 1.0, 1), ("2024-01-02", "a", 1, 1, 1, 1.0, 1.0, 1),
            ("2024-01-03", None, 1, 2, 1, 1.0, 1.0, 1)]
    out = clean_dataset(_df(spark, rows)).df.where(F.col("date").cast("string").startswith("2024-01-03")).first()
    assert out["campaign"] == "a"


def test_unparseable_dates_revert(spark):
    rows = [("yesterday", "x", 1, 1, 1, 1.0, 1.0, 1), ("soon", "y", 2, 3, 1, 1.0, 2.0, 2)]
    res = clean_dataset(_df(spark, rows))
    assert dict(res.df.dtypes)["date"] == "string" and "day_of_week" not in res.df.columns


def test_alias_renames_and_collisions(spark):
    df = spark.createDataFrame([("2024-01-01", 5, 7, 2.0, 3), ("2024-01-02", 6, 8, 3.0, 4)],
                               "date string, views long, impressions long, cost double, qty long")
    res = clean_dataset(df)
    cols = res.df.columns
    assert "views" in cols and "impressions" in cols  # canonical already present: alias kept
    assert "price" in cols and "quantity" in cols and "revenue" in cols
    assert any("not renamed" in w for w in res.report["warnings"])


def test_mean_fill_and_constant_fill(spark):
    rows = [("2024-01-01", None, 1, 1, 1, None, 1.0, 1), ("2024-01-02", "b", 2, 2, 2, 4.0, 2.0, 2),
            ("2024-01-03", "c", 3, 3, 3, 2.0, 3.0, 3)]
    res = clean_dataset(_df(spark, rows), CleanOptions(strategy_numeric="mean", strategy_categorical="constant"))
    first = res.df.orderBy("date").first()
    assert first["spend"] == pytest.approx(3.0) and first["campaign"] == "Unknown"


def test_validation_fatal(spark):
    assert not P.validate(spark.createDataFrame([(1,)], "a long"))["valid"]
    assert not P.validate(spark.createDataFrame([], "a long, b long"))["valid"]


def test_existing_columns_are_overwritten(spark):
    for dated in (True, False):
        rows = [(f"2024-01-0{i}", 2.0, i, 9999.0, 0.5, "raw", "raw", 10 * i, 100, 5.0) for i in range(1, 6)]
        df = spark.createDataFrame(rows, "date string, price double, quantity long, revenue double, ctr double, month string, quarter string, "
                                         "clicks long, impressions long, spend double")
        df = df if dated else df.drop("date")
        res = clean_dataset(df)
        out = sorted(res.df.collect(), key=lambda r: r["quantity"])
        assert [r["revenue"] for r in out] == [2.0, 4.0, 6.0, 8.0, 10.0] and [r["profit"] for r in out] == [-3.0, -1.0, 1.0, 3.0, 5.0]
        assert [r["ctr"] for r in out] == pytest.approx([0.1, 0.2, 0.3, 0.4, 0.5])
        assert [r["revenue_percentile"] for r in out] == pytest.approx([20, 40, 60, 80, 100])
        assert out[0]["z_revenue"] == pytest.approx(-1.2649) and out[0]["month"] == ("2024-01" if dated else "raw")
        assert res.df.columns[:len(df.columns)] == df.columns
        if dated:
            assert [r["revenue_cumulative"] for r in out] == [2.0, 6.0, 12.0, 20.0, 30.0]
            assert [r["revenue_ma3"] for r in out] == [2.0, 3.0, 4.0, 6.0, 8.0]


def test_one_date_layout_per_column(spark):
    texts = ["13/02/2024", "05/02/2024", "06/02/2024", "20/02/2024"]
    df = spark.createDataFrame([(t, float(i)) for i, t in enumerate(texts)], "date string, x double")
    assert [str(r["date"])[:10] for r in clean_dataset(df).df.orderBy("x").collect()] == [
        "2024-02-13", "2024-02-05", "2024-02-06", "2024-02-20"]
    both = spark.createDataFrame([("05/02/2024", 1.0), ("06/03/2024", 2.0)], "date string, x double")
    assert [str(r["date"])[:10] for r in clean_dataset(both).df.orderBy("x").collect()] == ["2024-05-02", "2024-06-03"]  # ties: month first


def test_validation_has_outliers_profile_and_order_of_checks(spark):
    df = spark.createDataFrame([(float(i % 5), "a", i % 2 == 0) for i in range(50)] + [(1e6, "b", True)], "x double, s string, flag boolean")
    rep = P.validate(df)
    assert rep["valid"] and [o["column"] for o in rep["outliers"]] == ["x"] and any("outlier" in w for w in rep["warnings"])
    assert {p["column"] for p in rep["profile"]} == {"x", "s", "flag"} and {t["column"] for t in rep["top_values"]} == {"s", "flag"}
    empty = P.validate(spark.createDataFrame([], "a long"))
    assert empty["errors"] == ["no rows"] and not empty["valid"]


def test_profile_jobs_do_not_grow_with_the_columns(spark):
    def jobs(columns):
        df = spark.range(200).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(columns)])
        group = f"profile-{columns}"
        spark.sparkContext.setJobGroup(group, group)
        P.column_profile(df)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found
    assert jobs(2) == jobs(12) > 0


def test_change_report_is_complete(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, 3.0, None)], "views long, cost double, s string")
    r = P.change_report(df, CleanOptions(strategy_numeric="mean")).first()
    assert (r["rows_before"], r["rows_after"], r["duplicates_removed"], r["nulls_filled"]) == (3, 2, 1, 2)
    assert r["strategy_numeric"] == "mean" and r["columns_dropped"] == "" and "ctr" not in r["columns_added"]
