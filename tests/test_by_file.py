"""Validation and cleaning of a batch of files, keyed by file, against one file after the other."""
import random

import pytest
from pyspark.sql import functions as F

from adloom.operators import profile as P


def batch(spark, n_files=5, seed=1):
    """Files of very different sizes (one holds most rows), nulls, copies, an outlier, an empty column."""
    rng = random.Random(seed)
    rows = []
    for f in range(n_files):
        for i in range([240, 1, 3, 24, 11][f % 5]):
            row = (f"f{f}.csv", f"2024-0{1 + i % 3}-0{1 + i % 7}" if i % 11 else None, rng.choice(["US_Search_A", "UK_RTG_Email", "x_social", None]),
                   rng.randint(0, 900) if i % 5 else None, float(rng.randint(1, 90)), round(rng.random() * 9, 2) if f != 1 else None,
                   1e6 if i == 20 else float(i % 4), None, rng.choice([True, False]))
            rows += [row] * (2 if i % 9 == 0 else 1)
    return spark.createDataFrame(rows, "file string, date string, campaign_name string, clicks long, impressions double, price double, "
                                       "`quantity` double, nothing double, flag boolean")


def by_hand(df):
    """The single-purpose operators, one after the other."""
    return {"summary": P.dataset_summary(df).first().asDict(), "snapshot": P.snapshot_totals(df),
            "outliers": [r.asDict() for r in P.outlier_summary(df).collect()],
            "profile": [r.asDict() for r in P.column_profile(df).collect()],
            "top_values": sorted((r.asDict() for r in P.top_values(df).collect()), key=lambda r: (df.columns.index(r["column"]), r["rank"])),
            "warnings": [P.WORDING[r["rule"]].format(r["column"], r["measure"]) for r in P.validation_report(df).collect()]}


def test_reports_equal_those_of_each_file(spark):
    df = batch(spark).cache()
    got = P.reports_by_file(df, "file")
    assert set(got) == {f"f{k}.csv" for k in range(5)}
    for f, report in got.items():
        want = by_hand(df.where(F.col("file") == f).drop("file"))
        assert report["valid"] and not report["errors"]
        for k, v in want.items():
            assert report[k] == v, (f, k)


def test_one_table_and_fatal_cases(spark):
    df = batch(spark, 1).drop("file")
    want = by_hand(df)
    got = P.validate(df)
    assert {k: got[k] for k in want} == want
    assert P.validate(df.limit(0))["errors"] == ["no rows"]
    assert P.validate(df.select("clicks"))["errors"] == ["1 column(s); at least 2 are needed"]


def test_jobs_depend_neither_on_files_nor_on_columns(spark):
    def jobs(df):
        spark.sparkContext.setJobGroup(f"g{id(df)}", "count")
        P.reports_by_file(df, "file")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"g{id(df)}"))
    small = jobs(batch(spark, 1).select("file", "clicks", "campaign_name"))
    large = jobs(batch(spark, 5))
    spark.sparkContext._jsc.clearJobGroup()
    assert large <= small and large <= 24, (small, large)   # a job is a query stage here


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-9, abs=1e-9, nan_ok=True)
    return a == b


@pytest.mark.parametrize("options", [{}, {"strategy_numeric": "mean", "strategy_categorical": "constant"}])
def test_cleaning_equals_that_of_each_file(spark, options):
    from adloom.operators.ordered import OrderConfig
    from adloom.plans.batch import FILE, clean_files
    from adloom.plans.pipeline import CleanOptions, clean_dataset
    opt = CleanOptions(order=OrderConfig(rows_per_bucket=40), **options)
    df = batch(spark).withColumn("spend", F.col("price") * 3).withColumn("conversions", (F.col("clicks") % 7).cast("long"))
    # a file with dates day first, one without any date in its date column
    df = df.withColumn("date", F.when(F.col("file") == "f3.csv", F.concat(F.substring("date", 9, 2), F.lit("/"), F.substring("date", 6, 2), F.lit("/2024")))
                       .when(F.col("file") == "f4.csv", F.lit("soon")).otherwise(F.col("date"))).cache()
    seen = set()
    for got in clean_files(df, "file", opt):
        rows = [r.asDict() for r in got.df.collect()]
        for f, columns in got.columns.items():
            seen.add(f)
            want = clean_dataset(df.where(F.col("file") == f).drop("file"), opt)
            assert columns == want.df.columns, f
            assert {k: got.reports[f][k] for k in ("rows", "null_counts", "filled")} == {k: want.report[k] for k in ("rows", "null_counts", "filled")}
            key = lambda r: [str(r[c]) for c in want.raw_columns]
            a = sorted((r for r in rows if r[FILE] == f), key=key)
            b = sorted((r.asDict() for r in want.df.collect()), key=key)
            assert len(a) == len(b)
            for x, y in zip(a, b):
                assert all(same(x[c], y[c]) for c in columns), (f, [(c, x[c], y[c]) for c in columns if not same(x[c], y[c])])
    assert seen == {f"f{k}.csv" for k in range(5)}
