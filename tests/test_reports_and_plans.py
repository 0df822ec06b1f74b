"""A4 labels, A20 digest text, skew handling of the ordered operators, plan shape."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.operators import reports as R
from adloom.operators.ordered import BUCKET, PLACE, OrderConfig, n_buckets, sequence_ops, sort_orders
from adloom.operators.roles import detect_roles, roles_frame
from adloom.plans.catalog import cleaned
from adloom.plans.views import view
from adloom.session import materialize
from conftest import SF001


def test_roles_and_labels(spark):
    res = cleaned(spark, SF001, "sales_facts")
    roles = detect_roles(res.df.schema)
    assert roles["date"] == "date" and roles["revenue"] == "revenue" and roles["clicks"] == "clicks"
    assert roles["impressions"] == "impressions" and roles["ctr"] == "ctr" and roles["conversions"] == "conversions"
    labels = {r["role"]: r["label"] for r in roles_frame(spark, res.df).collect()}
    assert labels["revenue"] == "Revenue" and labels["ctr"] == "Ctr"


def test_metric_roles_skip_text_columns(spark):
    df = spark.createDataFrame([("a", 1.0)], "price_band string, revenue_total double")
    assert detect_roles(df.schema)["revenue"] == "revenue_total"


def test_digest_text(spark):
    res = cleaned(spark, SF001, "ad_facts")
    text = R.digest_text(res.df).first()["digest"]
    assert text.startswith("Dataset: table\nTotal Records: ") and "Total Revenue: $" in text and "clicks: min=" in text
    assert "Average CTR: " in text and "Date Range: 2024-01-01 to " in text


def test_hot_date_is_split_across_buckets(spark):
    """A date holding a third of all rows must not land in one window task."""
    df = view(spark, SF001, "sales_facts")
    hot = df.withColumn("date", F.when(F.col("l_orderkey") % 3 == 0, F.lit("1996-01-01").cast("timestamp_ntz"))
                        .otherwise(F.col("date")))
    n = hot.count()
    cfg = OrderConfig(rows_per_bucket=300)
    nb = n_buckets(n, cfg)
    order = ["date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "price"]
    staged = materialize(hot.repartitionByRange(nb, *sort_orders(order)).withColumn(BUCKET, F.spark_partition_id()))
    sizes = [r["c"] for r in staged.groupBy(BUCKET).agg(F.count("*").alias("c")).collect()]
    hot_rows = hot.where(F.col("date") == F.lit("1996-01-01").cast("timestamp_ntz")).count()
    assert max(sizes) < hot_rows / 4          # the hot date spans several buckets
    out = sequence_ops(hot, order, n_rows=n, cum_cols=["clicks"], cfg=cfg)
    assert out.agg(F.max("clicks_cumulative")).first()[0] == hot.agg(F.sum("clicks")).first()[0]


def test_series_sort_by_the_stored_place(spark, monkeypatch):
    """The cleaned table keeps the place of each row; no series compares the keys of the order again."""
    import adloom.plans.catalog as C
    from adloom.operators.ordered import PLACE
    res = cleaned(spark, SF001, "sales_facts")
    assert PLACE not in res.df.columns and res.placed.columns == [*res.df.columns, PLACE]
    names = ["revenue_trend", "cumulative_revenue", "channel_running", "clicks_impressions_series"]
    seen = []

    def watched(df, order, **options):
        seen.append((df, order))
        return sequence_ops(df, order, **options)

    monkeypatch.setattr(C, "sequence_ops", watched)
    monkeypatch.setattr(R, "sequence_ops", watched)
    rows = lambda: {k: sorted(map(str, C.QUERIES[k](spark, SF001).collect())) for k in names}
    got = rows()
    assert len(seen) == len(names) and all("campaign_name" not in df.columns and len(order) <= 2 for df, order in seen)
    monkeypatch.setattr(C, "_in_order", lambda r: (r.df, r.order_cols))
    assert got == rows()


def test_report_scan_is_pruned(spark):
    res = cleaned(spark, SF001, "sales_facts")
    plan = R.revenue_by_date(res.df)._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "revenue" in read and "campaign_name" not in read and "z_clicks" not in read


def test_reports_without_roles_are_empty(spark):
    df = spark.createDataFrame([("a", 1)], "name string, n long")
    for report in (R.revenue_by_date, R.revenue_by_weekday, R.monthly_revenue, R.funnel, R.ctr_histogram, R.channel_revenue,
                   R.tier_distribution, R.engagement_histogram):
        assert report(df).count() == 0
    assert R.top_days(df, 5).count() == 0 and R.gauge(df).first()["rate"] == 0.0


def test_series_by_position_without_a_date(spark):
    df = spark.createDataFrame([(i, float(10 - i)) for i in range(5)], "n long, revenue double")
    rows = R.trend(df, [F.col("revenue")], [], order_cols=["n"]).collect()
    assert [(r["row_index"], r["revenue"]) for r in rows] == [(i, 10.0 - i) for i in range(5)]


def test_text_dates_are_read(spark):
    df = spark.createDataFrame([("13/02/2024", 1.0), ("05/02/2024", 2.0), ("x", 4.0), ("20/02/2024", 3.0)], "date string, revenue double")
    rows = R.revenue_by_date(df).collect()
    assert [(r["day_rank"], r["date_label"], r["revenue"]) for r in rows] == [
        (1, "2024-02-05", 2.0), (2, "2024-02-13", 1.0), (3, "2024-02-20", 3.0)]
    assert [r["date_label"] for r in R.trend(df, [F.col("revenue")], [], order_cols=["revenue"]).collect()] == [
        "2024-02-05", "2024-02-13", "2024-02-20"]


def test_histogram_bins_equal_numpy(spark):
    rng = np.random.default_rng(12)
    for _ in range(12):
        rates = (rng.integers(0, 9, 60) / rng.integers(1, 9, 60)).tolist()
        if rng.random() < 0.3:
            rates = [r / 10 for r in rates]
        got = R.ctr_histogram(spark.createDataFrame([(r,) for r in rates], "ctr double")).orderBy("bin").collect()
        values = np.array(rates) * (100 if max(rates) < 1 else 1)
        assert [r["count"] for r in got] == np.histogram(values, bins=20)[0].tolist()


def test_gauge_falls_through_zero_and_null(spark):
    df = spark.createDataFrame([(0.0, 0.15), (0.0, 0.15)], "conversion_rate double, ctr double")
    assert R.gauge(df).first()["rate"] == 15.0
    assert R.gauge(df.withColumn("conversion_rate", F.lit(None).cast("double"))).first()["rate"] == 15.0


def test_search_reads_large_numbers_in_full(spark):
    df = spark.createDataFrame([(12345678.0, "a"), (0.00052, "b"), (1.5, None)], "x double, s string")
    assert R.search(df, "12345678").count() == 1 and R.search(df, "12345678.0").count() == 1
    assert R.search(df, "0.00052").count() == 1 and R.search(df, "1.5").count() == 1 and R.search(df, "e").count() == 0


def test_deep_pages_follow_the_last_row(spark):
    rows = [(i % 7 if i % 5 else None, i % 3, i) for i in range(60)]
    df = spark.createDataFrame(rows, "v long, t long, id long")
    for ascending in (True, False):
        third = R.page(df, "v", ascending, 3, ["t", "id"], page_size=8).collect()
        last = R.page(df, "v", ascending, 2, ["t", "id"], page_size=8).collect()[-1].asDict()
        assert R.page_after(df, "v", ascending, ["t", "id"], last, page_size=8).collect() == third
        tail = R.page(df, "v", ascending, 7, ["t", "id"], page_size=8).collect()[-1].asDict()
        assert len(R.page_after(df, "v", ascending, ["t", "id"], tail, page_size=8).collect()) == 4


LOCALE_ORDER = ["a", "A", "b", "é", "Z"]


def test_text_sorts_by_locale_and_empty_cells_come_first(spark):
    cells = ["Z", None, "b", "A", "", "a", "é", "a"]
    df = spark.createDataFrame([(c, i) for i, c in enumerate(cells)], "name string, id long")
    up = [(r["name"], r["id"]) for r in R.page(df, "name", True, 1, ["id"]).collect()]
    assert up == [(None, 1), ("", 4), ("a", 5), ("a", 7), ("A", 3), ("b", 2), ("é", 6), ("Z", 0)]
    down = [r["name"] for r in R.page(df, "name", False, 1, ["id"]).collect()]
    assert down == ["Z", "é", "b", "A", "a", "a", None, ""]
    for ascending in (True, False):
        order = [tuple(r) for r in R.page(df, "name", ascending, 1, ["id"]).collect()]
        for k, (name, i) in enumerate(order[:-1]):
            after = R.page_after(df, "name", ascending, ["id"], {"name": name, "id": i}, page_size=2).collect()
            assert [tuple(r) for r in after] == order[k + 1:k + 3]


def test_any_page_by_number(spark):
    from adloom.operators.ordered import OrderConfig
    rows = [(None if i % 11 == 0 else ["x", "É", "b"][i % 3] * (1 + i % 4), None if i % 5 == 0 else float(i % 7), i) for i in range(500)]
    df = spark.createDataFrame(rows, "name string, v double, id long")
    for col, ascending in (("v", True), ("v", False), ("name", True), ("name", False)):
        pages = R.Pages(df, col, ascending, ["id"], page_size=30, cfg=OrderConfig(rows_per_bucket=40))
        assert (pages.rows, pages.count, pages.fences.count()) == (500, 17, len(pages._starts))
        for n in (1, 2, 9, 16, 17):
            assert pages.page(n).collect() == R.page(df, col, ascending, n, ["id"], 30).collect(), (col, ascending, n)
            assert len(pages.buckets_of(n)) <= 3
        assert pages.page(18).collect() == []
    empty = R.Pages(df.limit(0), "v", True, ["id"])
    assert (empty.rows, empty.count, empty.page(1).collect()) == (0, 1, [])


def test_a_page_reads_only_its_buckets(spark):
    from adloom.operators.ordered import OrderConfig
    pages = R.Pages(spark.range(5000).withColumn("v", F.col("id") % 97), "v", True, ["id"], cfg=OrderConfig(rows_per_bucket=500))
    page = pages.page(50)
    assert page.count() == 50 and len(pages.buckets_of(50)) <= 2
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_seq_b" in plan.split("PartitionFilters")[1].split("]")[0]


def test_pages_of_search_results(spark):
    df = spark.createDataFrame([(i, "needle" if i % 3 == 0 else "hay", float(-i)) for i in range(400)], "id long, t string, v double")
    found = R.search_pages(df, "NEEDLE", "v", True, ["id"], page_size=20)
    assert (found.rows, found.count) == (134, 7)
    assert [r["id"] for r in found.page(2).collect()] == [399 - 3 * k for k in range(20, 40)]


def test_pages_store_only_what_they_show_and_their_order(spark):
    rows = [(i % 7, i, f"wide {i}", -i) for i in range(300)]
    df = spark.createDataFrame(rows, "v long, id long, t string, w long")
    pages = R.Pages(df, "v", True, ["id"], page_size=20, cfg=OrderConfig(rows_per_bucket=50), columns=["w", "v"])
    assert set(pages._table.columns) == {"w", "v", "id", BUCKET}
    for n in (1, 8, 15):
        assert pages.page(n).collect() == R.page(df, "v", True, n, ["id"], 20).select("w", "v").collect()


def test_stage_tables_go_once_the_cleaned_table_is_written(spark, tmp_path):
    import glob
    import shutil
    from adloom.plans.catalog import q_deep_page
    from adloom.session import checkpoint_dir
    for name in ("lineitem", "part"):
        shutil.copy(f"{SF001}/{name}.parquet", tmp_path)
    root = checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/adloom-tables/*"))
    assert q_deep_page(spark, str(tmp_path)).count() == 50
    left = {p.split("/")[-1].split("-")[0] for p in set(glob.glob(f"{root}/adloom-tables/*")) - before}
    assert left == {"stage", "pages", "fences"}


def _marketing(spark, copies):
    """Rows of a marketing table, a third of them with copies, nulls and both zeros."""
    rows = [(f"2024-01-{1 + i % 9:02d}", "US_Brand_Search" if i % 4 else None, 100 + i % 50, i % 17, i % 5, None if i % 10 == 0 else 1.0 + i % 13,
             0.0 if i % 3 else -0.0, 1.0 + i % 7, i) for i in range(600)]
    rows += [r for r in rows if r[-1] % 3 == 0] * copies
    return spark.createDataFrame(rows, "d string, campaign_name string, impressions long, clicks long, conversions long, spend double, price double, "
                                       "quantity double, id long").withColumn("d", F.col("d").cast("timestamp_ntz")).withColumnRenamed("d", "date")


def _stage_tables(spark):
    import os
    from adloom.session import checkpoint_dir
    at = checkpoint_dir(spark).removeprefix("file:") + "/adloom-tables"
    return set(os.listdir(at)) if os.path.isdir(at) else set()


@pytest.mark.parametrize("copies", [0, 2])
def test_a_table_cleaned_in_parts_is_the_same(spark, copies):
    """Copies are dropped, ranges shuffled and parts written one at a time; the rows are those of one pass."""
    from adloom.plans.pipeline import CleanOptions, clean_dataset
    df = _marketing(spark, copies)
    small = OrderConfig(rows_per_bucket=40, cells_per_range=2000, cells_per_part=1200)
    before = _stage_tables(spark)
    res = clean_dataset(df, CleanOptions(order=small))
    left = {t.split("-")[0] for t in _stage_tables(spark) - before}
    assert "sequenced" in left and "base" not in left            # no copy of the input beside the sequenced table
    one = clean_dataset(df.dropDuplicates(), CleanOptions())
    assert len(res.parts) > 3 and len(one.parts) == 1 and res.report["rows"] == one.report["rows"] == 600
    assert res.report["null_counts"] == one.report["null_counts"] and res.df.columns == one.df.columns
    parts = [p.select(*res.df.columns, PLACE).collect() for p in res.parts]
    rows = sorted((tuple(r)[:-1] for p in parts for r in p), key=str)
    assert rows == sorted(map(tuple, res.df.collect()), key=str) == sorted(map(tuple, one.df.collect()), key=str)
    full = [p for p in parts if p]
    assert len(full) > 3 and all(max(r[PLACE] for r in a) < min(r[PLACE] for r in b) for a, b in zip(full, full[1:]))


def test_rows_without_copies_are_not_shuffled_to_find_out(spark):
    """Their hashes are; a table without copies is written once, in the order it comes."""
    from adloom.operators.clean import drop_copies, may_repeat
    df = _marketing(spark, 0)
    assert not may_repeat(df) and may_repeat(df.unionAll(df.limit(1))) and not may_repeat(df.limit(0))
    twice = _marketing(spark, 2)
    parts = [p.collect() for p in drop_copies(twice, 4)]
    assert all(parts) and sorted((tuple(r) for p in parts for r in p), key=str) == sorted(map(tuple, twice.dropDuplicates().collect()), key=str)


def test_a_part_reads_its_buckets_only(spark):
    from adloom.plans.pipeline import CleanOptions, clean_dataset
    res = clean_dataset(_marketing(spark, 0), CleanOptions(order=OrderConfig(rows_per_bucket=40, cells_per_part=1200)))
    plan = res.parts[1]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_seq_b" in plan and "LessThan(_seq_b" in plan
