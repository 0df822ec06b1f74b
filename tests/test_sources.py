"""CSV ingestion (S1-S3, S17), versioned tables and audit logs."""
import os

from pyspark.sql import functions as F

from adloom.operators.clean import sanitize_table_name, sanitize_table_name_col
from adloom.operators.profile import snapshot_totals
from adloom.sources.csv import read_csv
from adloom.sources.tables import AuditLog, TableCache, TableStore


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text.encode(encoding))


def test_null_tokens_and_inference(spark, tmpdir_path):
    p = f"{tmpdir_path}/a.csv"
    _write(p, "id,amount,flag,name,empty\n1,2.5,True,x,\n2,NA,false,N/A,\n3,nan,TRUE,null,\n")
    df, info = read_csv(spark, p)
    assert info["types"] == {"id": "bigint", "amount": "double", "flag": "boolean", "name": "string",
                             "empty": "double"}
    rows = df.orderBy("id").collect()
    assert rows[1]["amount"] is None and rows[1]["name"] is None and rows[2]["name"] is None
    assert [r["flag"] for r in rows] == [True, False, True]


def test_latin1_fallback(spark, tmpdir_path):
    p = f"{tmpdir_path}/l.csv"
    _write(p, "name,city\nJosé,São Paulo\n", encoding="latin-1")
    df, info = read_csv(spark, p)
    assert info["encoding"] == "ISO-8859-1"
    assert df.first()["city"] == "São Paulo"


def test_encoding_is_decided_by_file(spark, tmpdir_path):
    _write(f"{tmpdir_path}/m/utf 8.csv", "name,city\nJosé,Zürich\n")
    _write(f"{tmpdir_path}/m/latin.csv", "name,city\nRenée,São Paulo\n", encoding="latin-1")
    _write(f"{tmpdir_path}/m/mark.csv", "name,city\nbad \ufffd mark é,Paris\n")
    df, info = read_csv(spark, f"{tmpdir_path}/m")
    assert info["encoding"] == "ISO-8859-1, UTF-8"
    assert {r["name"] for r in df.collect()} == {"José", "Renée", "bad \ufffd mark é"}


def test_codes_are_not_numbers_and_quoted_breaks_stay(spark, tmpdir_path):
    _write(f"{tmpdir_path}/c.csv", 'sku,text,n,f\n1d,"x\ny",2,1e3\n2f,"a, b",+3,.5\n30D,z,-4,inf\n')
    df, info = read_csv(spark, f"{tmpdir_path}/c.csv")
    assert info["types"] == {"sku": "string", "text": "string", "n": "bigint", "f": "double"}
    assert sorted(tuple(r) for r in df.collect()) == [("1d", "x\ny", 2, 1000.0), ("2f", "a, b", 3, 0.5), ("30D", "z", -4, float("inf"))]


def test_sanitize_table_name():
    assert sanitize_table_name("Sales Data (2024).csv") == "sales_data_2024"
    assert sanitize_table_name("2024 report.CSV") == "t_2024_report"
    assert sanitize_table_name("spend.xlsx") == "spend"


def test_sanitize_table_name_column(spark):
    names = ["Sales Data (2024).csv", "2024 report.CSV", "__x__.xls", "spend.xlsx", "é!"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(sanitize_table_name_col(F.col("n")).alias("t")).collect()
    assert [r["t"] for r in rows] == [sanitize_table_name(n) if n != "é!" else "" for n in names]


def test_versions_archive_and_listing(spark, tmpdir_path):
    store = TableStore(spark, tmpdir_path, "tenant_a")
    other = TableStore(spark, tmpdir_path, "tenant_b")
    assert not store.exists("x_cleaned")
    store.ensure(spark.range(3).withColumnRenamed("id", "a"), "x_cleaned")
    store.write(spark.range(5).withColumnRenamed("id", "a"), "x_cleaned")
    store.write(spark.range(7).withColumnRenamed("id", "a"), "x_cleaned")
    vc = store.version_counts("x_cleaned").collect()
    assert [r["rows"] for r in vc] == [7, 5, 0] and vc[0]["is_current"]
    assert store.read("x_cleaned").count() == 7
    assert not other.exists("x_cleaned")
    other.write(spark.range(2).withColumnRenamed("id", "a"), "y_cleaned")
    assert [(r["table"], r["rows"]) for r in store.list_tables().collect()] == [("x_cleaned", 7)]
    store.purge_namespace()
    assert not store.exists("x_cleaned") and other.exists("y_cleaned")
    out = f"{tmpdir_path}/export"
    TableStore.export_csv(other.read("y_cleaned"), out)
    assert spark.read.option("header", True).csv(out).count() == 2


def test_audit_log(spark, tmpdir_path):
    audit = AuditLog(spark, tmpdir_path)
    audit.record_run("t_cleaned", "t.csv", {"rows": 3}, {"rows": 2})
    audit.record_run("t_cleaned", "t.csv", {"rows": 4}, {"rows": 4})
    latest = audit.latest_run("t_cleaned").first()
    assert (latest["rows_before"], latest["rows_after"], latest["rows_diff"]) == (4, 4, 0)
    for _ in range(2):                       # a replayed run counts once
        audit.record_run("r_cleaned", "r.csv", {"rows": 1}, {}, status="failed: " + "x" * 900, run_key="7:r.csv")
    assert audit.runs().where("table_name = 'r_cleaned'").count() == 1
    assert len(audit.latest_run("r_cleaned").first()["status"]) == 908
    audit.record_upload("u1", "t_cleaned", "t.csv", 4, 8)
    audit.record_upload("u2", "z_cleaned", "z.csv", 1, 2)
    assert [r["table_name"] for r in audit.uploads("u1").collect()] == ["t_cleaned"]
    assert audit.runs().where(F.col("status") == "ok").count() == 2


def test_validate_batch_by_file(spark, tmpdir_path):
    from adloom.operators.profile import validate_by_file
    from adloom.sources.csv import CsvOptions
    folder = f"{tmpdir_path}/batch"
    _write(f"{folder}/one.csv", "a,b,c\n1,x,\n1,x,\n2,y,\n")
    _write(f"{folder}/two.csv", "a,b,c\n3,z,q\n4,,r\n")
    df, _ = read_csv(spark, folder, CsvOptions(with_file_name=True))
    got = {r["file"]: r for r in validate_by_file(df).collect()}
    assert (got["one.csv"]["rows"], got["one.csv"]["duplicates"], got["one.csv"]["nulls"]) == (3, 1, 3)
    assert got["one.csv"]["all_null_columns"] == ["c"] and got["two.csv"]["all_null_columns"] == []
    assert (got["two.csv"]["rows"], got["two.csv"]["duplicates"], got["two.csv"]["nulls"]) == (2, 0, 1)
    assert got["one.csv"]["valid"] and got["two.csv"]["valid"]


def test_cache_ends_with_time_and_versions(spark, tmpdir_path):
    now = [0.0]
    store = TableStore(spark, tmpdir_path, "c")
    store.write(spark.range(3), "t")
    cache = TableCache(store, ttl=10.0, clock=lambda: now[0])
    first = cache.read("t")
    assert cache.read("t") is first and first.count() == 3
    store.write(spark.range(5), "t")
    second = cache.read("t")
    assert second.count() == 5 and not first.is_cached
    now[0] = 11.0
    assert cache.read("t") is not second
    cache.invalidate("t")


def test_snapshots_hold_the_numeric_summary(spark):
    snap = snapshot_totals(spark.createDataFrame([(1.0, "a"), (3.0, None)], "x double, s string"))
    assert snap["numeric_summary"] == {"x": {"min": 1.0, "max": 3.0, "mean": 2.0, "std": 1.4142}} and snap["total_nulls"] == 1


def test_columns_are_matched_by_name(spark, tmpdir_path):
    f = f"{tmpdir_path}/mixed"
    _write(f"{f}/a.csv", "clicks,price\n1,100.5\n2,200.5\n")
    _write(f"{f}/b.csv", "price,clicks\n300.5,3\n400.5,4\n")
    _write(f"{f}/c.csv", "Clicks ,price,extra\n5,500.5,x\n")
    df, info = read_csv(spark, f)
    assert info["layouts"] == 3 and info["types"] == {"Clicks ": "bigint", "price": "double", "extra": "string"}
    got = sorted(tuple(r) for r in df.select("`Clicks `", "price", "extra").collect())
    assert got == [(1, 100.5, None), (2, 200.5, None), (3, 300.5, None), (4, 400.5, None), (5, 500.5, "x")]


def test_one_layout_reads_the_folder_and_no_file_names(spark, tmpdir_path):
    from adloom.sources.csv import CsvOptions, layouts
    for i in range(4):
        _write(f"{tmpdir_path}/same/{i}.csv", f"a,b\n{i},x\n")
    found = layouts(spark, f"{tmpdir_path}/same", CsvOptions())
    assert len(found) == 1 and found[0].files is None and not found[0].breaks
    df, _ = read_csv(spark, f"{tmpdir_path}/same", CsvOptions(with_file_name=True))
    assert sorted((r["a"], r["_file_name"]) for r in df.collect()) == [(i, f"{i}.csv") for i in range(4)]


def test_odd_headers(spark, tmpdir_path):
    from adloom.sources.csv import header_names
    assert header_names(["a", "a", "A", "", "a.1", "b c", "B_C", " "]) == ["a", "a.1", "A.2", "Unnamed: 3", "a.1.1", "b c", "B_C.1", "Unnamed: 7"]
    _write(f"{tmpdir_path}/h/a.csv", "﻿a,a,\"x, y\",c.d\n1,2,3,4\n\n5,6,7,8\n")
    _write(f"{tmpdir_path}/h/b.csv", "\"two\nlines\",a\n9,10\n")
    _write(f"{tmpdir_path}/h/latin.csv", "größe,a\n11,12\n", encoding="latin-1")
    df, info = read_csv(spark, f"{tmpdir_path}/h")
    assert set(df.columns) == {"a", "a.1", "x, y", "c.d", "two\nlines", "größe"} and info["encoding"] == "ISO-8859-1, UTF-8"
    assert sorted(r["a"] for r in df.collect()) == [1, 5, 10, 12]
    assert [r["größe"] for r in df.where("`größe` IS NOT NULL").collect()] == [11]


def test_names_with_dots_pass_validation_and_cleaning(spark, tmpdir_path):
    from adloom.operators.profile import validate
    from adloom.plans.pipeline import clean_dataset
    _write(f"{tmpdir_path}/dots.csv", "date,cost.usd,cost.usd,a`b,clicks\n2024-01-01,1,2,x,5\n2024-01-02,,3,,6\n2024-01-03,4,9,y,9\n2024-01-04,4,9,y,9\n")
    df, _ = read_csv(spark, f"{tmpdir_path}/dots.csv")
    assert validate(df)["valid"]
    rows = clean_dataset(df).df.orderBy("date").collect()
    assert [r["cost.usd"] for r in rows] == [1, 0, 4, 4] and [r["a`b"] for r in rows] == ["x", "y", "y", "y"]
    assert [r["clicks_cumulative"] for r in rows] == [5, 11, 20, 29] and "z_cost.usd.1" in rows[0]


def test_files_without_quoted_breaks_are_split(spark, tmpdir_path):
    from adloom.sources.csv import CsvOptions, layouts, read_layout
    _write(f"{tmpdir_path}/big.csv", "a,b\n" + "1,xxxxxxxxxxxxxxxxxxxxxxxx\n" * 60_000)
    _write(f"{tmpdir_path}/quoted.csv", 'a,b\n1,"x\ny"\n' + "1,xxxxxxxxxxxxxxxxxxxxxxxx\n" * 60_000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        parts = {}
        for name in ("big", "quoted"):
            layout = layouts(spark, f"{tmpdir_path}/{name}.csv", CsvOptions())[0]
            df = read_layout(spark, f"{tmpdir_path}/{name}.csv", layout, CsvOptions())
            parts[name] = (df.rdd.getNumPartitions(), df.count())
        assert parts["big"][0] > 3 and parts["big"][1] == 60_000 and parts["quoted"] == (1, 60_001)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
