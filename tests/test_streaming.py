"""Incremental folder ingest (S4) with per-file isolation (V14) and a run summary."""
import os

from adloom.session import checkpoint_dir
from adloom.sources.tables import AuditLog, TableStore
from adloom.streaming.ingest import ingest_folder, process_file, run_summary

GOOD = ("date,campaign_name,impressions,clicks,conversions,spend,price,quantity\n"
        "2024-05-01,US_Search_A,1000,50,5,20.0,10.0,3\n"
        "2024-05-02,UK_RTG_Display,800,300,0,15.0,12.0,1\n"
        "2024-05-03,FR_Social,900,40,2,10.0,9.0,2\n"
        "2024-05-04,DE_Email,700,35,1,5.0,7.0,2\n")


def _w(folder, name, text):
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_incremental_ingest(spark, tmpdir_path):
    inbox = os.path.join(tmpdir_path, "inbox")
    os.makedirs(inbox)
    store, audit = TableStore(spark, f"{tmpdir_path}/wh", "t1"), AuditLog(spark, f"{tmpdir_path}/wh")
    ck = f"{tmpdir_path}/ck"
    _w(inbox, "a.csv", GOOD)
    _w(inbox, "a_cleaned.csv", GOOD)      # looks like an output: ignored
    _w(inbox, "bad.csv", "only_one_column\n1\n2\n")  # invalid: one column
    ingest_folder(spark, inbox, store, audit, ck).awaitTermination()
    assert store.exists("a_cleaned") and store.read("a_cleaned").count() == 4
    assert not store.exists("a_cleaned_cleaned")
    assert tuple(run_summary(audit).first()) == (2, 1, 1, 1, 0)      # scanned, passed, succeeded, invalid, failed
    # second arrival: only the new file is processed
    _w(inbox, "b.csv", GOOD)
    ingest_folder(spark, inbox, store, audit, ck).awaitTermination()
    assert tuple(run_summary(audit).first()) == (3, 2, 2, 1, 0)
    assert len(store.versions("a_cleaned")) == 1 and store.exists("b_cleaned")


def test_a_replayed_batch_leaves_one_record_and_no_stage_tables(spark, tmpdir_path):
    _w(tmpdir_path, "a.csv", GOOD)
    store, audit = TableStore(spark, f"{tmpdir_path}/wh", "t1"), AuditLog(spark, f"{tmpdir_path}/wh")
    root = checkpoint_dir(spark).removeprefix("file:") + "/adloom-tables"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    for _ in range(2):
        process_file(spark, f"{tmpdir_path}/a.csv", "a.csv", store, audit, run_key="0:a.csv")
    assert audit.runs().count() == 1 and run_summary(audit).first()["succeeded"] == 1
    assert {p for p in os.listdir(root)} == before
    assert store.read("a_cleaned").count() == 4


def test_a_batch_equals_its_files_one_by_one(spark, tmpdir_path):
    """Two layouts, other column types, an empty and a bad file; tables and records as for single files."""
    from adloom.streaming.ingest import file_results, process_files
    inbox = os.path.join(tmpdir_path, "inbox")
    os.makedirs(inbox)
    _w(inbox, "a.csv", GOOD)
    _w(inbox, "b.csv", GOOD.replace("2024-05-01", "").replace("1000", "n/a"))
    _w(inbox, "c d.csv", "clicks,date,note\n1,2024-01-01,x\n2.5,2024-01-02,\n7,2024-01-03,y\n7,2024-01-03,y\n")
    _w(inbox, "e.csv", "only\n1\n")
    _w(inbox, "f.csv", "x,y\n")
    _w(inbox, "g.csv", GOOD.replace("20.0", "twenty"))       # an amount that is no number: this file fails
    names = sorted(os.listdir(inbox))
    one, many = (TableStore(spark, f"{tmpdir_path}/{k}", "t") for k in ("one", "many"))
    log1, log2 = AuditLog(spark, f"{tmpdir_path}/one"), AuditLog(spark, f"{tmpdir_path}/many")
    for n in names:
        process_file(spark, f"{inbox}/{n}", n, one, log1)
    got = process_files(spark, [f"{inbox}/{n}" for n in names], many, log2)
    assert {r["file"]: r["status"] for r in got} == {"a.csv": "ok", "b.csv": "ok", "c d.csv": "ok", "e.csv": "invalid", "f.csv": "invalid", "g.csv": "failed"}
    assert tuple(run_summary(log1).first()) == tuple(run_summary(log2).first())
    a, b = ({r["source_file"]: (r["table_name"], r["rows_before"], r["rows_after"]) for r in file_results(x).where("status = 'ok'").collect()} for x in (log1, log2))
    assert a == b and len(a) == 3
    for table, _, _ in a.values():
        x, y = one.read(table), many.read(table)
        assert x.columns == y.columns and x.dtypes == y.dtypes
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    assert many.version_counts("a_cleaned").first()["rows"] == 4
    assert not [d for d in os.listdir(f"{tmpdir_path}/many/t") if d.startswith("_batch")]


def test_a_group_that_fails_is_done_file_by_file(spark, tmpdir_path, monkeypatch):
    from adloom.streaming import ingest
    for n in ("a.csv", "b.csv"):
        _w(tmpdir_path, n, GOOD)

    def fail(*_):
        raise RuntimeError("lost")
    monkeypatch.setattr(ingest, "_process_group", fail)
    store, audit = TableStore(spark, f"{tmpdir_path}/wh", "t"), AuditLog(spark, f"{tmpdir_path}/wh")
    ingest.process_files(spark, [f"{tmpdir_path}/a.csv", f"{tmpdir_path}/b.csv"], store, audit)
    assert tuple(run_summary(audit).first()) == (2, 2, 2, 0, 0) and store.read("b_cleaned").count() == 4
