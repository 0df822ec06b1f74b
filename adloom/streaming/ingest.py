"""Incremental pickup of new files from a folder (S4) with per-file validation
(V14) and a run summary (V15).

A Structured Streaming file source lists the folder; its checkpoint remembers
which files were already processed, so a second run only sees new arrivals
(``Trigger.AvailableNow`` processes everything new and stops).  Only file
*metadata* flows through the stream (``binaryFile`` with the content column
pruned).  Inside ``foreachBatch`` the new files are grouped by layout (header,
encoding, quoted breaks) and column types; each group is validated, cleaned and
written by jobs whose number does not depend on its files, with every statistic
keyed by file (plans/batch.py).  A group whose jobs fail is done again file by
file, so a failing file is recorded and does not stop the others.  Output tables
are written in a new version each time, so a retried micro-batch (after a driver
or executor loss) rewrites a version instead of corrupting one.
"""

from __future__ import annotations

import traceback
from dataclasses import replace
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.operators.clean import sanitize_table_name
from adloom.operators.profile import reports_by_file, snapshot_totals, validate
from adloom.plans.batch import FILE, clean_files
from adloom.plans.pipeline import CleanOptions, clean_dataset
from adloom.sources.csv import CsvOptions, layouts, null_tokens, read_csv, read_layout, type_counts, type_name, typed_cell
from adloom.session import materialize, stage_scope
from adloom.sources.tables import AuditLog, TableStore

CLEANED_SUFFIX = "_cleaned"
BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def new_files(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame of new ``*.csv`` files not named like an output."""
    files = (spark.readStream.format("binaryFile")
             .schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", "*.csv")
             .option("maxFilesPerTrigger", max_files_per_trigger)
             .load(folder)
             .select("path", "modificationTime", "length"))
    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    return files.where(~name.contains(CLEANED_SUFFIX)).withColumn("file_name", name)


def process_file(spark: SparkSession, path: str, file_name: str, store: TableStore, audit: AuditLog,
                 options: CleanOptions | None = None, csv: CsvOptions | None = None,
                 run_key: str | None = None) -> dict:
    """Read -> validate -> clean -> write one file; returns its run record.

    Stage tables go as soon as the cleaned table is written."""
    with stage_scope(spark):
        return _process(spark, path, file_name, store, audit, options, csv, run_key)


def _process(spark, path, file_name, store, audit, options, csv, run_key) -> dict:
    table = sanitize_table_name(file_name) + CLEANED_SUFFIX
    try:
        df, info = read_csv(spark, path, csv)
        report = validate(df)
        before = report.get("snapshot", {"rows": 0, "columns": len(df.columns)})
        if not report["valid"]:
            audit.record_run(table, file_name, before, {}, status="invalid: " + "; ".join(report["errors"]),
                             run_key=run_key)
            return {"file": file_name, "table": table, "status": "invalid", "errors": report["errors"]}
        res = clean_dataset(df, options)
        store.write(res.df, table)
        after = snapshot_totals(store.read(table))
        audit.record_run(table, file_name, before, after, status="ok", run_key=run_key)
        return {"file": file_name, "table": table, "status": "ok", "rows_before": before["rows"],
                "rows_after": after["rows"], "encoding": info["encoding"], "warnings": report["warnings"]}
    except Exception as e:  # noqa: BLE001 - one bad file must not stop the batch
        audit.record_run(table, file_name, {}, {}, status=f"failed: {type(e).__name__}: {e}", run_key=run_key)
        return {"file": file_name, "table": table, "status": "failed",
                "error": traceback.format_exception_only(type(e), e)[-1].strip()}


def file_groups(spark: SparkSession, paths: list[str], csv: CsvOptions) -> tuple[list[tuple[list[str], DataFrame, str]], dict[str, str]]:
    """(file names, typed rows with ``_file_name``, encoding) of files with one layout and the
    same column types; and what is wrong with files that have no row."""
    groups, seen = [], set()
    for layout in layouts(spark, paths, csv):
        text = materialize(null_tokens(read_layout(spark, paths, layout, replace(csv, with_file_name=True)), csv), "batch-text")
        found = text.groupBy("_file_name").agg(*type_counts(layout.columns)) \
            .select("_file_name", *[type_name(i).alias(f"t{i}") for i in range(len(layout.columns))])
        by_types: dict[tuple, list[str]] = {}
        for r in found.collect():                     # a row per file of the batch
            by_types.setdefault(tuple(r)[1:], []).append(r["_file_name"])
        for types, files in sorted(by_types.items()):
            few = spark.createDataFrame([(f,) for f in files], "_file_name string")   # names as Spark writes them, quoted
            rows = text if len(by_types) == 1 else text.join(F.broadcast(few), "_file_name", "left_semi")
            typed = rows.select("_file_name", *[typed_cell(c, t) for c, t in zip(layout.columns, types)])
            groups.append((sorted(files), typed, layout.encoding))
            seen |= set(files)
    return groups, {f: "no rows" for f in (p.rsplit("/", 1)[-1] for p in paths) if f not in set(map(unquote, seen))}


def _own_snapshot(whole: dict, columns: list[str]) -> dict:
    """A snapshot of a batch's table as that of a file with these columns."""
    nulls = {c: whole["null_per_column"][c] for c in columns}
    rows, total = whole["rows"], sum(nulls.values())
    return {**whole, "columns": len(columns), "column_names": columns, "null_per_column": nulls, "total_nulls": total,
            "null_percentage": round(total / (rows * len(columns)) * 100, 2) if rows and columns else 0,
            "dtypes": {c: whole["dtypes"][c] for c in columns},
            "numeric_summary": {c: v for c, v in whole["numeric_summary"].items() if c in nulls}}


def process_files(spark: SparkSession, paths: list[str], store: TableStore, audit: AuditLog, options: CleanOptions | None = None,
                  csv: CsvOptions | None = None, run_keys: dict[str, str] | None = None) -> list[dict]:
    """Validate, clean and write the files of a batch, group by group; their run records."""
    csv, keys, out = csv or CsvOptions(), run_keys or {}, []
    path_of = {p.rsplit("/", 1)[-1]: p for p in paths}

    def record(file: str, status: str, before: dict, after: dict, **more) -> dict:
        file = unquote(file)
        table = sanitize_table_name(file) + CLEANED_SUFFIX
        return {"table": table, "source_file": file, "before": before, "after": after, "run_key": keys.get(path_of[file]),
                "status": status, "result": {"file": file, "table": table, "status": status.split(":")[0], **more}}

    def alone(files: list[str]) -> None:
        out.extend(process_file(spark, path_of[f], f, store, audit, options, csv, keys.get(path_of[f])) for f in files)

    with stage_scope(spark):
        try:
            groups, empty = file_groups(spark, paths, csv)
        except Exception:  # noqa: BLE001 - some file can't be read: the others still are
            alone(sorted(path_of))
            return out
        runs = [record(quote(f), f"invalid: {why}", {"rows": 0}, {}, errors=[why]) for f, why in empty.items()]
        for files, typed, encoding in groups:
            try:
                runs += _process_group(files, typed, encoding, store, options, record)
            except Exception:  # noqa: BLE001 - one bad file must not stop the batch
                alone(list(map(unquote, files)))
        audit.record_runs(runs)
        return out + [r["result"] for r in runs]


def _process_group(files, typed, encoding, store, options, record) -> list[dict]:
    reports = reports_by_file(typed, "_file_name")
    runs = [record(f, "invalid: " + "; ".join(reports[f]["errors"]), {}, {}, errors=reports[f]["errors"]) for f in files if not reports[f]["valid"]]
    fine = [f for f in files if reports[f]["valid"]]
    if not fine:
        return runs
    if len(fine) < len(files):
        typed = typed.join(F.broadcast(typed.sparkSession.createDataFrame([(f,) for f in fine], "_file_name string")), "_file_name", "left_semi")
    for done in clean_files(typed, "_file_name", options):
        rows = materialize(done.df, "batch-cleaned")
        after = reports_by_file(rows, FILE)
        store.write_files(rows, FILE, {f: (sanitize_table_name(unquote(f)) + CLEANED_SUFFIX, c) for f, c in done.columns.items()})
        for f, columns in done.columns.items():
            own = _own_snapshot(after[f]["snapshot"], columns)
            runs.append(record(f, "ok", reports[f]["snapshot"], own, rows_before=reports[f]["snapshot"]["rows"], rows_after=own["rows"],
                               encoding=encoding, warnings=reports[f]["warnings"]))
    return runs


def ingest_folder(spark: SparkSession, folder: str, store: TableStore, audit: AuditLog,
                  checkpoint: str, options: CleanOptions | None = None,
                  csv: CsvOptions | None = None, available_now: bool = True,
                  processing_time: str | None = None):
    """Start the incremental ingest; returns the StreamingQuery.

    ``available_now`` processes every new file and stops; otherwise the query
    keeps running with ``processing_time`` micro-batches.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        # file metadata only (bounded by maxFilesPerTrigger), not file content
        paths = sorted(r["path"] for r in batch.select("path").collect())
        if paths:
            process_files(spark, paths, store, audit, options, csv, {p: f"{batch_id}:{p}" for p in paths})

    w = new_files(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 minute")
    return w.start()


def run_summary(audit: AuditLog) -> DataFrame:
    """Files scanned, passed by validation, succeeded, invalid and failed."""
    runs = audit.runs()
    if runs is None:
        return audit.spark.createDataFrame([(0, 0, 0, 0, 0)], "scanned long, passed long, succeeded long, invalid long, failed long")
    ok, invalid = F.col("status") == "ok", F.col("status").startswith("invalid")
    return runs.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(~invalid).alias("passed"), F.count_if(ok).alias("succeeded"),
                    F.count_if(invalid).alias("invalid"), F.count_if(~ok & ~invalid).alias("failed"))


def file_results(audit: AuditLog) -> DataFrame:
    runs = audit.runs()
    rows_before = F.get_json_object("before_stats", "$.rows").cast("long")
    rows_after = F.get_json_object("after_stats", "$.rows").cast("long")
    return runs.select("source_file", "table_name", "status", rows_before.alias("rows_before"),
                       rows_after.alias("rows_after"), "processed_at")
