"""Versioned table store and audit tables.

A table is a folder of Parquet versions under a root and a namespace (one
namespace per tenant): ``<root>/<namespace>/<table>/v=<YYYYmmdd_HHMMSS_ffffff>/``.
Writing a new version archives the previous one by construction (it stays as
an older ``v=`` folder), the write of the new version is complete before it
becomes current (the newest folder with a ``_SUCCESS`` marker), and listing
versions with row counts is one partition-discovery scan + ``groupBy(v)``.

Audit tables (run metadata, upload history) are append-only Parquet tables.
Nothing here is a storage engine: Spark writes and reads Parquet; the class
only names folders.
"""

from __future__ import annotations

import datetime as _dt
import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions.exprs import ref

#: Beside a version written in a batch: the names of the table's columns.
COLUMNS_FILE = "_columns"
VERSION_RE = re.compile(r"^v=(\d{8}_\d{6}_\d{6})$")


def _stamp() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


class TableStore:
    def __init__(self, spark: SparkSession, root: str, namespace: str = "default"):
        if not re.fullmatch(r"[A-Za-z0-9_]+", namespace):
            raise ValueError(f"bad namespace {namespace!r}")
        self.spark = spark
        self.root = root.rstrip("/")
        self.namespace = namespace
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # ---- paths ---------------------------------------------------------------
    def _fs(self, path: str):
        return self._Path(path).getFileSystem(self._conf)

    def ns_path(self) -> str:
        return f"{self.root}/{self.namespace}"

    def table_path(self, name: str) -> str:
        if not re.fullmatch(r"[a-z0-9_]+", name):
            raise ValueError(f"bad table name {name!r}")  # S17 names only
        return f"{self.ns_path()}/{name}"

    def _children(self, path: str) -> list[str]:
        fs = self._fs(path)
        p = self._Path(path)
        if not fs.exists(p):
            return []
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]

    def versions(self, name: str) -> list[str]:
        """Complete versions (with _SUCCESS), newest first."""
        base = self.table_path(name)
        out = []
        for child in self._children(base):
            m = VERSION_RE.match(child)
            if m and self._fs(base).exists(self._Path(f"{base}/{child}/_SUCCESS")):
                out.append(m.group(1))
        return sorted(out, reverse=True)

    # ---- S20, S6, S5/S7, S14 -------------------------------------------------
    def exists(self, name: str) -> bool:
        """The table exists inside this namespace (no other tenant's data)."""
        return bool(self.versions(name))

    def current_path(self, name: str) -> str:
        v = self.versions(name)
        if not v:
            raise KeyError(f"table {name!r} not found in namespace {self.namespace!r}")
        return f"{self.table_path(name)}/v={v[0]}"

    def write(self, df: DataFrame, name: str) -> str:
        """S5 + S7: write a new version; the previous one stays as an archive."""
        v = _stamp()
        df.write.mode("errorifexists").parquet(f"{self.table_path(name)}/v={v}")
        return v

    def write_files(self, df: DataFrame, file_col: str, tables: dict[str, tuple[str, list[str]]]) -> dict[str, str]:
        """S5 for the files of a batch in one job: {file: (table, its columns)} -> {file: version}.

        Rows are written once, a folder per file, and the folders then moved to their tables
        (on an object store, a copy); a version counts as soon as its marker is there.  Files of
        one table become versions in the order given."""
        folder = f"{self.ns_path()}/_batch-{uuid.uuid4().hex}"
        places = self.spark.createDataFrame([(f, i) for i, f in enumerate(tables)], "__file string, _place int")
        (df.join(F.broadcast(places), F.col(file_col) == F.col("__file")).drop("__file", file_col)     # a row per file
         .hint("rebalance", "_place").write.partitionBy("_place").parquet(folder))
        fs, out = self._fs(folder), {}
        for i, (file, (table, columns)) in enumerate(tables.items()):
            v = _stamp()
            while self._fs(self.table_path(table)).exists(self._Path(f"{self.table_path(table)}/v={v}")):
                v = _stamp()
            target = f"{self.table_path(table)}/v={v}"
            fs.mkdirs(self._Path(self.table_path(table)))
            if not fs.rename(self._Path(f"{folder}/_place={i}"), self._Path(target)):
                raise OSError(f"no rows of {file!r} to move to {target}")
            for name, data in ((COLUMNS_FILE, json.dumps(columns)), ("_SUCCESS", "")):
                stream = fs.create(self._Path(f"{target}/{name}"))
                stream.write(bytearray(data.encode()))
                stream.close()
            out[file] = v
        fs.delete(self._Path(folder), True)
        return out

    def ensure(self, df: DataFrame, name: str) -> None:
        """Create an empty version with ``df``'s schema if the table is absent."""
        if not self.exists(name):
            self.write(df.limit(0), name)

    def read(self, name: str) -> DataFrame:
        """The current version (lazy; callers aggregate, never collect it)."""
        path = self.current_path(name)
        listed, fs = self._Path(f"{path}/{COLUMNS_FILE}"), self._fs(path)
        df = self.spark.read.parquet(path)
        if not fs.exists(listed):
            return df
        stream = fs.open(listed)
        columns = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        return df.select(*map(ref, columns))

    # ---- S8, S13, S15, S16 ---------------------------------------------------
    def version_counts(self, name: str) -> DataFrame:
        """Row count per complete version, newest first (one scan)."""
        complete = self.versions(name)
        if not complete:
            return self.spark.createDataFrame([], "version string, rows long, is_current boolean")
        df = (self.spark.read.option("basePath", self.table_path(name))
              .parquet(*[f"{self.table_path(name)}/v={v}" for v in complete]))
        counts = df.groupBy(F.col("v").cast("string").alias("version")).agg(F.count(F.lit(1)).alias("rows"))
        dom = self.spark.createDataFrame([(v,) for v in complete], "version string")
        return (dom.join(counts, "version", "left")
                .select("version", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
                        (F.col("version") == F.lit(complete[0])).alias("is_current"))
                .orderBy(F.desc("version")))

    def list_tables(self, suffix: str = "_cleaned") -> DataFrame:
        """Tables of this namespace ending in ``suffix`` with current row counts."""
        counts = self.spark.createDataFrame([], "table string, rows long")
        for t in sorted(self._children(self.ns_path())):
            if t.endswith(suffix):
                rows = F.count(F.lit(1))
                try:
                    one = self.read(t).agg(rows.alias("rows"))
                except Exception:  # noqa: BLE001 - unreadable -> 0, as a listing
                    one = self.spark.range(1).select(F.lit(0).cast("long").alias("rows"))
                counts = counts.union(one.select(F.lit(t), "rows"))
        return counts          # one job, however many tables

    def purge_namespace(self) -> None:
        """Drop every table of *this* namespace only."""
        p = self._Path(self.ns_path())
        fs = self._fs(self.ns_path())
        if fs.exists(p):
            fs.delete(p, True)

    # ---- S18/S19 sinks -------------------------------------------------------
    @staticmethod
    def export_csv(df: DataFrame, path: str) -> None:
        """Header CSV, parallel part files."""
        df.write.mode("overwrite").option("header", True).csv(path)

    @staticmethod
    def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None,
                   batchsize: int = 2000) -> None:
        """S5 over JDBC (optional sink): overwrite in batches of ``batchsize`` rows."""
        (df.write.mode("overwrite").option("batchsize", batchsize)
         .jdbc(url, table, properties=properties or {}))


RUN_SCHEMA = ("run_key string, table_name string, source_file string, processed_at timestamp_ntz, "
              "before_stats string, after_stats string, status string")


class AuditLog:
    """Append-only run metadata and upload history."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{self.root}/_audit/{table}")

    def _read(self, table: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/_audit/{table}")
        except Exception:  # noqa: BLE001 - nothing written yet
            return None

    def record_runs(self, runs: list[dict]) -> None:
        """S9 for the files of a batch, in one write: keys as the arguments of ``record_run``."""
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        if runs:
            self._append("etl_metadata", [(r.get("run_key") or uuid.uuid4().hex, r["table"], r["source_file"], now, json.dumps(r["before"], default=str),
                                           json.dumps(r["after"], default=str), r["status"]) for r in runs], RUN_SCHEMA)

    def record_run(self, table: str, source_file: str, before: dict, after: dict,
                   status: str = "ok", run_key: str | None = None) -> None:
        """One row per processed file.  A later row with the same ``run_key`` (a replayed
        micro-batch) takes the place of an earlier one."""
        self.record_runs([{"table": table, "source_file": source_file, "before": before, "after": after, "status": status, "run_key": run_key}])

    def latest_run(self, table: str) -> DataFrame:
        """The newest run of a table, its figures before and after and their differences."""
        df = self._read("etl_metadata")
        if df is None:
            return self.spark.createDataFrame([], "table_name string")
        best = (df.where(F.col("table_name") == table)
                .agg(F.max_by(F.struct(*df.columns), F.col("processed_at")).alias("r")).select("r.*")
                .where(F.col("table_name").isNotNull()))
        for k in ("rows", "columns", "duplicates", "total_nulls"):
            before, after = (F.get_json_object(f"{side}_stats", f"$.{k}").cast("long") for side in ("before", "after"))
            best = best.withColumns({f"{k}_before": before, f"{k}_after": after, f"{k}_diff": after - before})
        return best

    def runs(self) -> DataFrame | None:
        """All runs, one row per run key (the latest)."""
        df = self._read("etl_metadata")
        return df if df is None else df.groupBy("run_key").agg(
            F.max_by(F.struct(*df.columns), F.col("processed_at")).alias("r")).select("r.*")

    def record_upload(self, user_id: str, table: str, filename: str, rows: int, columns: int) -> None:
        """S11."""
        self._append("user_uploads", [(user_id, table, filename, int(rows), int(columns),
                                       _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None))],
                     "user_id string, table_name string, filename string, rows_loaded long, "
                     "columns_count long, uploaded_at timestamp_ntz")

    def uploads(self, user_id: str) -> DataFrame:
        """A user's uploads, newest first."""
        df = self._read("user_uploads")
        if df is None:
            return self.spark.createDataFrame([], "user_id string")
        return df.where(F.col("user_id") == user_id).orderBy(F.desc("uploaded_at"))


class TableCache:
    """Hot tables kept on the executors for ``ttl`` seconds.

    A table is read anew after that time, or as soon as the store has a newer version."""

    def __init__(self, store: TableStore, ttl: float = 300.0, clock=time.monotonic):
        self.store, self.ttl, self.clock = store, ttl, clock
        self._held: dict[str, tuple[str, float, DataFrame]] = {}

    def read(self, name: str) -> DataFrame:
        path = self.store.current_path(name)
        held = self._held.get(name)
        if held and held[0] == path and self.clock() - held[1] < self.ttl:
            return held[2]
        self.invalidate(name)
        df = self.store.read(name).persist()
        self._held[name] = (path, self.clock(), df)
        return df

    def invalidate(self, name: str) -> None:
        held = self._held.pop(name, None)
        if held:
            held[2].unpersist()
