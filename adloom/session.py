"""Session helpers: one place for engine-wide Spark settings and checkpointing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the engine relies on.  AQE re-plans joins (broadcast vs sort-merge),
# coalesces small shuffle partitions and splits skewed join partitions.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "adloom", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's settings.

    On a cluster, ``master`` stays None and the cluster manager decides; the
    shared checkpoint folder comes from ``spark.checkpoint.dir``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when nothing is configured (local tests) do we pick a folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = os.path.join(tempfile.gettempdir(), f"adloom-ckpt-{uuid.uuid4().hex[:8]}")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


#: The JVM compiles no method of more bytecode than this; a generated one beyond it would be
#: interpreted row by row, so such a stage runs on Spark's smaller generated parts instead.
COMPILED_BYTES = 8000


def compiled_methods(spark: SparkSession):
    """Inside the block, jobs generate no method too long for the JVM to compile.

    Wide projections (a cleaned table has some 70 columns) are such methods otherwise."""
    return _setting(spark, "spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))


def brief_shuffles(spark: SparkSession):
    """Inside the block, the shuffle files of a query go when it ends, not when the driver's JVM
    happens to collect garbage.

    For work whose queries are written or collected, so that none reads a shuffle of an earlier one."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: How stage tables are written to a ``file:`` folder; other file systems are not concerned.  Hadoop's
#: usual local file system writes a checksum beside every file and sets the rights of both by starting
#: ``chmod``, and a process that is being started shows the memory of the executor's JVM once more.
#: The plain one does neither; Parquet's pages hold checksums of their own.
LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


#: How stage tables with all rows and columns of the input are written: some two thirds of the usual size.
COMPACT = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def materialize(df: DataFrame, label: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read
    it back: lineage is cut and the rows (including any partition ids taken
    before the write) are fixed for every later job, even if executors are
    lost.  Unlike ``Dataset.checkpoint`` (Java-serialised rows, no pruning),
    later scans read only the columns they need, vectorised.

    Used where a later step must see exactly the same rows and bucket ids as an
    earlier one (range-partition buckets), and to avoid recomputing an
    expensive shuffle (dedup, joins) for several statistics passes.  ``by``: a folder for
    each value of this column, so that a filter on it reads no other rows.
    """
    spark = df.sparkSession
    path = _stage_path(spark, label)
    writer = df.write.mode("errorifexists").options(**LOCAL_FILES)
    with compiled_methods(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if by else spark.read.parquet(path)


def _stage_path(spark: SparkSession, label: str) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/adloom-tables/{label}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


def materialize_parts(parts: Iterable[DataFrame], label: str = "stage") -> DataFrame:
    """``materialize`` for a wide table given as parts (one at least, of one schema), which are written
    one after the other: the shuffle files of a part go before the next one begins, so that they take
    the disk of one part at a time, however large the table."""
    path = None
    for part in parts:
        spark = part.sparkSession
        path, mode = (path, "append") if path else (_stage_path(spark, label), "errorifexists")
        with compiled_methods(spark), brief_shuffles(spark):
            part.write.mode(mode).options(**LOCAL_FILES, **COMPACT).parquet(path)
    table = spark.read.parquet(path)
    table.stage_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize_parts`` that nothing reads any more."""
    _delete(table.sparkSession, [table.stage_path])


#: Files of a narrow table, for each core of the cluster.
FILES_PER_CORE = 6


def materialize_narrow(df: DataFrame, label: str = "stage") -> DataFrame:
    """``materialize`` for tables of a few numbers a row: some files for each core instead of one for
    each shuffle partition.

    Opening, closing and renaming a file each outweighs the rows of such a table."""
    return materialize(df.coalesce(FILES_PER_CORE * max(2, df.sparkSession.sparkContext.defaultParallelism)), label)


_SCOPES: list[list[str]] = []


@contextmanager
def stage_scope(spark: SparkSession):
    """Delete the stage tables written inside the ``with`` block when it ends.

    For work whose results have been written elsewhere by then (the ingest)."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.remove(paths)
        _delete(spark, paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
