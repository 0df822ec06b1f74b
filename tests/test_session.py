"""Stage tables are written by methods the JVM compiles."""
from contextlib import contextmanager

from adloom import session

KEY = "spark.sql.codegen.hugeMethodLimit"


def test_stage_tables_are_written_with_methods_the_jvm_compiles(spark, monkeypatch):
    before, inside, plain = spark.conf.get(KEY), [], session.compiled_methods

    @contextmanager
    def watched(s):
        with plain(s):
            inside.append(s.conf.get(KEY))
            yield

    monkeypatch.setattr(session, "compiled_methods", watched)
    assert session.materialize(spark.range(3)).count() == 3
    assert inside == [str(session.COMPILED_BYTES)] and spark.conf.get(KEY) == before


def test_narrow_tables_have_some_files_for_each_core(spark):
    rows = spark.range(0, 5000, 1, 400).toDF("c")           # a file for each of 400 partitions otherwise
    table = session.materialize_narrow(rows)
    most = session.FILES_PER_CORE * max(2, spark.sparkContext.defaultParallelism)
    assert len(table.inputFiles()) <= most < 400
    assert sorted(r.c for r in table.collect()) == list(range(5000))


def test_local_stage_tables_have_no_checksum_files(spark):
    """Each would be a file more, and its rights are set by a process of its own."""
    from pathlib import Path
    rows = spark.range(0, 100, 1, 5).selectExpr("id AS c", "id % 3 AS part")
    for table in (session.materialize(rows), session.materialize(rows, by="part")):
        files = [Path(f.removeprefix("file://")) for f in table.inputFiles()]
        assert files and all(f.exists() for f in files)
        assert [x for f in files for x in f.parent.iterdir() if x.name.endswith(".crc")] == []
        assert sorted(r.c for r in table.collect()) == list(range(100))
    assert spark.conf.get("fs.file.impl", None) is None     # the session's own writes are as before


def _shuffle_files(root):
    return [f for f in root.rglob("shuffle_*") if f.is_file()]


def test_parts_are_one_table_and_leave_no_shuffle_files(spark):
    """Shuffle files otherwise stay until the driver's JVM collects garbage: all shuffles of a job lie on the disks at once."""
    import time
    from pathlib import Path
    root = Path(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].getPath()).parent
    before = set(_shuffle_files(root))
    rows = spark.range(0, 20000, 1, 4).selectExpr("id", "cast(id % 7 AS string) AS t")
    parts = [rows.where(f"id % 3 = {i}").repartition(5, "id") for i in range(3)]
    table = session.materialize_parts(iter(parts), "parts")
    until = time.time() + 20
    while set(_shuffle_files(root)) - before and time.time() < until:       # they go in the background
        time.sleep(0.2)
    assert set(_shuffle_files(root)) - before == set()
    assert sorted(map(tuple, table.collect())) == [(i, str(i % 7)) for i in range(20000)]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    path = Path(table.stage_path.removeprefix("file:"))
    assert path.exists()
    session.discard(table)
    assert not path.exists()
