"""Validation and profiling (V1-V13) in few passes.

* one wide aggregate: counts, nulls, min/max/avg/std for every column;
* one unpivot -> ``groupBy(column, value).count()`` table answering distinct
  counts, modes and top values for all columns at once (map-side combined; no
  multi-``count(DISTINCT)`` Expand that multiplies rows by the column count);
* medians are exact, read from distinct-value rank tables (no single-task
  ``percentile`` buffer holding a whole column);
* duplicates: ``groupBy(all columns).count()`` (hot copies collapse map-side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions.exprs import is_numeric_type, ref
from adloom.operators.ordered import exact_quantiles, rank_table, running_total
from adloom.session import materialize


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, count) for every non-null cell, values as text."""
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("value"))
                             for c in cols]))
    return (df.select(kv.alias("kv")).select("kv.column", "kv.value").where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))


def duplicate_rate(df: DataFrame) -> DataFrame:
    """V5: rows, duplicate rows (beyond the first copy), % of rows."""
    groups = df.groupBy(*map(ref, df.columns)).agg(F.count(F.lit(1)).alias("_c"))
    agg = groups.agg(F.sum("_c").cast("long").alias("rows"),
                     F.sum(F.col("_c") - 1).cast("long").alias("duplicates"))
    return agg.select("rows", "duplicates",
                      F.round(F.col("duplicates") * 100.0 / F.col("rows"), 1).alias("dup_pct"))


def column_profile(df: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """V7 + V8: per column dtype, nulls, distinct counts; numeric min/max/mean/median/std.

    ``exact_distinct=False`` (opt-in for very wide / huge tables) takes distinct
    counts from HLL sketches in the wide aggregate instead of the unpivoted
    value-count shuffle."""
    spark = df.sparkSession
    numeric = _numeric(df)
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(ref(c)).alias(f"nn__{c}") for c in df.columns]
    for c in numeric:
        aggs += [F.min(ref(c)).cast("double").alias(f"lo__{c}"), F.max(ref(c)).cast("double").alias(f"hi__{c}"),
                 F.avg(ref(c)).alias(f"m__{c}"), F.stddev_samp(ref(c)).alias(f"s__{c}")]
    if not exact_distinct:
        aggs += [F.approx_count_distinct(ref(c)).alias(f"ad__{c}") for c in df.columns]
    wide = df.agg(*aggs).first().asDict()
    n = int(wide["__n"])
    # one rank table for the medians of all numeric columns: the number of jobs does not
    # depend on the number of columns
    medians = {}
    if numeric and n:
        found = exact_quantiles(rank_table(df, numeric), {c: int(wide[f"nn__{c}"]) for c in numeric}, [0.5])
        medians = {c: q[0] for c, q in found.items()}
    if exact_distinct:
        distinct = {r["column"]: int(r["d"]) for r in
                    value_counts(df, df.columns).groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()}
    else:
        distinct = {c: int(wide[f"ad__{c}"]) for c in df.columns}
    rows = []
    for f in df.schema.fields:
        c = f.name
        nulls = n - int(wide[f"nn__{c}"])
        d = distinct.get(c, 0)
        r4 = (lambda v: None if v is None else round(float(v), 4))
        num = c in numeric
        rows.append((c, f.dataType.simpleString(), nulls, round(nulls * 100.0 / n, 1) if n else 0.0, d,
                     round(d * 100.0 / max(n, 1), 1),
                     r4(wide[f"lo__{c}"]) if num else None, r4(wide[f"hi__{c}"]) if num else None,
                     r4(wide[f"m__{c}"]) if num else None, r4(medians.get(c)) if num else None,
                     r4(wide[f"s__{c}"]) if num else None))
    schema = ("column string, dtype string, null_count long, null_pct double, unique_count long, "
              "unique_pct double, min double, max double, mean double, median double, std double")
    return spark.createDataFrame(rows, schema)


def top_values(df: DataFrame, k: int = 3) -> DataFrame:
    """V9: top-k values of each column that is not a number, by count desc then value asc."""
    cols = [f.name for f in df.schema.fields if not is_numeric_type(f.dataType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, count long, rank int")
    vc = value_counts(df, cols)
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return (vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column", "value", "count", "rank"))


def quality_snapshot(df: DataFrame) -> DataFrame:
    """V11 + V12: nulls per column; numeric min/max/mean/std at 4 dp, missing -> 0."""
    numeric = _numeric(df)
    parts = []
    for f in df.schema.fields:
        c = f.name
        if c in numeric:
            stats = [F.coalesce(F.round(F.min(ref(c)).cast("double"), 4), F.lit(0.0)).alias("min"),
                     F.coalesce(F.round(F.max(ref(c)).cast("double"), 4), F.lit(0.0)).alias("max"),
                     F.coalesce(F.round(F.avg(ref(c)), 4), F.lit(0.0)).alias("mean"),
                     F.coalesce(F.round(F.stddev_samp(ref(c)), 4), F.lit(0.0)).alias("std")]
        else:
            stats = [F.lit(None).cast("double").alias(x) for x in ("min", "max", "mean", "std")]
        parts.append(F.struct(F.lit(c).alias("column"),
                              (F.count(F.lit(1)) - F.count(ref(c))).cast("long").alias("nulls"), *stats))
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def snapshot_totals(df: DataFrame) -> dict:
    """V11 header numbers: rows, columns, duplicates, total nulls, null %."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [(F.count(F.lit(1)) - F.count(ref(c))).alias(c)
                                                  for c in df.columns]
    r = df.agg(*aggs).first().asDict()
    rows = int(r.pop("rows"))
    total_nulls = int(sum(r.values()))
    dups = duplicate_rate(df).first()["duplicates"] if rows else 0
    cells = rows * len(df.columns)
    return {"rows": rows, "columns": len(df.columns), "column_names": df.columns,
            "duplicates": int(dups or 0), "total_nulls": total_nulls,
            "null_percentage": round(total_nulls / cells * 100, 2) if cells else 0,
            "null_per_column": {k: int(v) for k, v in r.items()},
            "dtypes": {f.name: f.dataType.simpleString() for f in df.schema.fields},
            "numeric_summary": {r["column"]: {k: r[k] for k in ("min", "max", "mean", "std")}
                                for r in quality_snapshot(df).collect() if r["min"] is not None}}


def outlier_summary(df: DataFrame, threshold: float = 3.0, min_rows: int = 10) -> DataFrame:
    """V6: per numeric column with >= 10 values and std != 0: rows with |z| > 3,
    their % of non-null values and min / max outlier value (2 dp)."""
    spark = df.sparkSession
    numeric = _numeric(df)
    st = df.agg(*[x for c in numeric for x in (F.count(ref(c)).alias(f"n__{c}"), F.avg(ref(c)).alias(f"m__{c}"),
                                                F.stddev_samp(ref(c)).alias(f"s__{c}"))]).first().asDict()
    live = [c for c in numeric if st[f"n__{c}"] >= min_rows and st[f"s__{c}"] not in (None, 0.0)]
    schema = "column string, count long, pct double, min_val double, max_val double"
    if not live:
        return spark.createDataFrame([], schema)
    parts = []
    for c in live:
        z = F.abs((ref(c) - F.lit(st[f"m__{c}"])) / F.lit(st[f"s__{c}"]))
        hit = z > threshold
        parts.append(F.struct(F.lit(c).alias("column"), F.count_if(hit).cast("long").alias("count"),
                              F.round(F.count_if(hit) * 100.0 / F.lit(float(st[f"n__{c}"])), 2).alias("pct"),
                              F.round(F.min(F.when(hit, ref(c))).cast("double"), 2).alias("min_val"),
                              F.round(F.max(F.when(hit, ref(c))).cast("double"), 2).alias("max_val")))
    out = df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    return out.where(F.col("count") > 0)


def change_report(raw: DataFrame, options=None) -> DataFrame:
    """Rows before / after, duplicates removed, nulls filled, strategies, and the
    columns before / after / added / dropped by name.

    Cleaning observes its own figures while it writes; only the rows before are counted."""
    from adloom.plans.pipeline import CleanOptions, clean_dataset
    spark = raw.sparkSession
    before = raw.count()
    res = clean_dataset(raw, options or CleanOptions(blocks=frozenset()))
    rep, after = res.report, res.df.columns
    old = [rep.get("renamed", {}).get(c, c) for c in rep["columns_before"]]
    filled = sum(rep["null_counts"][c] for c in rep["filled"])
    row = (before, rep["rows"], before - rep["rows"], before - rep["rows"], filled, rep["strategy_numeric"],
           rep["strategy_categorical"], len(old), len(after), ",".join(c for c in after if c not in old),
           ",".join(c for c in old if c not in after))
    return spark.createDataFrame([row], (
        "rows_before long, rows_after long, rows_removed long, duplicates_removed long, nulls_filled long, "
        "strategy_numeric string, strategy_categorical string, columns_before int, columns_after int, "
        "columns_added string, columns_dropped string"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """V10 / V11 header: rows, columns, numeric / categorical columns, nulls, duplicates."""
    numeric = _numeric(df)
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    # one group-by over all columns (copies collapse map-side) answers rows,
    # duplicates and nulls together: a group's key carries its nulls
    groups = df.groupBy(*map(ref, df.columns)).agg(F.count(F.lit(1)).alias("_c"))
    key_nulls = F.lit(0)
    for c in df.columns:
        key_nulls = key_nulls + ref(c).isNull().cast("long")
    return groups.agg(
        F.sum("_c").cast("long").alias("total_rows"),
        F.lit(len(df.columns)).cast("long").alias("total_columns"),
        F.lit(len(numeric)).cast("long").alias("numeric_columns"),
        F.lit(len(text)).cast("long").alias("categorical_columns"),
        F.sum(F.col("_c") * key_nulls).cast("long").alias("total_nulls"),
        F.sum(F.col("_c") - 1).cast("long").alias("total_duplicates"))


def null_columns(df: DataFrame) -> DataFrame:
    """V3 + V4: per column null % with the all-null and >= 50 % flags."""
    parts = [F.struct(F.lit(c).alias("column"),
                      (F.count(F.lit(1)) - F.count(ref(c))).cast("long").alias("null_count"),
                      F.round((F.count(F.lit(1)) - F.count(ref(c))) * 100.0 / F.count(F.lit(1)), 1).alias("null_pct"),
                      (F.count(ref(c)) == 0).alias("all_null"),
                      ((F.count(F.lit(1)) - F.count(ref(c))) * 100.0 / F.count(F.lit(1)) >= 50).alias("high_null"))
             for c in df.columns]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def validate_by_file(df: DataFrame, file_col: str = "_file_name") -> DataFrame:
    """V14 for a batch of same-schema files read together (``CsvOptions(with_file_name=True)``):
    per file rows, duplicates, nulls, all-null columns and validity, in one job.

    One group-by over (file, all columns) collapses copies map-side; a second
    group-by per file adds the group counts up."""
    cols = [c for c in df.columns if c != file_col]
    groups = df.groupBy(ref(file_col), *map(ref, cols)).agg(F.count(F.lit(1)).alias("_c"))
    key_nulls = F.lit(0)
    for c in cols:
        key_nulls = key_nulls + ref(c).isNull().cast("long")
    per = groups.groupBy(file_col).agg(
        F.sum("_c").cast("long").alias("rows"), F.sum(F.col("_c") - 1).cast("long").alias("duplicates"),
        F.sum(F.col("_c") * key_nulls).cast("long").alias("nulls"),
        *[F.sum(F.when(ref(c).isNotNull(), F.col("_c")).otherwise(0)).alias(f"nn__{c}") for c in cols])
    all_null = F.filter(F.array(*[F.when(F.col(f"nn__{c}") == 0, F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return per.select(F.col(file_col).alias("file"), "rows", "duplicates", "nulls",
                      F.round(F.col("duplicates") * 100.0 / F.col("rows"), 1).alias("dup_pct"),
                      all_null.alias("all_null_columns"),
                      ((F.col("rows") > 0) & F.lit(len(cols) >= 2)).alias("valid"))


def validation_report(df: DataFrame) -> DataFrame:
    """V3-V6 as rows (rule, column, measure): empty columns (null %), columns at least half
    empty (null %), a duplicate rate above 30 % (%), outliers by column (count)."""
    nulls = null_columns(df)
    parts = [
        nulls.where("all_null").select(F.lit("empty_column").alias("rule"), "column", F.col("null_pct").alias("measure")),
        nulls.where("high_null AND NOT all_null").select(F.lit("half_empty"), "column", "null_pct"),
        duplicate_rate(df).where("duplicates * 100.0 / rows > 30").select(F.lit("duplicates"), F.lit("*"), "dup_pct"),
        outlier_summary(df).select(F.lit("outliers"), "column", F.col("count").cast("double"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


WORDING = {"empty_column": "{0}: no value at all", "half_empty": "{0}: {1:.1f} % of the cells are empty",
           "duplicates": "{1:.1f} % of the rows repeat an earlier row", "outliers": "{0}: {1:.0f} outlier(s), |z| > 3"}


def _cells(df: DataFrame, cols: list[str], numeric: list[str]) -> DataFrame:
    """(file, i, value, num, cnt): how often each cell value of the i-th column occurs in a file."""
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ref(c).cast("string").alias("value"),
                                        (ref(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("num"))
                               for i, c in enumerate(cols)]))
    return df.select("__f", cell.alias("c")).select("__f", "c.*").where(F.col("value").isNotNull()) \
        .groupBy("__f", "i", "value", "num").agg(F.count(F.lit(1)).alias("cnt"))


def reports_by_file(df: DataFrame, file_col: str, top: int = 3, threshold: float = 3.0, min_rows: int = 10) -> dict[str, dict]:
    """V1-V10 of every file of a batch (V14): {file: report}, as ``validate`` makes one.

    The number of jobs depends neither on the files nor on the columns.  Three tables, all
    keyed by file, answer everything: one wide aggregate; the counts of equal rows; and one
    table of (file, column, value, count, smaller ones), in which the running counts come
    from range partitions, so a file with most of the rows is not one task.  A report per
    file and column reaches the driver; files without rows are not in the result."""
    cols = [c for c in df.columns if c != file_col]
    if not cols:
        return {}
    numeric = [f.name for f in df.schema.fields if f.name in cols and is_numeric_type(f.dataType)]
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    staged = materialize(df.select(ref(file_col).cast("string").alias("__f"), *[ref(c) for c in cols]), "validated")

    rows = F.count(F.lit(1))
    aggs = [rows.alias("rows")]
    for i, c in enumerate(cols):
        nulls = rows - F.count(ref(c))
        aggs += [nulls.alias(f"nulls{i}"), F.round(nulls * 100.0 / rows, 1).alias(f"pct{i}"), (nulls * 100.0 / rows >= 50).alias(f"half{i}")]
        if c in numeric:
            aggs += [F.min(ref(c)).cast("double").alias(f"lo{i}"), F.max(ref(c)).cast("double").alias(f"hi{i}"),
                     F.avg(ref(c)).alias(f"m{i}"), F.stddev_samp(ref(c)).alias(f"s{i}")]
            aggs += [F.coalesce(F.round(e, 4), F.lit(0.0)).alias(f"{k}{i}") for k, e in (
                ("min", F.min(ref(c)).cast("double")), ("max", F.max(ref(c)).cast("double")), ("mean", F.avg(ref(c))), ("std", F.stddev_samp(ref(c))))]
    first = {r["__f"]: r.asDict() for r in staged.groupBy("__f").agg(*aggs).collect()}
    groups = staged.groupBy("__f", *[ref(c) for c in cols]).agg(F.count(F.lit(1)).alias("__c"))
    copies = {r["__f"]: r for r in groups.groupBy("__f").agg(F.sum(F.col("__c") - 1).cast("long").alias("duplicates"), F.sum("__c").alias("n"))
              .withColumn("pct", F.round(F.col("duplicates") * 100.0 / F.col("n"), 1)).collect()}

    ranked = materialize(running_total(_cells(staged, cols, numeric), ["__f", "i"], ["num", "value"], "cnt", "before"), "cells")
    per = ranked.groupBy("__f", "i").agg(F.count(F.lit(1)).alias("distinct"))
    found: dict[tuple, dict] = {}
    if numeric:
        stats = df.sparkSession.createDataFrame([(f, i, w["rows"] - w[f"nulls{i}"], w[f"m{i}"], w[f"s{i}"]) for f, w in first.items()
                                                 for i, c in enumerate(cols) if c in numeric], "__g string, j int, n long, mean double, std double")
        at = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("cnt")), F.col("num")))
        hit = (F.col("n") >= min_rows) & (F.col("std") != 0) & (F.abs((F.col("num") - F.col("mean")) / F.col("std")) > threshold)
        hits = F.coalesce(F.sum(F.when(hit, F.col("cnt"))), F.lit(0)).cast("long")
        joined = ranked.join(stats, (F.col("__f") == F.col("__g")) & (F.col("i") == F.col("j")), "left")
        per = joined.groupBy("__f", "i").agg(
            F.count(F.lit(1)).alias("distinct"), at(F.floor((F.col("n") - 1) / 2)).alias("lower"), at(F.ceil((F.col("n") - 1) / 2)).alias("upper"),
            hits.alias("hits"), F.round(hits * 100.0 / F.max("n"), 2).alias("hit_pct"),
            F.round(F.min(F.when(hit, F.col("num"))), 2).alias("hit_min"), F.round(F.max(F.when(hit, F.col("num"))), 2).alias("hit_max"))
    for r in per.collect():
        found[r["__f"], r["i"]] = r.asDict()
    best: dict[str, list] = {}
    words = [i for i, c in enumerate(cols) if c not in numeric]
    if words:
        place = F.row_number().over(Window.partitionBy("__f", "i").orderBy(F.desc("cnt"), F.asc("value")))
        for r in ranked.where(F.col("i").isin(words)).withColumn("rank", place).where(F.col("rank") <= top) \
                .select("__f", "i", "value", "cnt", "rank").collect():
            best.setdefault(r["__f"], []).append((r["i"], r["rank"], r["value"], r["cnt"]))
        best = {f: [{"column": cols[i], "value": v, "count": n, "rank": k} for i, k, v, n in sorted(b, key=lambda x: x[:2])] for f, b in best.items()}
    return {f: _report(f, w, copies[f], found, best.get(f, []), cols, numeric, dtypes) for f, w in first.items()}


def _report(f, w: dict, copies, found: dict, best: list, cols: list[str], numeric: list[str], dtypes: dict) -> dict:
    n, report = w["rows"], {"valid": False, "errors": [], "warnings": [], "summary": {}, "outliers": [], "profile": [], "top_values": []}
    if len(cols) < 2:
        report["errors"].append(f"{len(cols)} column(s); at least 2 are needed")
        return report
    r4 = lambda v: None if v is None else round(float(v), 4)
    nulls = {c: int(w[f"nulls{i}"]) for i, c in enumerate(cols)}
    for i, c in enumerate(cols):
        got, num = found.get((f, i), {}), c in numeric
        d = int(got.get("distinct", 0))
        middle = None if not num or got.get("lower") is None else _middle(got["lower"], got["upper"])
        report["profile"].append({
            "column": c, "dtype": dtypes[c].simpleString(), "null_count": nulls[c], "null_pct": round(nulls[c] * 100.0 / n, 1),
            "unique_count": d, "unique_pct": round(d * 100.0 / max(n, 1), 1), "min": r4(w[f"lo{i}"]) if num else None,
            "max": r4(w[f"hi{i}"]) if num else None, "mean": r4(w[f"m{i}"]) if num else None, "median": r4(middle),
            "std": r4(w[f"s{i}"]) if num else None})
        if num and got.get("hits"):
            report["outliers"].append({"column": c, "count": got["hits"], "pct": got["hit_pct"], "min_val": got["hit_min"], "max_val": got["hit_max"]})
    say = [("empty_column", c, w[f"pct{i}"]) for i, c in enumerate(cols) if nulls[c] == n]
    say += [("half_empty", c, w[f"pct{i}"]) for i, c in enumerate(cols) if w[f"half{i}"] and nulls[c] < n]
    if copies["duplicates"] * 100.0 / n > 30:
        say.append(("duplicates", "*", copies["pct"]))
    say += [("outliers", o["column"], float(o["count"])) for o in report["outliers"]]
    total, dups = sum(nulls.values()), int(copies["duplicates"])
    summary = {"total_rows": n, "total_columns": len(cols), "numeric_columns": len(numeric),
               "categorical_columns": sum(isinstance(dtypes[c], T.StringType) for c in cols), "total_nulls": total, "total_duplicates": dups}
    snapshot = {"rows": n, "columns": len(cols), "column_names": cols, "duplicates": dups, "total_nulls": total,
                "null_percentage": round(total / (n * len(cols)) * 100, 2), "null_per_column": nulls,
                "dtypes": {c: dtypes[c].simpleString() for c in cols},
                "numeric_summary": {c: {k: w[f"{k}{i}"] for k in ("min", "max", "mean", "std")} for i, c in enumerate(cols) if c in numeric}}
    return {**report, "valid": True, "warnings": [WORDING[rule].format(c, m) for rule, c, m in say], "summary": summary,
            "snapshot": snapshot, "top_values": best}


def _middle(a: float, b: float) -> float:
    return a if a == b else a + (b - a) * 0.5


def validate(df: DataFrame) -> dict:
    """Is the table usable, what is odd about it, and its profile.

    Fatal: no rows, or fewer than two columns (rows are looked at first)."""
    name = "__one"
    found = reports_by_file(df.withColumn(name, F.lit("*")), name)
    return found.get("*") or {"valid": False, "errors": ["no rows"], "warnings": [], "summary": {}, "outliers": [], "profile": [], "top_values": []}
