"""Cleaning (C1-C8, C12): header normalisation, dedup, imputation, aliasing, date typing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions.exprs import is_numeric_type, ref
from adloom.operators.roles import COLUMN_ALIASES, has_date_keyword

# ---- fixed values ----------------------------------------------------------
# Text date layouts tried after ISO parsing (month-first before day-first).
DATE_FORMATS = ["M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy",
                "yyyy/M/d", "yyyy/M/d H:mm:ss", "d-MMM-yyyy", "MMM d, yyyy"]


def normalize_name(name: str) -> str:
    """S3: strip, lower case, spaces to underscores."""
    return name.strip().lower().replace(" ", "_")


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_name(c) for c in df.columns])


#: File endings that are not part of a table's name.
TABLE_ENDINGS = (".csv", ".xlsx", ".xls")
_NAME_RULES = ((r"[^a-z0-9]+", "_"), (r"^_+|_+$", ""), (r"^(?=[0-9])", "t_"))


def sanitize_table_name(filename: str) -> str:
    """File name -> safe table name ('Sales Data (2024).csv' -> 'sales_data_2024')."""
    out = reduce(lambda n, ending: n.replace(ending, ""), TABLE_ENDINGS, filename.lower())
    out = reduce(lambda n, rule: re.sub(rule[0], rule[1], n), _NAME_RULES, out)
    if out == "":
        raise ValueError(f"{filename!r} leaves no table name")
    return out


def sanitize_table_name_col(file_name: Column) -> Column:
    """S17 as a column expression (per file inside one batch); no name left: empty text."""
    out = reduce(lambda n, ending: F.replace(n, F.lit(ending), F.lit("")), TABLE_ENDINGS, F.lower(file_name))
    return reduce(lambda n, rule: F.regexp_replace(n, rule[0], rule[1]), _NAME_RULES, out)


def alias_plan(columns: list[str]) -> tuple[dict, list[str]]:
    """C7 with collision handling: keep the canonical name if present, else the
    first alias (in column order); other aliases keep their own name."""
    rename, warnings = {}, []
    taken = set(columns)
    for c in columns:
        target = COLUMN_ALIASES.get(c)
        if not target:
            continue
        if target in taken:
            warnings.append(f"'{c}' not renamed: '{target}' already present")
            continue
        rename[c] = target
        taken.add(target)
    return rename, warnings


def effective_strategies(fill_strategy: str | None, strategy_numeric: str | None,
                         strategy_categorical: str | None) -> tuple[str, str]:
    """strategy_numeric over fill_strategy over zero; unknown -> zero / mode."""
    num = (strategy_numeric or fill_strategy or "zero").lower().strip()
    cat = (strategy_categorical or "mode").lower().strip()
    return ("mean" if num == "mean" else "zero"), ("constant" if cat == "constant" else "mode")


def _hashes_alike(dt: T.DataType) -> bool:
    """Whether equal values of this type surely have one hash: not so for texts that a collation compares."""
    return isinstance(dt, T.AtomicType) and (not isinstance(dt, T.StringType) or type(dt) is T.StringType and dt.isUTF8BinaryCollation())


def digest(df: DataFrame) -> Column | None:
    """A hash of the whole row, the same for equal rows; none if a type does not give it.

    ``df`` holds no ``-0.0`` (``exprs.nan_to_null`` and ``plain_zero``)."""
    return F.xxhash64(*map(ref, df.columns)) if all(_hashes_alike(f.dataType) for f in df.schema.fields) else None


def may_repeat(df: DataFrame) -> bool:
    """Whether a row may occur twice.  Only hashes are shuffled, so a table without copies, the usual
    one, need not be: equal rows have equal hashes.  Two different rows of one hash (about one chance
    in 800 for 216 million rows) give true as well."""
    mark = digest(df)
    return mark is None or not df.groupBy(mark.alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def drop_copies(df: DataFrame, k: int) -> list[DataFrame]:
    """``dropDuplicates`` in ``k`` parts: copies have one hash, so they are in one part."""
    mark = digest(df)
    if k == 1 or mark is None:
        return [df.dropDuplicates()]
    return [df.where(F.pmod(mark, F.lit(k)) == i).dropDuplicates() for i in range(k)]


#: ISO text first, then the fixed layouts.
N_LAYOUTS = 1 + len(DATE_FORMATS)


def date_layouts(c: Column) -> list[Column]:
    """The column read by each layout in turn; failures become null."""
    return [c.try_cast("timestamp_ntz")] + [F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")
                                            for fmt in DATE_FORMATS]


def column_modes(df: DataFrame, cols: list[str]) -> dict:
    """C4: most frequent non-null value per column, ties -> smallest value.

    One unpivot + ``groupBy(column, value).count()`` (map-side combined, so a
    hot value costs one row per map task) + ``min_by`` per column; no column's
    distinct values are ever gathered into one task.
    """
    if not cols:
        return {}
    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("k"), ref(c).cast("string").alias("v"))
                             for c in cols]))
    counts = (df.select(kv.alias("kv")).select("kv.k", "kv.v").where(F.col("v").isNotNull())
              .groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt")))
    best = counts.groupBy("k").agg(F.min_by("v", F.struct((-F.col("cnt")).alias("n"), F.col("v"))).alias("mode"))
    return {r["k"]: r["mode"] for r in best.collect()}


def fill_missing(df: DataFrame, *, numeric: list[str], categorical: list[str],
                 null_counts: dict, means: dict, n_rows: int, strategy_numeric: str,
                 strategy_categorical: str, impute_dates: bool) -> tuple[DataFrame, dict]:
    """C2-C6.  Returns the filled frame and {column: fill value} for the report."""
    filled: dict = {}
    exprs = []
    types = {f.name: f.dataType for f in df.schema.fields}
    mode_cols = [c for c in categorical
                 if strategy_categorical == "mode" and null_counts.get(c, 0) > 0
                 and null_counts.get(c, 0) < n_rows and (impute_dates or not has_date_keyword(c))]
    modes = column_modes(df, mode_cols)
    for c in df.columns:
        e = ref(c)
        nulls = null_counts.get(c, 0)
        if c in numeric and nulls > 0:
            if strategy_numeric == "mean":
                m = means.get(c)
                val = 0.0 if m is None else float(m)
                e = F.coalesce(ref(c).cast("double"), F.lit(val))
            else:
                val = 0
                e = F.coalesce(ref(c), F.lit(0).cast(types[c]))
            filled[c] = val
        elif c in categorical and nulls > 0:
            if nulls >= n_rows or strategy_categorical == "constant":
                val = "Unknown"
            elif c in modes:
                val = modes[c]
            else:
                val = None  # date-keyword text column: not imputed unless asked
            if val is not None:
                e = F.coalesce(ref(c), F.lit(val))
                filled[c] = val
        exprs.append(e.alias(c))
    return df.select(*exprs), filled


def type_dates(df: DataFrame, convert: dict[str, int]) -> DataFrame:
    """Parse the chosen text columns, each by one layout (the one that reads most of
    its values; cells in another layout become null); date columns become timestamp_ntz."""
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in convert:
            out.append(date_layouts(ref(c))[convert[c]].alias(c))
        elif isinstance(f.dataType, T.DateType):
            out.append(ref(c).cast("timestamp_ntz").alias(c))
        else:
            out.append(ref(c))
    return df.select(*out)


def numeric_of(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if is_numeric_type(f.dataType)]
