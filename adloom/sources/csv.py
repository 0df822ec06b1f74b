"""CSV scans (S1-S3): files by layout, null tokens, one-pass type inference.

One aggregate over the lines of all files makes a table with a row per file: its header
line, whether all its lines are valid UTF-8 (else the file is read as ISO-8859-1), and
whether a quoted cell may hold a line break (a line with an odd number of quotes; only
such files are read whole by one task, all others are split).  Files with the same three
facts form a layout; each layout gets a reader with its own schema, and the readers'
rows are united by column name, so the order of columns and missing ones don't matter.

Repeated header names become ``a``, ``a.1``, ``a.2``, empty ones ``Unnamed: <place>``; names that
differ only in case, outer spaces or spaces for underscores are the same column.

Spark's CSV reader only treats the empty string as missing and would infer types with a
separate full pass per option.  We read every column as text, null the pandas-style missing
tokens, and decide each column's type with a single aggregate of counts per candidate type.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions.exprs import NULL_TOKENS, ref
from adloom.operators.clean import normalize_name
from adloom.session import materialize

# Text that counts as a number: no type suffixes, no hexadecimal forms.
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
NUMBER = r"^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
BOOL_TOKENS = ["true", "false"]


@dataclass
class CsvOptions:
    header: bool = True
    sep: str = ","
    multi_line: bool | None = None  # may quoted cells hold line breaks?  None: looked up file by file
    null_tokens: list[str] = field(default_factory=lambda: list(NULL_TOKENS))
    encoding: str | None = None   # None: UTF-8, or ISO-8859-1 for a file that is not (S2)
    with_file_name: bool = False  # keep the source file name (batch of files, V14)


@dataclass
class Layout:
    """Files that one reader can read."""
    columns: list[str]
    encoding: str
    breaks: bool
    files: list[str] | None        # None: all files of the folder


def file_facts(spark: SparkSession, path) -> DataFrame:
    """(file, header, utf8, breaks), one row per file that has a line.

    Lines know the place of their block in the file, and ids grow within a block, so the
    first line is found whichever task read it."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    some = F.trim(F.col("value")) != ""
    return lines.groupBy("file").agg(
        F.min_by("value", F.when(some, F.col("at"))).alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(quotes % 2 == 1).alias("breaks")).filter(F.col("header").isNotNull())


def header_names(cells: list[str]) -> list[str]:
    """Column names of a header: repeated ones get a number, empty ones their place."""
    out: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(cells):
        name = first = cell if cell and cell.strip() else f"Unnamed: {i}"
        k = 0
        while normalize_name(name) in taken:
            k += 1
            name = f"{first}.{k}"
        taken.add(normalize_name(name))
        out.append(name)
    return out


def layouts(spark: SparkSession, path, opt: CsvOptions) -> list[Layout]:
    """The layouts of a folder.  One row per layout comes to the driver and, if there are
    several, the names of the files, which Spark's own listing keeps there too."""
    facts = file_facts(spark, path)
    header = F.col("header") if opt.header else F.lit(None).cast("string")
    encoding = F.lit(opt.encoding) if opt.encoding else F.when(F.col("utf8"), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1"))
    breaks = F.col("breaks") if opt.multi_line is None else F.lit(opt.multi_line)
    # the text reader keeps bytes as they are; a header in another encoding is decoded here
    header = F.when(encoding == "UTF-8", header).otherwise(F.decode(header.cast("binary"), "ISO-8859-1" if not opt.encoding else opt.encoding))
    facts = materialize(facts.select("file", header.alias("header"), encoding.alias("encoding"), breaks.alias("breaks")), "files")
    kinds = facts.groupBy("header", "encoding", "breaks").agg(F.min("file").alias("one")).collect()
    kinds.sort(key=lambda k: (k["header"] or "", k["encoding"], k["breaks"]))
    files: dict[tuple, list[str]] = {}
    if len(kinds) > 1:
        for r in facts.collect():
            files.setdefault((r["header"], r["encoding"], r["breaks"]), []).append(unquote(r["file"]))
    return [Layout(_names(spark, k, opt), k["encoding"], k["breaks"], sorted(files[key]) if files else None)
            for k in kinds for key in [(k["header"], k["encoding"], k["breaks"])]]


def _names(spark: SparkSession, kind, opt: CsvOptions) -> list[str]:
    line = kind["header"]
    if line is None or line.count('"') % 2:      # no header, or one that goes on in the next line
        first = _reader(spark, opt, kind["encoding"], kind["breaks"]).option("header", False).csv(unquote(kind["one"])).first()
        return header_names(list(first)) if opt.header else first.__fields__
    cells = next(csv.reader([line.removeprefix("\ufeff")], delimiter=opt.sep), [])
    return header_names(cells)


def _reader(spark: SparkSession, opt: CsvOptions, encoding: str, breaks: bool):
    return (spark.read.option("sep", opt.sep).option("multiLine", breaks).option("escape", '"')
            .option("encoding", encoding).option("inferSchema", False).option("mode", "PERMISSIVE"))


def read_layout(spark: SparkSession, path, layout: Layout, opt: CsvOptions) -> DataFrame:
    """All cells as text, under the layout's names."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in layout.columns])
    df = _reader(spark, opt, layout.encoding, layout.breaks).option("header", opt.header).schema(schema) \
        .csv(layout.files if layout.files else path)
    if opt.with_file_name:
        df = df.select("*", F.col("_metadata.file_name").alias("_file_name"))
    return df


def same_spelling(found: list[Layout]) -> list[Layout]:
    """Layouts whose names follow the first layout that has the column."""
    spelled: dict[str, str] = {}
    return [replace(x, columns=[spelled.setdefault(normalize_name(c), c) for c in x.columns]) for x in found]


def _nulls(c: Column, tokens: list[str]) -> Column:
    return F.when(c.isin(tokens), F.lit(None).cast("string")).otherwise(c)


def _numeric(c: Column, kind: str) -> Column:
    """The cell as a number, null for any other text."""
    shape = INTEGER if kind == "bigint" else NUMBER
    return F.when(c.rlike(shape), F.trim(c).try_cast(kind))


def type_counts(text_cols: list[str]) -> list[Column]:
    """Counts that decide a column's type: cells, whole numbers, numbers, booleans."""
    aggs = []
    for i, c in enumerate(text_cols):
        x = ref(c)
        aggs += [F.count(x).alias(f"nn__{i}"), F.count(_numeric(x, "bigint")).alias(f"i__{i}"),
                 F.count(_numeric(x, "double")).alias(f"d__{i}"), F.count_if(F.lower(F.trim(x)).isin(BOOL_TOKENS)).alias(f"b__{i}")]
    return aggs


def type_name(i: int) -> Column:
    """The type of the i-th column from its counts; a column without a cell reads as numbers."""
    n = F.col(f"nn__{i}")
    out = F.when(n == 0, F.lit("double"))
    for t, k in (("bigint", "i"), ("double", "d"), ("boolean", "b")):
        out = out.when(F.col(f"{k}__{i}") == n, F.lit(t))
    return out.otherwise(F.lit("string"))


def infer_types(df: DataFrame, text_cols: list[str]) -> dict[str, str]:
    """One aggregate -> {column: spark type}."""
    if not text_cols:
        return {}
    r = df.agg(*type_counts(text_cols)).select(*[type_name(i).alias(f"t{i}") for i in range(len(text_cols))]).first()
    return dict(zip(text_cols, r))


def typed_cell(c: str, kind: str) -> Column:
    x = ref(c)
    if kind == "boolean":
        return (F.lower(F.trim(x)) == "true").alias(c)
    return x.alias(c) if kind == "string" else _numeric(x, kind).alias(c)


def null_tokens(df: DataFrame, opt: CsvOptions) -> DataFrame:
    return df.select(*[ref(c) if c == "_file_name" else _nulls(ref(c), opt.null_tokens).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path, options: CsvOptions | None = None) -> tuple[DataFrame, dict]:
    """Typed DataFrame plus a small report (encodings, layouts, inferred types)."""
    opt = options or CsvOptions()
    found = same_spelling(layouts(spark, path, opt))
    if not found:
        raise ValueError(f"no line in {path}")
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_layout(spark, path, x, opt) for x in found])
    data_cols = [c for c in raw.columns if c != "_file_name"]
    text = null_tokens(raw.select(*[ref(c) for c in data_cols], *(["_file_name"] if opt.with_file_name else [])), opt)
    types = infer_types(text, data_cols)
    out = text.select(*[typed_cell(c, types[c]) for c in data_cols], *(["_file_name"] if opt.with_file_name else []))
    return out, {"encoding": ", ".join(sorted({x.encoding for x in found})), "layouts": len(found), "types": types}
