"""Operator 8: secret scans with linking of credentials that come in several parts.

DataFrame and SQL functions only.  Each pattern cuts a text into gaps and matches; only
the lengths of both leave the text, and running sums over them give the spans, in code
points.  Three kinds stand alone (``assign``, ``access``, ``hex``).  Two weak kinds, a
bare 40-character key (``key``) and an endpoint URL (``endpoint``), are candidates that
count only where complementary parts co-occur: an interval join within the document
links each access identifier to keys and endpoints at most ``scope`` characters away,
and each assigned secret to endpoints.  Linked candidates are reported as spans.  The
distance is the gap between the two spans, however long they are.

The join is an equi-join on (document, side, cell of ``scope`` characters): a candidate
after its anchor part is met by its start and the part's end, one before it by its end
and the part's start, and the part is copied to the neighbouring cell of that side.  A
cell holds at most ``scope`` / 6 parts, so no group grows with the data.

Defined results: null and empty texts have no spans; a text of any length is scanned whole,
and its parts are spread by their cells; repeated rows are scanned and
returned row by row; an empty table gives an empty result.  Only ``doc_id``, ``text``
and the ``carry`` columns are read; internal columns start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.session import materialize

#: kind, pattern, group whose length counts, least length; in the order of ties.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
WEAK = (
    ("key", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 0, 40),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[A-Za-z0-9._~/?#@!$&()*+,;%=-]*", 0, 10),
)
ALL = KINDS + WEAK
SCOPE = 256


def _cuts(text: Column, kind: int) -> Column:
    """Array of (kind, gap before the match, match length, length that counts)."""
    _, pattern, group, _ = ALL[kind]
    p = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    counted = F.regexp_extract_all(text, p, F.lit(group))
    pick = lambda a, i: F.length(F.get(a, i))
    cuts = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("w"), counted.alias("c")),
                       lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["g"]).alias("gap"),
                                          F.length(x["w"]).alias("len"), F.length(x["c"]).alias("counts")))
    return F.when(F.regexp(text, p), F.filter(cuts, lambda x: x["len"].isNotNull())).otherwise(
        F.array().cast("array<struct<kind:int,gap:int,len:int,counts:int>>"))


def scan_parts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document, written once: __row, doc_id, the carried columns, __cuts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", *carry, text.alias("__t"))
    cuts = F.concat(*[_cuts(F.col("__t"), k) for k in range(len(ALL))])
    return materialize(base.select(F.monotonically_increasing_id().alias("__row"), "doc_id", *carry,
                                   cuts.alias("__cuts")), "secrets")


def part_spans(scanned: DataFrame) -> DataFrame:
    """__row, kind, start, end of every match that is long enough."""
    cut = scanned.select("__row", F.posexplode("__cuts").alias("at", "c")).select("__row", "at", "c.*")
    upto = W.partitionBy("__row", "kind").orderBy("at")
    spans = cut.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)) \
               .withColumn("start", F.col("end") - F.col("len"))
    least = F.element_at(F.array(*[F.lit(k[3]) for k in ALL]), F.col("kind") + 1)
    return spans.filter(F.col("counts") >= least).select("__row", "kind", "start", "end")


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(anchor, weak candidate) pairs with at most ``scope`` characters between them in one document.

    Keys need an access identifier, endpoints an access identifier or an assigned secret."""
    def cell(x: str) -> Column:
        return (F.col(x) / scope).cast("long")

    def at(after: bool, c: Column) -> Column:
        return F.struct(F.lit(after).alias("__after"), c.alias("__cell"))

    assign, access, key, endpoint = 0, 1, 3, 4
    anchors = spans.filter(F.col("kind").isin(assign, access)).select(
        F.col("__row").alias("__arow"), F.col("kind").alias("a_kind"), F.col("start").alias("a_start"), F.col("end").alias("a_end"),
        F.explode(F.array(at(True, cell("end")), at(True, cell("end") + 1),
                          at(False, cell("start")), at(False, cell("start") - 1))).alias("__at"))
    weak = spans.filter(F.col("kind").isin(key, endpoint)).select(
        "*", F.explode(F.array(at(True, cell("start")), at(False, cell("end")))).alias("__w"))
    gap = F.when(F.col("__w.__after"), F.col("start") - F.col("a_end")).otherwise(F.col("a_start") - F.col("end"))
    fits = (F.col("a_kind") == access) | (F.col("kind") == endpoint)
    return weak.join(anchors, (F.col("__row") == F.col("__arow")) & (F.col("__w.__after") == F.col("__at.__after"))
                     & (F.col("__w.__cell") == F.col("__at.__cell")) & gap.between(0, scope) & fits) \
               .select("__row", "kind", "start", "end", "a_kind", "a_start", "a_end")


def find_secrets(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """__row, kind, start, end: base spans, and weak spans that are linked."""
    spans = materialize(part_spans(scanned), "spans")
    linked = link_parts(spans, scope).select("__row", "kind", "start", "end").distinct()
    return spans.filter(F.col("kind") < len(KINDS)).unionByName(linked)


def _attach(scanned: DataFrame, per_row: DataFrame, name: str) -> DataFrame:
    """``scanned`` with the array ``name``; only rows that hold a match are shuffled."""
    empty = F.array().cast(per_row.schema[name].dataType)
    hit, rest = scanned.filter(F.size("__cuts") > 0), scanned.filter(F.size("__cuts") == 0)
    joined = hit.join(per_row.withColumnRenamed("__row", "__frow"), F.col("__row") == F.col("__frow"), "left") \
                .withColumn(name, F.coalesce(F.col(name), empty)).drop("__frow")
    return joined.unionByName(rest.withColumn(name, empty)).drop("__cuts", "__row")


def secret_scan(docs: DataFrame, scope: int = SCOPE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried columns, ``found``: array of (start, kind, end) sorted by start, then kind.

    ``kind`` is an index into ``ALL``; base kinds are always there, weak kinds if linked."""
    scanned = scan_parts(docs, carry)
    per_row = find_secrets(scanned, scope).groupBy("__row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    return _attach(scanned, per_row, "found")


def span_text(found: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in ALL])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``docs``, same columns, each run of overlapping spans replaced by ``mark``.

    ``n_chars``, where there is such a column, follows the new text; null texts stay null."""
    cols = docs.columns
    safe = docs.select("doc_id", *[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(cols)], "text")
    carry = tuple(f"__c{i}" for i in range(len(cols)))
    scanned = scan_parts(safe, carry)
    by_start = W.partitionBy("__row").orderBy("start", "end", "kind")
    reach = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    runs = find_secrets(scanned, scope) \
        .withColumn("__new", F.when(F.col("start") < reach, 0).otherwise(1)) \
        .withColumn("__run", F.sum("__new").over(by_start)) \
        .groupBy("__row", "__run").agg(F.min("start").alias("s"), F.max("end").alias("e")) \
        .groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))
    text = F.col(carry[cols.index("text")])

    def upto(i: Column) -> Column:
        return F.coalesce(F.get("runs", i)["e"], F.lit(0))

    pieces = F.transform("runs", lambda r, i: F.concat(
        F.substring(text, (upto(i - 1) + 1).cast("int"), (r["s"] - upto(i - 1)).cast("int")), F.lit(mark)))
    tail = F.substring(text, (upto(F.size("runs") - 1) + 1).cast("int"), F.length(text))
    clean = F.when(F.size("runs") == 0, text).otherwise(F.concat(F.array_join(pieces, ""), tail))
    out = _attach(scanned, runs, "runs").withColumn("__clean", clean)
    types = dict(docs.dtypes)
    return out.select(*[
        F.col("__clean").alias(c) if c == "text" else
        F.when(F.size("runs") == 0, F.col(carry[i])).otherwise(F.length("__clean")).cast(types[c]).alias(c)
        if c == "n_chars" else F.col(carry[i]).alias(c) for i, c in enumerate(cols)])
