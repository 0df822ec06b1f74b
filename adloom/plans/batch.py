"""Cleaning of a batch of files in the jobs of one (C2-C8, F1-F25, W1-W3 keyed by file).

Each file is cleaned as ``clean_dataset`` cleans it alone: its own means, modes, date
layout, z-scores, quartiles, running sums.  What is one literal there is a column here, from
a table with a row per file: aggregates are grouped by file, running sums and ranks are
partitioned by file (a large file spreads over many buckets), and the statistics come back
by a broadcast join, whose size is the number of files of the batch; these rows are also
all that reaches the driver.

Files whose columns get different types form shapes: which text columns hold dates, and,
if means are filled in, which whole-number columns have gaps.  Jobs are per shape, however
many files it has.  A feature that a file is not due (no third value for a z-score, no
five quartile edges, fewer than three rows) is null here, and not among the file's columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions.exprs import epoch_micros, is_datetime_type, is_numeric_type, nan_to_null, pround, ref
from adloom.operators import clean as C
from adloom.operators import features as FE
from adloom.operators.ordered import _lerp, rank_table, sequence_ops
from adloom.operators.roles import CUMULATIVE_TARGETS, RANK_TARGETS, has_date_keyword
from adloom.plans.pipeline import CleanOptions, _last_of, _move_after, _overwrite
from adloom.session import materialize
from adloom.sources.csv import header_names

FILE = "__f"
QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


@dataclass
class Cleaned:
    """Files of one shape: their rows, and the columns of each file's table."""
    df: DataFrame                          # with the column FILE
    columns: dict[str, list[str]]
    reports: dict[str, dict] = field(default_factory=dict)


class PerFile:
    """Constants of each file as columns: a small table, joined once."""

    def __init__(self, files: list[str]):
        self.files, self.fields, self.values = files, [], []

    def add(self, name: str, kind: str, values: dict) -> Column:
        self.fields.append(f"`{name}` {kind}")
        self.values.append([values.get(f) for f in self.files])
        return F.col(name)

    def join(self, df: DataFrame) -> DataFrame:
        rows = [(f, *v) for f, *v in zip(self.files, *self.values)]
        table = df.sparkSession.createDataFrame(rows, ", ".join(["__k string", *self.fields]))
        return df.join(F.broadcast(table), F.col(FILE) == F.col("__k")).drop("__k")


def _modes(base: DataFrame, cols: list[str]) -> dict:
    """C4 by file: (file, column) -> most frequent value, ties -> the smallest."""
    if not cols:
        return {}
    cell = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), ref(c).cast("string").alias("v")) for c in cols])).alias("x")
    counts = base.select(FILE, cell).select(FILE, "x.c", "x.v").where(F.col("v").isNotNull()) \
        .groupBy(FILE, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(FILE, "c").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v"))).alias("mode"))
    return {(r[FILE], r["c"]): r["mode"] for r in best.collect()}


def clean_files(df: DataFrame, file_col: str, options: CleanOptions | None = None) -> list[Cleaned]:
    """One result per shape.  ``df``: files of one layout and column types, ``file_col`` names the file."""
    opt = options or CleanOptions()
    names = [c for c in df.columns if c != file_col]
    fresh = [C.normalize_name(c) for c in header_names(names)]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    df = df.select(ref(file_col).cast("string").alias(FILE), *[nan_to_null(c, kinds[c]).alias(n) for c, n in zip(names, fresh)])
    strategies = C.effective_strategies(opt.fill_strategy, opt.strategy_numeric, opt.strategy_categorical)
    base = materialize(df.dropDuplicates(), "batch-base")
    columns = [c for c in base.columns if c != FILE]
    numeric = [c for c in C.numeric_of(base.schema) if c != FILE]
    words = [c for c in columns if isinstance(base.schema[c].dataType, T.StringType)]
    rename, renamed_not = C.alias_plan(columns)
    final = {c: rename.get(c, c) for c in columns}
    dates = [c for c in words if has_date_keyword(final[c])]
    place = {c: i for i, c in enumerate(columns)}

    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.count(ref(c)).alias(f"nn{place[c]}") for c in columns]
    aggs += [F.avg(ref(c)).alias(f"mean{place[c]}") for c in numeric]
    aggs += [F.count(e).alias(f"dt{place[c]}_{i}") for c in dates for i, e in enumerate(C.date_layouts(ref(c)))]
    first = {r[FILE]: r.asDict() for r in base.groupBy(FILE).agg(*aggs).collect()}
    nulls = {f: {c: s["n"] - s[f"nn{place[c]}"] for c in columns} for f, s in first.items()}
    modes = _modes(base, [c for c in words if opt.impute_dates or not has_date_keyword(c)]) if strategies[1] == "mode" else {}

    shapes: dict[tuple, list[str]] = {}
    layouts: dict[str, dict[str, int]] = {}
    for f, s in sorted(first.items()):
        parsed = {c: [s[f"dt{place[c]}_{i}"] for i in range(C.N_LAYOUTS)] for c in dates}
        layouts[f] = {c: p.index(max(p)) for c, p in parsed.items() if max(p) > 0 or s["n"] == nulls[f][c]}
        gaps = [c for c in numeric if strategies[0] == "mean" and nulls[f][c] > 0]
        shapes.setdefault((tuple(layouts[f]), tuple(gaps)), []).append(f)
    return [_clean_shape(base, files, list(typed), list(gaps), opt, strategies, first, nulls, modes, layouts, numeric, words, rename, final, renamed_not, place)
            for (typed, gaps), files in shapes.items()]


def _clean_shape(base, files, typed, gaps, opt, strategies, first, nulls, modes, layouts, numeric, words, rename, final, renamed_not, place) -> Cleaned:
    blocks = opt.blocks
    reports = {f: {"warnings": list(renamed_not), "strategy_numeric": strategies[0], "strategy_categorical": strategies[1], "rows": first[f]["n"],
                   "columns_before": list(place), "null_counts": nulls[f], "filled": {}, **({"renamed": rename} if rename else {})} for f in files}
    for f in files:
        for c in place:
            if c in words and has_date_keyword(final[c]) and c not in layouts[f]:
                reports[f]["warnings"].append(f"'{final[c]}' holds no date in any known layout; kept as text")

    # ---- C2-C8: gaps and dates, by constants of the file ---------------------
    known = PerFile(files)
    cells = []
    for c in place:
        e, i = ref(c), place[c]
        if c in numeric:
            if strategies[0] == "mean":
                fill = {f: float(first[f][f"mean{i}"] or 0.0) for f in files if nulls[f][c]}
                e = F.coalesce(e.cast("double"), known.add(f"__fill{i}", "double", fill)) if c in gaps else e
            else:
                fill = {f: 0 for f in files if nulls[f][c]}
                e = F.coalesce(e, F.lit(0).cast(base.schema[c].dataType))
        elif c in words:
            whole = lambda f: nulls[f][c] >= first[f]["n"] or strategies[1] == "constant"
            fill = {f: "Unknown" if whole(f) else modes.get((f, c)) for f in files if nulls[f][c]}
            e = F.coalesce(e, known.add(f"__fill{i}", "string", fill))
        else:
            fill = {}
        for f, v in fill.items():
            if v is not None:
                reports[f]["filled"][c] = v
        if c in typed:
            layout, read = known.add(f"__lay{i}", "int", {f: layouts[f][c] for f in files}), None
            for k, way in enumerate(C.date_layouts(e)):
                read = F.when(layout == k, way) if read is None else read.when(layout == k, way)
            e = read
        elif isinstance(base.schema[c].dataType, T.DateType):
            e = e.cast("timestamp_ntz")
        cells.append(e.alias(final[c]))
    frame = known.join(base).select(FILE, *cells)
    raw = [final[c] for c in place]
    types = {f.name: f.dataType for f in frame.schema.fields}

    # ---- F1-F17, from the schema ---------------------------------------------
    cols = FE.Columns((c, ref(c)) for c in [FILE, *raw])
    if "funnel" in blocks:
        FE.add_funnel_basics(cols)
    date_col = next((c for c in raw if is_datetime_type(types[c])), None)
    spend = FE.spend_column([c for c in cols if c != FILE])
    if "efficiency" in blocks:
        FE.add_efficiency(cols, spend)
    if "flags" in blocks:
        FE.add_flags(cols)
    frame, types = _overwrite(cols, frame)

    # ---- statistics of the features, by file ------------------------------------
    planned = cols.frame(frame)
    temporal = date_col and "temporal" in blocks
    later = set(FE.TEMPORAL_NAMES) if temporal else set()
    zcols = [final[c] for c in numeric if "zscore" in blocks and final[c] not in later]
    parts = [p for p in FE.ENGAGEMENT_PARTS if p in cols] if "engagement" in blocks else []
    ranked = [c for c in RANK_TARGETS if c in cols and is_numeric_type(planned.schema[c].dataType)
              and ("percentile" in blocks or (c == "roas" and "tier" in blocks))]
    st = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(zcols):
        st += [F.avg(ref(c)).alias(f"m{i}"), F.stddev_samp(ref(c)).alias(f"s{i}"), F.min(ref(c)).cast("double").alias(f"lo{i}"),
               F.max(ref(c)).cast("double").alias(f"hi{i}")]
    for i, p in enumerate(parts):
        st += [F.min(ref(p)).alias(f"elo{i}"), F.max(ref(p)).alias(f"ehi{i}")]
    st += [F.count(ref(c)).alias(f"rn{i}") for i, c in enumerate(ranked)]
    if temporal:
        st.append(F.min(epoch_micros(date_col, types[date_col])).alias("dmin"))
    s2 = {r[FILE]: r.asDict() for r in planned.groupBy(FILE).agg(*st).collect()}
    spans = PerFile(files)
    inner = [F.count_if((ref(c).cast("double") > spans.add(f"__lo{i}", "double", {f: s2[f][f"lo{i}"] for f in files}))
                        & (ref(c).cast("double") < spans.add(f"__hi{i}", "double", {f: s2[f][f"hi{i}"] for f in files}))).alias(f"mid{i}")
             for i, c in enumerate(zcols)]
    mids = {r[FILE]: r for r in spans.join(planned).groupBy(FILE).agg(*inner).collect()} if inner else {}
    due = {f: [i for i in range(len(zcols)) if s2[f][f"s{i}"] not in (None, 0.0) and mids[f][f"mid{i}"] > 0] for f in files}

    facts = PerFile(files)
    if temporal:
        FE.add_temporal(cols, date_col, types[date_col], facts.add("__start", "long", {f: s2[f]["dmin"] for f in files}))
        _move_after(cols, FE.TEMPORAL_NAMES, anchor=_last_of(cols, ["conversion_rate", "ctr", "revenue"]), keep=[FILE, *raw])
    if zcols:
        FE.add_zscores(cols, {c: tuple(facts.add(f"__{k}{i}", "double", {f: s2[f][f"{k}{i}"] for f in files if i in due[f]}) for k in ("m", "s"))
                              for i, c in enumerate(zcols)})
        cols["is_outlier"] = F.when(facts.add("__has_z", "boolean", {f: bool(due[f]) for f in files}), cols["is_outlier"])
    absent = {f: {f"z_{c}" for i, c in enumerate(zcols) if i not in due[f]} | (set() if due[f] else {"is_outlier"}) for f in files}
    if temporal:                       # overwritten temporal columns: what follows reads the new values
        frame = facts.join(frame)
        frame, types = _overwrite(cols, frame.select(*[ref(c) for c in frame.columns]))
    else:
        frame = facts.join(frame)

    # ---- W2, W3: windows within a file -------------------------------------------
    seq_cols: list[str] = []
    added = [x.split("`")[1] for x in facts.fields]
    if date_col:
        keys = opt.order_keys if opt.order_keys is not None else [c for c in raw if c != date_col]
        order = [date_col] + [k for k in keys if k != date_col]
        roll = [c for c in RANK_TARGETS if c in cols] if "rolling" in blocks else []
        cum = [c for c in CUMULATIVE_TARGETS if c in cols] if "cumulative" in blocks else []
        if spend and "cumulative" in blocks:
            cum.append(spend)
        if roll or cum:
            need = [c for c in dict.fromkeys(roll + cum) if c not in raw]
            seq_in = frame.select(*[ref(c) for c in [FILE, *raw, *added]], *[cols[c].alias(c) for c in need])
            frame = sequence_ops(seq_in, order, n_rows=sum(s["n"] for s in s2.values()), cum_cols=cum, roll_cols=roll, cfg=opt.order,
                                 partition_by=[FILE])
            averages = [f"{c}_ma{k}" for c in roll for k in (3, 7)]
            seq_cols = averages + [c for c in frame.columns if c not in seq_in.columns and c not in averages]
            few = [f for f in files if s2[f]["n"] < 3]
            for f in few:
                absent[f] |= set(averages)
            for c in need:
                cols[c] = ref(c)
            for c in seq_cols:
                cols.pop(c, None)
    frame = frame.select(*[e.alias(c) for c, e in cols.items()],
                         *[(pround(ref(c), 4) if c.endswith(("_ma3", "_ma7")) else ref(c)).alias(c) for c in seq_cols])

    # ---- W1, F25: ranks within a file ---------------------------------------------
    pct: list[str] = []
    edges: dict[str, list] = {}
    last = PerFile(files)
    if ranked:
        frame = materialize(frame, "batch-features")
        sizes = frame.sparkSession.createDataFrame([(f, c, s2[f][f"rn{i}"]) for f in files for i, c in enumerate(ranked)], "__k string, __t string, __n long")
        ranks = rank_table(frame, ranked, (FILE,)).join(F.broadcast(sizes), (F.col(FILE) == F.col("__k")) & (F.col("target") == F.col("__t"))) \
            .drop("__k", "__t")
        if "percentile" in blocks:
            share = pround((F.col("before") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)) / F.col("__n"), 4) * F.lit(100.0)
            pct = [f"{c}_percentile" for c in ranked]
            frame = frame.drop(*pct)
            for c in ranked:
                one = ranks.where(F.col("target") == c).select(F.col(FILE).alias("__k"), F.col("value").alias("__v"), share.alias(f"{c}_percentile"))
                frame = frame.join(one, (F.col(FILE) == F.col("__k")) & (ref(c).cast("double") == F.col("__v")), "left").drop("__k", "__v")
        if "tier" in blocks and "roas" in ranked:
            at = lambda p: F.max(F.when((F.col("before") <= p) & (p < F.col("before") + F.col("cnt")), F.col("value")))
            spot = [(F.col("__n") - 1) * F.lit(q) for q in QUARTILES]
            wanted = ranks.where("target = 'roas'").groupBy(FILE).agg(
                *[x for k, p in enumerate(spot) for x in (at(F.floor(p)).alias(f"a{k}"), at(F.least(F.floor(p) + 1, F.col("__n") - 1)).alias(f"b{k}"))])
            i = ranked.index("roas")
            for r in wanted.collect():
                k = s2[r[FILE]][f"rn{i}"] - 1
                edges[r[FILE]] = [_lerp(r[f"a{j}"], r[f"b{j}"], k * q - int(k * q // 1)) for j, q in enumerate(QUARTILES)]
    plain = [c for c in frame.columns if c not in pct and c not in seq_cols]
    frame = frame.select(*[ref(c) for c in plain + pct + seq_cols])
    cols = FE.base_columns(frame)
    if "tier" in blocks and "roas" in ranked:
        good = {f: e for f, e in edges.items() if s2[f]["n"] >= 4 and len(set(e)) == 5}
        cols["spend_efficiency_tier"] = FE.tier_expr(F.col("roas"), [last.add(f"__e{j}", "double", {f: e[j] for f, e in good.items()}) for j in range(5)])
        for f in files:
            if f in good:
                reports[f]["tier_edges"] = good[f]
            else:
                absent[f].add("spend_efficiency_tier")
                reports[f]["warnings"].append("spend_efficiency_tier skipped: fewer than 5 distinct quartile edges")
    if parts:
        FE.add_engagement(cols, {p: tuple(last.add(f"__{k}{i}", "double", {f: s2[f][f"{k}{i}"] for f in files}) for k in ("elo", "ehi"))
                                 for i, p in enumerate(parts)})
    if "campaign" in blocks:
        FE.add_campaign(cols, FE.campaign_column([c for c in cols if c != FILE]))
    own = {f: [c for c in cols if c != FILE and c not in absent[f]] for f in files}
    for i, c in enumerate([c for c in cols if any(c in absent[f] for f in files)]):
        cols[c] = F.when(last.add(f"__has{i}", "boolean", {f: c not in absent[f] for f in files}), cols[c])
    if "quality" in blocks:
        counted = [e.isNotNull().cast("int") for c, e in cols.items() if c != FILE]
        cols["data_quality_score"] = pround(sum(counted[1:], counted[0]) / last.add("__columns", "double", {f: float(len(own[f])) for f in files}) * 100.0, 1)
        own = {f: [*c, "data_quality_score"] for f, c in own.items()}
    out = last.join(frame).select(*[e.alias(c) for c, e in cols.items()])
    for f in files:
        reports[f]["columns_after"] = own[f]
    return Cleaned(out, own, reports)
