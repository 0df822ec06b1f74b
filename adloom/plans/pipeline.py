"""clean_dataset: load -> validate -> clean -> features -> ordered features.

Spark jobs, in order (everything else is lazy):
  1. stage table of the rows; null counts, means, min / max and date parse counts
     are Observation metrics of that same write.  Hashes tell whether rows have
     copies; if so, they are dropped (hash aggregate) in parts;
  2. (no separate pass for those statistics);
  3. one wide aggregate for the feature statistics (+ one cheap pass deciding
     which columns have >= 3 distinct values);
  4. one table of distinct values and their ranks for all rank targets (see
     operators/ordered.py); percentiles are then looked up, not joined;
  5. range partition + checkpoint for the date-ordered windows.
The result is a lazy DataFrame; nothing is collected except one-row stats.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.functions.exprs import epoch_micros, is_datetime_type, is_numeric_type, nan_to_null, plain_zero, pround, ref
from adloom.operators import clean as C
from adloom.operators import features as FE
from adloom.operators.ordered import (BUCKET, PLACE, OrderConfig, attach_percentiles, exact_quantiles, n_buckets,
                                      n_parts, percentile_steps, rank_table, sequence_ops)
from adloom.operators.roles import (CUMULATIVE_TARGETS, RANK_TARGETS, has_date_keyword,
                                    metric_keyword_columns)
from adloom.session import brief_shuffles, discard, materialize_parts

ALL_BLOCKS = frozenset({"funnel", "temporal", "efficiency", "flags", "zscore", "percentile",
                        "rolling", "cumulative", "tier", "engagement", "campaign", "quality"})


@dataclass
class CleanOptions:
    fill_strategy: str | None = "zero"
    strategy_numeric: str | None = None
    strategy_categorical: str | None = "mode"
    impute_dates: bool = False          # Q5: do not invent dates by default
    order_keys: list[str] | None = None  # tie-breakers after the date; default: all raw columns
    blocks: frozenset = ALL_BLOCKS      # feature blocks to compute
    order: OrderConfig = field(default_factory=OrderConfig)
    checkpoint_base: bool = True


@dataclass
class CleanResult:
    df: DataFrame
    report: dict
    raw_columns: list[str]
    date_col: str | None
    order_cols: list[str]
    placed: DataFrame | None = None     # ``df`` with the place of each row in the order (column PLACE), if it was sequenced
    parts: list[DataFrame] | None = None    # ``placed`` in parts that follow the order, for writing one after the other


def clean_dataset(df: DataFrame, options: CleanOptions | None = None) -> CleanResult:
    with brief_shuffles(df.sparkSession):
        return _clean(df, options or CleanOptions())


def _clean(df: DataFrame, opt: CleanOptions) -> CleanResult:
    blocks = opt.blocks
    report: dict = {"warnings": []}
    strat_num, strat_cat = C.effective_strategies(opt.fill_strategy, opt.strategy_numeric,
                                                  opt.strategy_categorical)
    report["strategy_numeric"], report["strategy_categorical"] = strat_num, strat_cat

    # ---- names, NaN -> null, dedup ----------------------------------------
    df = C.normalize_headers(df)
    df = df.select(*[plain_zero(nan_to_null(ref(f.name), f.dataType), f.dataType).alias(f.name) for f in df.schema.fields])
    base = df.dropDuplicates()
    numeric = C.numeric_of(base.schema)
    categorical = [f.name for f in base.schema.fields if isinstance(f.dataType, T.StringType)]
    rename, warn = C.alias_plan(base.columns)
    report["warnings"] += warn
    final_name = {c: rename.get(c, c) for c in base.columns}
    date_text = [c for c in categorical if has_date_keyword(final_name[c])]

    # ---- null counts, means, min / max, date parse counts -------------------
    # Computed as Observation metrics while the base is written to its stage table,
    # so they cost no extra pass over the data, unless rows have copies.
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count(ref(c)).alias(f"nn__{c}") for c in base.columns]
    aggs += [F.avg(ref(c)).alias(f"mean__{c}") for c in numeric]
    aggs += [x for c in numeric for x in (F.min(ref(c)).alias(f"lo__{c}"), F.max(ref(c)).alias(f"hi__{c}"))]
    aggs += [F.count(e).alias(f"dt__{c}__{i}") for c in date_text for i, e in enumerate(C.date_layouts(ref(c)))]
    if opt.checkpoint_base:
        obs = Observation("adloom_base_stats")
        base = materialize_parts([df.observe(obs, *aggs)], "base")
        s1 = dict(obs.get)
        if C.may_repeat(base):
            rows = base
            base = materialize_parts(C.drop_copies(rows, n_parts(int(s1["__n"]), len(rows.columns), opt.order.cells_per_part)), "base")
            discard(rows)
            s1 = base.agg(*aggs).first().asDict()
    else:
        s1 = base.agg(*aggs).first().asDict()
    n = int(s1["__n"])
    null_counts = {c: n - int(s1[f"nn__{c}"]) for c in base.columns}
    means = {c: s1[f"mean__{c}"] for c in numeric}
    report["rows"] = n
    report["columns_before"], report["null_counts"] = list(base.columns), null_counts

    filled, fills = C.fill_missing(base, numeric=numeric, categorical=categorical,
                                   null_counts=null_counts, means=means, n_rows=n,
                                   strategy_numeric=strat_num, strategy_categorical=strat_cat,
                                   impute_dates=opt.impute_dates)
    report["filled"] = fills
    if rename:
        filled = filled.withColumnsRenamed(rename)
        report["renamed"] = rename
    convert = {}
    for c in date_text:
        parsed = [int(s1[f"dt__{c}__{i}"]) for i in range(C.N_LAYOUTS)]
        if max(parsed) == 0 and n > null_counts[c]:
            report["warnings"].append(f"'{final_name[c]}' holds no date in any known layout; kept as text")
        else:
            convert[final_name[c]] = parsed.index(max(parsed))   # fullest; ties: month first
    typed = C.type_dates(filled, convert)
    numeric_final = [final_name[c] for c in numeric]
    report["numeric_columns"] = numeric_final
    report["categorical_columns"] = [final_name[c] for c in categorical]
    report["detected_metrics"], report["detected_revenue"] = metric_keyword_columns(typed.columns)
    raw_columns = list(typed.columns)
    types = {f.name: f.dataType for f in typed.schema.fields}

    # ---- schema-only planning ----------------------------------------------
    cols = FE.base_columns(typed)
    if "funnel" in blocks:
        FE.add_funnel_basics(cols)
    dt_cols = [c for c in raw_columns if is_datetime_type(types[c])]
    date_col = dt_cols[0] if dt_cols else None
    spend = FE.spend_column(list(cols.keys()))
    if "efficiency" in blocks:
        FE.add_efficiency(cols, spend)
    if "flags" in blocks:
        FE.add_flags(cols)

    # columns of the input that a feature overwrites: from here on everything
    # (statistics, ranks, sequencing, z-scores) reads the overwritten values
    typed, types = _overwrite(cols, typed)

    # ---- job: feature statistics --------------------------------------------
    planned = cols.frame(typed)
    st = [F.count(F.lit(1)).alias("__n")]
    later = set(FE.TEMPORAL_NAMES) if date_col and "temporal" in blocks else set()
    zcand = [c for c in numeric_final if "zscore" in blocks and c not in later]
    inv_name = {v: k for k, v in final_name.items()}
    fresh = [c for c in zcand if c in cols.replaced]   # their range is not known yet
    spans = planned.agg(*[x for c in fresh for x in (F.min(ref(c)).alias(f"lo__{c}"), F.max(ref(c)).alias(f"hi__{c}"))]) \
        .first().asDict() if fresh else {}
    for c in zcand:
        st += [F.avg(ref(c)).alias(f"m__{c}"), F.stddev_samp(ref(c)).alias(f"s__{c}")]
        # ">= 3 distinct values" <=> some value strictly between min and max; the
        # filled min / max follow from the raw ones (zero fill adds 0, a mean
        # fill stays inside), so this needs no extra pass
        lo, hi = (spans[f"lo__{c}"], spans[f"hi__{c}"]) if c in fresh else \
            _filled_range(s1, inv_name[c], null_counts[inv_name[c]], strat_num)
        if lo is not None and hi is not None and lo < hi:
            st.append(F.count_if((ref(c) > F.lit(lo)) & (ref(c) < F.lit(hi))).alias(f"mid__{c}"))
    eng = [p for p in FE.ENGAGEMENT_PARTS if p in cols] if "engagement" in blocks else []
    for p in eng:
        st += [F.min(ref(p)).alias(f"elo__{p}"), F.max(ref(p)).alias(f"ehi__{p}")]
    rank_cols = [c for c in RANK_TARGETS if c in cols and is_numeric_type(planned.schema[c].dataType)
                 and ("percentile" in blocks or (c == "roas" and "tier" in blocks))]
    for c in rank_cols:
        st.append(F.count(ref(c)).alias(f"rn__{c}"))
    if date_col and "temporal" in blocks:
        st.append(F.min(epoch_micros(date_col, types[date_col])).alias("__dmin"))
    s2 = planned.agg(*st).first().asDict()

    if date_col and "temporal" in blocks:
        FE.add_temporal(cols, date_col, types[date_col], s2.get("__dmin"))
        # temporal columns are inserted after the funnel basics in the reference
        _move_after(cols, ["day_of_week", "is_weekend", "month", "quarter", "week_number",
                           "days_since_start"], anchor=_last_of(cols, ["conversion_rate", "ctr", "revenue"]),
                    keep=raw_columns)
        typed, types = _overwrite(cols, typed)

    # z-scores: >= 3 distinct values and std != 0
    zstats = {c: (float(s2[f"m__{c}"]), float(s2[f"s__{c}"])) for c in zcand
              if s2[f"s__{c}"] not in (None, 0.0) and (s2.get(f"mid__{c}") or 0) > 0}
    FE.add_zscores(cols, zstats)

    frame = cols.frame(typed)

    # ---- ranks of values (W1 percentiles, F25 quartile edges) ------------------
    sizes = {c: int(s2[f"rn__{c}"]) for c in rank_cols}
    ranks = rank_table(frame, rank_cols) if rank_cols else None
    ranked = [c for c in RANK_TARGETS if c in sizes and "percentile" in blocks]
    pct_cols = [f"{c}_percentile" for c in ranked]

    # ---- date-ordered windows (W2, W3) ---------------------------------------
    # Sequenced on the narrow feature frame (recomputed cheaply from the
    # checkpointed base); the percentile joins are attached afterwards.
    order_cols: list[str] = []
    seq_cols: list[str] = []
    place: list = []
    k = nb = 1
    if date_col:
        keys = opt.order_keys if opt.order_keys is not None else [c for c in raw_columns if c != date_col]
        order_cols = [date_col] + [k for k in keys if k != date_col]
        roll = [c for c in RANK_TARGETS if c in frame.columns] if ("rolling" in blocks and n >= 3) else []
        cum = [c for c in CUMULATIVE_TARGETS if c in frame.columns] if "cumulative" in blocks else []
        if spend and "cumulative" in blocks:
            cum.append(spend)
        if roll or cum:
            # Sequence only the raw columns (they are the order keys) plus the
            # derived measures the windows need; every other feature is a narrow
            # expression over raw columns and is applied after the window pass,
            # so the range shuffle, sort and stage table stay narrow.
            need = [c for c in dict.fromkeys(roll + cum) if c not in raw_columns]
            seq_in = typed.select(*map(ref, raw_columns))
            seq = sequence_ops(seq_in, order_cols, n_rows=n, cum_cols=cum, roll_cols=roll, cfg=opt.order,
                               place_col=PLACE, bucket_col=BUCKET, derived={c: cols[c] for c in need})
            if opt.checkpoint_base:
                discard(base)       # every row is in the sequenced table now
            k = n_parts(n, len(raw_columns), opt.order.cells_per_part)
            nb = math.ceil(n_buckets(n, opt.order) / k)
            ma_names = [f"{c}_ma{k}" for c in roll for k in (3, 7)]
            # reference order: moving averages (per column, 3 then 7) before cumulative sums
            known = [*raw_columns, *need]
            seq_cols = ma_names + [c for c in seq.columns if c not in known and c not in ma_names and c not in (PLACE, BUCKET)]
            place = [F.col(PLACE), F.col(BUCKET)]
            frame = seq.select(*[ref(nm) if nm in known else e.alias(nm) for nm, e in cols.items()
                                 if nm not in seq_cols],
                               *[pround(ref(c), 4).alias(c) if c in ma_names else ref(c) for c in seq_cols], *place)
    if ranked:
        steps = percentile_steps(ranks, {c: sizes[c] for c in ranked})
        frame = attach_percentiles(frame.drop(*pct_cols), steps, {c: f"{c}_percentile" for c in ranked})
    ordered = [c for c in frame.columns if c not in pct_cols and c not in seq_cols and not (place and c in (PLACE, BUCKET))] + pct_cols + seq_cols
    frame = frame.select(*map(ref, ordered), *place)

    # ---- remaining narrow features -------------------------------------------
    cols = FE.Columns((c, ref(c)) for c in ordered)
    if "tier" in blocks and "roas" in sizes and n >= 4:
        edges = exact_quantiles(ranks, {"roas": sizes["roas"]}, [0.0, 0.25, 0.5, 0.75, 1.0]).get("roas")
        if edges is not None and len(set(edges)) == 5:
            cols["spend_efficiency_tier"] = FE.tier_expr(F.col("roas"), edges)
            report["tier_edges"] = edges
        else:
            report["warnings"].append("spend_efficiency_tier skipped: fewer than 5 distinct quartile edges")
    if eng:
        FE.add_engagement(cols, {p: (s2[f"elo__{p}"], s2[f"ehi__{p}"]) for p in eng})
    if "campaign" in blocks:
        FE.add_campaign(cols, FE.campaign_column(list(cols.keys())))
    if "quality" in blocks:
        FE.add_quality_score(cols)
    placed = frame.select(*[e.alias(name) for name, e in cols.items()], *place)
    out = placed.select(*map(ref, cols)) if place else placed
    report["columns_after"] = out.columns
    if not place:
        return CleanResult(out, report, raw_columns, date_col, order_cols)
    bucket = F.col(BUCKET)          # the first part and the last are open: whatever the number of buckets, no row is left out
    parts = [placed.where((bucket >= (i * nb if i else 0)) & ((bucket < (i + 1) * nb) if i < k - 1 else F.lit(True))).drop(BUCKET) for i in range(k)]
    return CleanResult(out, report, raw_columns, date_col, order_cols, placed.drop(BUCKET), parts)


def _overwrite(cols: FE.Columns, typed: DataFrame):
    """``typed`` with the overwritten input columns in place; ``cols`` then refers to them."""
    names = [c for c in typed.columns if c in cols.replaced]
    if names:
        typed = typed.select(*[cols[c].alias(c) for c in typed.columns])
        for c in names:
            cols[c] = ref(c)
    return typed, {f.name: f.dataType for f in typed.schema.fields}


def _filled_range(s1: dict, c: str, nulls: int, strategy: str):
    """Min / max of column ``c`` after imputation, from the raw statistics."""
    lo, hi = s1.get(f"lo__{c}"), s1.get(f"hi__{c}")
    if nulls == 0:
        return lo, hi
    if lo is None:  # all null -> filled with 0
        return 0, 0
    if strategy == "mean":
        return lo, hi
    return min(lo, 0), max(hi, 0)


def _last_of(cols, names):
    present = [n for n in names if n in cols]
    if not present:
        return None
    keys = list(cols.keys())
    return max(present, key=keys.index)


def _move_after(cols: FE.Columns, names: list[str], anchor: str | None, keep: list[str]) -> None:
    """Place ``names`` right after ``anchor`` (or after the raw columns); those in ``keep`` stay."""
    names = [n for n in names if n not in keep]
    if anchor in keep:
        anchor = keep[-1]
    items = list(cols.items())
    moving = [(k, v) for k, v in items if k in names]
    rest = [(k, v) for k, v in items if k not in names]
    if anchor is None or anchor not in dict(rest):
        idx = len(rest)
        for i, (k, _) in enumerate(rest):
            if k in ("roas", "cpa", "cpc", "cpm", "profit", "profit_margin",
                     "is_suspicious_traffic", "is_ctr_anomaly"):
                idx = i
                break
    else:
        idx = [k for k, _ in rest].index(anchor) + 1
    new = rest[:idx] + moving + rest[idx:]
    cols.clear()
    cols.update(new)
