"""Operator 2: removal of long repeated byte strings with per-shard suffix arrays.

A byte goes if a string of ``span`` bytes that covers it also starts elsewhere.  To let
equal strings meet without bringing the corpus together:

1. Equal texts become one class.  Every start of a ``span``-byte string picks its anchor:
   the ``window``-byte window with the least hash among those inside the string (the
   leftmost of equal ones).  Equal strings pick equal windows, so a string can repeat only
   if its anchor's hash does.  Neighbouring starts share an anchor; per text some
   len / 70 hashes are counted in Spark, and only starts with a repeated anchor go on.
2. These starts are dealt to shards by anchor: runs of starts with their bytes
   ("segments", span - 1 bytes longer than the run).  Byte-equal segments collapse before
   the suffix arrays (their starts are repeats already; one stays as a partner), and a
   task sends the bytes of a segment only once.
3. A shard is cut into blocks of at most 2 MB, and each gets a suffix array: Larsson-
   Sadakane refinement in numpy sorts the groups that are not single yet by the rank of
   the suffix h bytes on, doubling h up to ``span``.  Kasai's common prefixes follow in
   text order: where the predecessor of position i + 1 follows that of i, the common prefix is one
   shorter; only other positions, those after a prefix of 0 and every 128th compare bytes.  Starts with a common
   prefix of ``span`` or more are repeats.
4. An anchor with more runs than surely fit one block (``crowd``, some 6,200) could bring
   a segment of every document to one task.  Its segments are cut again at the anchors of
   wider windows (166 bytes, then 192), which fewer strings share; those that are not crowded
   go to the shards of step 2.  Only the few starts whose widest window is crowded still are
   dealt one by one, by the 128-bit hash of their own string: equal strings still meet, as
   counts that combine before the shuffle, and no task holds the group.  A segment a task has
   met before is a repeat.
5. Covered intervals are merged by class and cut from the text.

Segments are separated by 0xFF, which UTF-8 lacks, so no match crosses documents.

Defined results: null and empty texts have 0 bytes and nothing to remove; equal rows and
equal texts of at least ``span`` bytes remove each other whole; a text shorter than
``span`` keeps all; an empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import bounded_texts, join_few, mix64, power_tables, small_slices, texts_of
from adloom.session import materialize

BITS = 21                       # positions and ranks of a block
BLOCK = (1 << BITS) - 1024
FIRST = 5                       # bytes of the first key: 40 bits and a position fit 64
_BYTES = np.random.default_rng(31).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchor_runs(texts: list[bytes], span: int, window: int):
    """For all texts at once: (text, first start, last start, anchor position, hash) of each run
    of starts with one anchor; positions count from the beginning of the text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, m = len(data), span - window + 1
    if n < span:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    up, down = power_tables(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64)))
    h = mix64((sums[window:] - sums[:-window]) * down[:n - window + 1])
    # sliding minimum of (upper half of the hash, position) over m windows
    key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(key) // m) + 1
    padded = np.full(rows * m, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(key)] = key
    grid = padded.reshape(rows, m)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - span + 1
    best = np.minimum(back[:count], ahead[m - 1:m - 1 + count])
    start = np.arange(count)
    text = np.searchsorted(ends, start, "right")
    inside = start + span <= ends[np.minimum(text, len(ends) - 1)]
    start, text = start[inside], text[inside]
    at = (best[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(text) != 0))))
    last = np.concatenate((new[1:], [len(start)])) - 1
    begin = ends[text[new]] - sizes[text[new]]
    return text[new], start[new] - begin, start[last] - begin, at[new] - begin, h[at[new]]


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` bytes (Larsson-Sadakane refinement)."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(FIRST, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(FIRST):
        key = (key << np.uint64(8)) | padded[i:n + i]
    low, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
    packed = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
    sa = (packed & low).astype(np.int64)
    value = packed >> bits
    fresh = np.concatenate(([True], value[1:] != value[:-1]))
    rank = np.zeros(n + 1, np.int64)                       # slot of the first of the group, plus 1
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
    alone = fresh & np.concatenate((fresh[1:], [True]))
    slots = np.flatnonzero(~alone)                         # slots of groups that are not single
    h = FIRST
    while h < depth and len(slots):
        at = sa[slots]
        second = rank[np.minimum(at + h, n)]
        packed = np.sort((rank[at].astype(np.uint64) << np.uint64(2 * BITS)) | (second.astype(np.uint64) << bits)
                         | at.astype(np.uint64))
        at = (packed & low).astype(np.int64)
        value = packed >> bits
        sa[slots] = at
        fresh = np.concatenate(([True], value[1:] != value[:-1]))
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        slots = slots[~(fresh & np.concatenate((fresh[1:], [True])))]
        h *= 2
    return sa


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of the suffixes a[i] and b[i], at most ``cap``."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for at in range(0, cap, 8):
        x, y = words[a[live] + at], words[b[live] + at]
        same = x == y
        whole = same.all(axis=1)
        out[live[~whole]] = at + np.argmin(same[~whole], axis=1)
        live = live[whole]
        if not len(live):
            return np.minimum(out, cap)
    out[live] = cap
    return np.minimum(out, cap)


def repeated_positions(data: np.ndarray, sa: np.ndarray, span: int, every: int = 128) -> np.ndarray:
    """Whether the suffix at each position shares ``span`` bytes with a neighbour in ``sa``."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    direct = np.ones(n, bool)
    # the chain goes on where the position before and its predecessor share their first byte
    direct[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (data[:-1] != data[before[:-1]])
    direct[::every] = True
    direct |= before < 0
    at = np.flatnonzero(direct)
    long = np.concatenate((data, np.zeros(span + every + 8, np.uint8)))
    long[n:] = 254
    length = np.zeros(len(at), np.int64)
    has = before[at] >= 0
    length[has] = _common(long, at[has], before[at[has]], span + every)
    source = np.maximum.accumulate(np.where(direct, np.arange(n), 0))
    common = np.zeros(n, np.int64)
    common[at] = length
    common = common[source] - (np.arange(n) - source)      # Kasai: one less per position
    hit = (common >= span) & (before >= 0)
    out = hit.copy()
    out[before[hit]] = True
    return out


class Block:
    """Segments side by side and the order of their starts."""

    def __init__(self, segments: list[bytes], owned: list[int], span: int):
        sizes = np.array([len(s) + 1 for s in segments], np.int64)
        self.first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        self.owned = np.array(owned, np.int64)
        self.data = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
        self.span = span
        sa = suffix_array(self.data, span)
        self.hit = repeated_positions(self.data, sa, span)
        mine = np.zeros(len(self.data), bool)
        for f, k in zip(self.first, self.owned):
            mine[f:f + k] = True
        self.hit &= mine
        self.order = sa[mine[sa]]

    def search(self, other: Block, rows: int = 4096) -> None:
        """Mark the starts of both blocks whose ``span`` bytes the other has, by binary search."""
        mine = other.order
        for at in range(0, len(self.order), rows):
            asked = self.order[at:at + rows]
            want = np.lib.stride_tricks.sliding_window_view(self.data, self.span)[asked]
            lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), len(mine), np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                have = np.lib.stride_tricks.sliding_window_view(other.data, self.span)[mine[np.minimum(mid, len(mine) - 1)]]
                differ = have != want
                first = np.argmax(differ, axis=1)
                rows_at = np.arange(len(asked))
                less = differ.any(axis=1) & (have[rows_at, first] < want[rows_at, first])
                lo = np.where(open_ & less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)
            found = lo < len(mine)
            got = np.lib.stride_tricks.sliding_window_view(other.data, self.span)[mine[np.minimum(lo, len(mine) - 1)]]
            found &= (got == want).all(axis=1)
            self.hit[asked[found]] = True
            other.hit[mine[lo[found]]] = True

    def runs(self, i: int) -> list[tuple[int, int]]:
        """(first, last) repeated starts of segment i, in runs."""
        hit = self.hit[self.first[i]:self.first[i] + self.owned[i]]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist()))


def resolve_segments(span: int, block_bytes: int = BLOCK):
    """Rows (anchor, d1, d2, has, c, lo, owned, seg), sorted, to covered intervals (c, s, e)."""
    def run(batches):
        out: list[tuple[int, int, int]] = []
        block: list[tuple] = []          # entries (c, lo, owned, seg, open) waiting for a suffix array
        held = 0

        def solve(entries):
            """Entries of whole anchors, or of one anchor over several blocks."""
            parts, at, size = [], 0, 0
            for i, e in enumerate(entries):
                if size and size + len(e[3]) + 1 > block_bytes:
                    parts.append((at, i))
                    at, size = i, 0
                size += len(e[3]) + 1
            parts.append((at, len(entries)))
            blocks = [Block([e[3] for e in entries[a:b]], [e[2] for e in entries[a:b]], span) for a, b in parts]
            for i, x in enumerate(blocks):
                for y in blocks[:i]:
                    x.search(y)
            for (a, b), x in zip(parts, blocks):
                for i, (c, lo, _, _, alone) in enumerate(entries[a:b]):
                    if alone:
                        out.extend((c, lo + f, lo + t + span) for f, t in x.runs(i))

        def close(group):
            """An anchor is complete: with one segment nothing is left to compare."""
            nonlocal block, held
            if len(group) < 2:
                return
            size = sum(len(e[3]) + 1 for e in group)
            if size > block_bytes // 2:
                solve(group)
                return
            if held + size > block_bytes:
                solve(block)
                block, held = [], 0
            block.extend(group)
            held += size

        def batch_of():
            c, s, e = zip(*out) if out else ((), (), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())],
                                              names=["c", "s", "e"])

        anchor, digest, group = None, None, []
        for b in batches:
            cols = (b.column(x).to_pylist() for x in ("anchor", "d1", "d2", "c", "lo", "owned", "seg"))
            for k, d1, d2, c, lo, owned, seg in zip(*cols):
                if k != anchor:
                    close(group)
                    anchor, digest, group = k, None, []
                if (d1, d2) != digest:
                    digest = (d1, d2)
                    group.append((c, lo, owned, seg, True))
                else:                    # equal segments: every start of each is a repeat
                    first = group[-1]
                    if first[4]:
                        out.append((first[0], first[1], first[1] + first[2] - 1 + span))
                        group[-1] = (*first[:4], False)
                    out.append((c, lo, lo + owned - 1 + span))
            if len(out) > 50_000:
                yield batch_of()
        close(group)
        if block:
            solve(block)
        yield batch_of()
    return run


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def _first_pass(span: int, window: int):
    def run(batches):
        for b in bounded_texts(batches):
            texts = texts_of(b.column("text"))
            text, _, _, _, h = anchor_runs(texts, span, window)
            ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "th": b.column("th"), "sha": pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "anchors": pa.ListArray.from_arrays(ends, h.view(np.int64))})
    return run


def _segments(span: int, window: int, remember: int = 300_000):
    """The segments of the anchors marked in ``idx``; bytes go out once per task and segment."""
    def run(batches):
        sent: set[bytes] = set()
        for b in bounded_texts(batches):
            texts, cs = texts_of(b.column("text")), b.column("c").to_pylist()
            text, lo, hi, _, h = anchor_runs(texts, span, window)
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            rows: list[tuple] = []
            for i, idx in enumerate(b.column("idx")):
                t = texts[i]
                for j in idx.values.to_numpy() + ends[i]:
                    seg = t[lo[j]:hi[j] + span]
                    d = xxhash.xxh3_128_digest(seg)
                    new = d not in sent
                    if new and len(sent) < remember:
                        sent.add(d)
                    rows.append((int(h[j].astype(np.int64)), int.from_bytes(d[:8], "little", signed=True),
                                 int.from_bytes(d[8:], "little", signed=True), 0 if new else 1, cs[i], int(lo[j]),
                                 int(hi[j] - lo[j] + 1), seg if new else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else
                                             [pa.array([], k) for k in kinds], names=SEGMENT_COLUMNS)
    return run


def _marked_parts(span: int, window: int):
    """The segments (c, first start, bytes) of the anchors marked in ``idx``."""
    def parts(b):
        texts, cs = texts_of(b.column("text")), b.column("c").to_pylist()
        text, los, his, _, _ = anchor_runs(texts, span, window)
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        for j, (t, c, idx) in enumerate(zip(texts, cs, b.column("idx"))):
            at = idx.values.to_numpy() + ends[j]
            for lo, hi in zip(los[at].tolist(), his[at].tolist()):
                yield c, lo, t[lo:hi + span]
    return parts


def _whole_parts(b):
    """The segments (c, first start, bytes) that are rows already."""
    return zip(b.column("c").to_pylist(), b.column("lo").to_pylist(), texts_of(b.column("text")))


def _unmet(span: int, parts, remember: int = 300_000):
    """Cuts ``parts`` into those that a task has not met, and the runs (c, first start, number of
    starts) that are repeats already because it has met their whole segment.  Runs of a class
    whose bytes touch are one: a string that a text repeats again and again makes no row each time."""
    met: dict[bytes, tuple[int, int, int] | None] = {}         # the first of equal segments, until it is a repeat itself

    def of(b):
        fresh, known = [], []
        for c, lo, seg in parts(b):
            run, d = (c, lo, len(seg) - span + 1), xxhash.xxh3_128_digest(seg)
            if d in met:
                known += [x for x in (run, met[d]) if x is not None]
                met[d] = None
            else:
                if len(met) < remember:
                    met[d] = run
                fresh.append((c, lo, seg))
        touching: list[list[int]] = []
        for c, lo, n in sorted(known):
            if touching and touching[-1][0] == c and lo <= touching[-1][2]:
                touching[-1][2] = max(touching[-1][2], lo + n - 1 + span)
            else:
                touching.append([c, lo, lo + n - 1 + span])
        return fresh, [(c, s, e - s - span + 1) for c, s, e in touching]
    return of


def _finer(span: int, window: int, parts, most: int = 10_000):
    """The segments of ``parts`` cut at the anchors of a wider ``window``: rows (anchor, d1, d2, c, lo,
    owned, seg).  Rows without anchor are runs that are repeats already."""
    def run(batches):
        unmet = _unmet(span, parts)
        for b in bounded_texts(batches):
            fresh, known = unmet(b)
            rows: list[tuple] = [(None, None, None, *x, None) for x in known]
            part, los, his, _, h = anchor_runs([x[2] for x in fresh], span, window)
            for p, s, e, key in zip(part.tolist(), los.tolist(), his.tolist(), h.view(np.int64).tolist()):
                c, lo, seg = fresh[p]
                d = xxhash.xxh3_128_digest(seg[s:e + span])
                rows.append((key, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True),
                             c, lo + s, e - s + 1, seg[s:e + span]))
            for at in range(0, len(rows), most):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[at:at + most]), (*[pa.int64()] * 6, pa.binary()))],
                                                 names=["anchor", "d1", "d2", "c", "lo", "owned", "seg"])
    return run


def _crowded_starts(span: int, parts, most: int = 100_000):
    """The starts of the segments of ``parts``: rows (c, lo, i, n, k1, k2) with the hash of the string
    at lo + i, and rows without hash for n starts from lo that are repeats already."""
    def run(batches):
        unmet = _unmet(span, parts)
        for b in bounded_texts(batches):
            fresh, known = unmet(b)
            rows = [(c, lo, 0, n, None, None) for c, lo, n in known]
            for c, lo, seg in fresh:
                for i in range(len(seg) - span + 1):
                    d = xxhash.xxh3_128_digest(seg[i:i + span])
                    rows.append((c, lo, i, 1, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            for at in range(0, len(rows), most):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[at:at + most]), kinds)],
                                                 names=["c", "lo", "i", "n", "k1", "k2"])
    return run


def _start_runs(span: int):
    """Rows (c, lo, at), ``at`` the sorted offsets of repeated starts, to covered intervals."""
    def run(batches):
        for b in small_slices(batches, 10_000):
            out: list[tuple[int, int, int]] = []
            for c, lo, at in zip(b.column("c").to_pylist(), b.column("lo").to_pylist(), b.column("at")):
                i = at.values.to_numpy()
                edge = np.flatnonzero(np.diff(i) != 1)
                out.extend((c, lo + f, lo + t + span) for f, t in zip(i[np.append(0, edge + 1)].tolist(), i[np.append(edge, -1)].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["c", "s", "e"])
    return run


def crowded_covers(texts: DataFrame, span: int, window: int, crowd: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of the anchors marked in ``texts`` (c, idx, text): segments of finer anchors that are not
    crowded, and covered intervals (c, s, e) of the rest."""
    segments, covers, parts, gap = [], [], _marked_parts(span, window), (span - window) // 4
    whole = lambda rows, n: rows.select("c", F.col("lo").alias("s"), (F.col("lo") + F.col(n) - 1 + span).alias("e"))
    while gap >= 8:                 # a wider window: some four or five finer segments of each
        cut = materialize(texts.mapInArrow(_finer(span, span - gap, parts), "anchor long, d1 long, d2 long, c long, lo long, owned long, seg binary"),
                          "finer")
        covers.append(whole(cut.filter("anchor IS NULL"), "owned"))
        counts = materialize(cut.filter("anchor IS NOT NULL").groupBy(F.col("anchor").alias("key")).agg(F.count(F.lit(1)).alias("n"))
                             .filter("n > 1"), "finer-counts")
        rows = join_few(cut, counts, F.col("anchor") == F.col("key"))
        segments.append(rows.filter(F.col("n") <= crowd).withColumn("has", F.lit(0)).select(SEGMENT_COLUMNS))
        if counts.filter(F.col("n") > crowd).isEmpty():
            return segments, covers
        texts, parts, gap = rows.filter(F.col("n") > crowd).select("c", "lo", F.col("seg").alias("text")), _whole_parts, gap // 4
    starts = materialize(texts.mapInArrow(_crowded_starts(span, parts), "c long, lo long, i int, n int, k1 long, k2 long"), "starts")
    hashed = starts.filter("k1 IS NOT NULL").select("c", "lo", "i", "k1", "k2")
    often = materialize(hashed.groupBy(F.col("k1").alias("a1"), F.col("k2").alias("a2")).agg(F.count(F.lit(1)).alias("n"))
                        .filter("n > 1").select("a1", "a2"), "often")
    again = join_few(hashed, often, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")))
    runs = again.groupBy("c", "lo").agg(F.sort_array(F.collect_list("i")).alias("at")).mapInArrow(_start_runs(span), "c long, s long, e long")
    return segments, [*covers, runs, whole(starts.filter("k1 IS NULL"), "n")]


SEGMENT_COLUMNS = ["anchor", "d1", "d2", "has", "c", "lo", "owned", "seg"]
SEGMENTS = "anchor long, d1 long, d2 long, has int, c long, lo long, owned long, seg binary"


def merge_intervals(pairs: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in pairs:
        s, e = p["s"], p["e"]
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _merge(batches):
    for b in batches:
        merged = [merge_intervals(p) for p in b.column("cover").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("c"), *(pa.array([[x[k] for x in m] for m in merged], pa.list_(pa.int64())) for k in (0, 1))], names=["c", "s", "e"])


def _cut(with_text: bool):
    def run(batches):
        for b in bounded_texts(batches):
            texts = texts_of(b.column("text"))
            kept, removed = [], []
            for t, s, e in zip(texts, b.column("s").to_pylist(), b.column("e").to_pylist()):
                edge = [0, *(x for pair in zip(s, e) for x in pair), len(t)]
                kept.append(b"".join(t[edge[i]:edge[i + 1]] for i in range(0, len(edge), 2)))
                removed.append(sum(e) - sum(s))
            cols = {"c": b.column("c"), "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array([len(x) for x in b.column("s").to_pylist()], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])}
            if with_text:
                cols["kept"] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_pydict(cols)
    return run


def suffix_dedup(docs: DataFrame, span: int = 200, window: int = 64, few_intervals: int = 2_000_000,
                 crowd: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``."""
    spark = docs.sparkSession
    if crowd is None:               # runs of an anchor that surely fit one block
        crowd = BLOCK // (2 * span - window + 1)
    staged = materialize(_docs(docs).mapInArrow(
        _first_pass(span, window), "doc_id long, th long, sha binary, n_bytes long, anchors array<long>"), "anchors")
    rep = F.any_value(F.struct("doc_id", "th", "n_bytes", "anchors"))
    grouped = staged.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), rep.alias("r"))
    classes = materialize(grouped.select(
        F.monotonically_increasing_id().alias("c"), "sha", "copies", F.col("r.doc_id").alias("rep_doc"),
        F.col("r.th").alias("rep_th"), F.col("r.n_bytes").alias("n_bytes"), F.col("r.anchors").alias("anchors")), "classes")
    posted = classes.select("c", F.posexplode("anchors").alias("i", "key"))
    # written, so that the join can split a crowded key's postings, or needs no shuffle
    counts = materialize(posted.groupBy(F.col("key").alias("often")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    chosen = lambda which: F.sort_array(F.collect_list(F.when(which, F.col("i"))))
    marked = join_few(posted, counts, F.col("key") == F.col("often")).groupBy("c").agg(
        chosen(F.col("n") <= crowd).alias("idx"), chosen(F.col("n") > crowd).alias("crowded"))
    wanted = materialize(classes.select("c", "rep_doc", "rep_th").join(marked, "c"), "marked")

    def at_text(table):
        """``table`` (c, rep_doc, rep_th, ...) with the text of each class."""
        return join_few(_docs(docs), table, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep_doc")))

    segments = at_text(wanted.filter("size(idx) > 0")).select("c", "idx", "text").mapInArrow(_segments(span, window), SEGMENTS)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crowded = wanted.filter("size(crowded) > 0").select("c", "rep_doc", "rep_th", F.col("crowded").alias("idx"))
    others: list[DataFrame] = []
    if not crowded.isEmpty():
        finer, others = crowded_covers(at_text(crowded).select("c", "idx", "text"), span, window, crowd)
        segments = reduce(DataFrame.unionByName, finer, segments)
    covers = segments.repartition(n, "anchor").sortWithinPartitions("anchor", "d1", "d2", "has") \
        .mapInArrow(resolve_segments(span), "c long, s long, e long")
    covers = reduce(DataFrame.unionByName, others, covers)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= span)
    some = covers.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("cover")) \
        .mapInArrow(_merge, "c long, s array<long>, e array<long>")
    spans = materialize(some.join(classes.filter(~whole).select("c", "rep_doc", "rep_th"), "c"), "spans")
    cut = at_text(spans).select("c", "s", "e", "text") \
        .mapInArrow(_cut(False), "c long, n_removed long, n_spans long, kept_sha256 string")
    cut = materialize(cut.dropDuplicates(["c"]), "cut").toDF("__c", "r", "k", "h")
    empty = hashlib.sha256(b"").hexdigest()
    result = classes.join(cut, F.col("c") == F.col("__c"), "left").select(
        F.col("sha").alias("__sha"), F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("r", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("k", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("h", F.lower(F.hex("sha")))).alias("kept_sha256"))
    return staged.select("doc_id", "sha", "n_bytes").join(result, F.col("sha") == F.col("__sha")) \
        .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
