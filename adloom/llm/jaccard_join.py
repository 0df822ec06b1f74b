"""Operator 9: n-gram Jaccard self-join with token-combination prefixes, and its classes.

Documents are sets of hashed w-word shingles.  Equal sets become one class first, so
copies cost nothing further.  Let o(x) = ceil(t |x|) and order every set by token hash.
Two linked sets share at least k tokens among the first |x| - o(x) + k of each ("prefix
extended by k"; k grows with |x|, the smaller k of a pair counts); this holds for any order of tokens that is the same for all sets.

* Index 1, single rare tokens.  The extended prefixes in hash order are posted; tokens of
  one class only can't match, tokens of more than ``frequent`` classes are "frequent".  A
  set with few frequent tokens in its prefix (a light one: fewer than k leaves room for)
  shares two rare ones or more with every set it is linked with.
* Index 2, for pairs of heavy sets.  Their tokens are ordered anew, rare ones first,
  frequent ones last, so that shared passages drop out of the prefixes of all sets with
  enough tokens of their own.  Rare tokens are indexed one by one; a pair that shares none
  shares two frequent tokens, so these are indexed as 2-combinations.

Lists are not expanded into all pairs.  In a round, one member of each open list is
compared with the others that are not in its component; then it leaves the list.  A list
whose members lie in one component is closed: a group of n near copies costs about n
comparisons.  Of the lists that stay open after ``star_rounds``, those of at most ``few`` members
give their pairs in different components; the longer ones are put together by their least
component: the members of such a crowd are compared inside tasks, each pair once however
many lists it shares.  A crowd is cut into blocks of about ``block`` members and each pair of
blocks, a tile, is a task's work of bounded size; an inverted index of the tile's tokens gives
the overlaps of a member with all others.  Of the links it finds a tile returns only those that
join components, so fewer than it has members; no pair is a row there.  Tiles get 32 bits of
each token; the links are then verified on the sets, and should one fail, because different
tokens look alike, the tiles are done again with all 64 bits.

Elsewhere a pair is first bounded by 16-bit marks of all its tokens (equal tokens have
equal marks), then verified on the sets.  Sets are recomputed from the texts of the classes
in question.

Components come from the star algorithm on edges in Spark; nothing but frequent tokens
(at most ``max_frequent``, else the limit is raised, which moves work but no result) passes
the driver.

Defined results: null and empty texts and texts without words have an empty set, linked
with nothing.  Repeated rows are copies.  A null doc_id takes part; its component is the
smallest id of the class, null if there is none.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.common import bounded_texts, join_few, mix64, power_tables, small_slices, texts_of
from adloom.session import materialize, materialize_narrow

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes], long_word: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of all texts, and the number of words of each text."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = power_tables(len(data))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[:len(data)], dtype=np.uint64)))
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    for i in np.flatnonzero(ends - starts > long_word):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes())
    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, limits))))
    return h, counts


def shingle_sets(texts: list[bytes], w: int) -> list[np.ndarray]:
    """Sorted distinct w-word shingle hashes (int64) of each text; all words if fewer."""
    h, counts = word_hashes(texts)
    odd = [np.uint64(pow(int(_ODD), 2 * i + 1, 2**64)) for i in range(w)]
    n = max(0, len(h) - w + 1)
    rolled = mix64(reduce(np.add, (h[i:i + n] * odd[i] for i in range(w)))) if n else h[:0]
    out, at = [], 0
    for c in counts:
        if c >= w:
            out.append(np.unique(rolled[at:at + c - w + 1].view(np.int64)))
        elif c:
            few = reduce(np.add, (h[at + i:at + i + 1] * odd[i] for i in range(c))) + np.uint64(c)
            out.append(mix64(few ^ _ODD).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
        at += c
    return out


def extension(n: int) -> int:
    """k: tokens that linked sets share in their extended prefixes (the smaller k counts)."""
    return 2 + n // 16


def prefix_length(n: int, percent: int, k: int) -> int:
    return min(n, n - -(-percent * n // 100) + k)


def _lists(arrays: list[np.ndarray], kind=np.int64) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, kind), *arrays]))


def document_sets(docs: DataFrame, w: int, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n, key (128-bit hash of the set), prefix."""
    def run(batches):
        for b in bounded_texts(batches):
            sets = shingle_sets(texts_of(b.column("text")), w)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "th": b.column("th"), "n": pa.array([len(s) for s in sets], pa.int64()),
                "key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "prefix": _lists([s[:prefix_length(len(s), percent, extension(len(s)))] for s in sets])})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")) \
        .mapInArrow(run, "doc_id long, th long, n long, key binary, prefix array<long>")


def fetch_sets(docs: DataFrame, wanted: DataFrame, w: int, marks: bool = False, short: bool = False, then=None,
               schema: str = "") -> DataFrame:
    """(c, tokens), or (c, n, marks), of the classes in ``wanted`` (c, rep_doc, rep_th), from
    their texts.  ``marks``: 16 bits of each token, 32 for large sets, sorted; ``short``: tokens
    of 32 bits.  ``then``: goes over the batches in the same Python worker and makes rows of ``schema``;
    a second mapInArrow would give every task a second worker, whose memory stays."""
    def run(batches):
        for b in bounded_texts(batches):
            sets = shingle_sets(texts_of(b.column("text")), w)
            if marks:
                columns = {"n": pa.array([len(s) for s in sets], pa.int64()),
                           "marks": pa.array([_marks(s).tobytes() for s in sets], pa.binary())}
            else:
                columns = {"tokens": _lists([x.astype(np.int32) for x in sets], np.int32) if short else _lists(sets)}
            yield pa.RecordBatch.from_pydict({"c": b.column("c"), **columns})
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    found = join_few(texts, wanted, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep_doc")))
    if then:
        return found.select("c", "text").mapInArrow(lambda batches: then(run(batches)), schema)
    return found.select("c", "text").mapInArrow(run, "c long, n long, marks binary" if marks else
                                               f"c long, tokens array<{'int' if short else 'long'}>")


def _marks(tokens: np.ndarray, small: int = 1500) -> np.ndarray:
    wide = tokens.view(np.uint64)
    return np.sort(wide.astype(np.uint16) if len(tokens) <= small else wide.astype(np.uint32))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b): alternating large and small stars.

    Minima are combined before the shuffle and neighbours are never gathered in a row."""
    e = materialize_narrow(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("x")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize_narrow(large.filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "x"), F.col("u") == F.col("x")) \
            .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("u <> v")
        e = materialize_narrow(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _needed(n: int, m: int, percent: int) -> int:
    """Least overlap of linked sets of n and m tokens: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def _overlap_at_most(x: bytes, n: int, y: bytes, m: int) -> int:
    """A bound on the shared tokens from the marks: equal tokens have equal marks."""
    a = np.frombuffer(x, np.uint16 if len(x) == 2 * n else np.uint32)
    b = np.frombuffer(y, np.uint16 if len(y) == 2 * m else np.uint32)
    if a.dtype != b.dtype:
        a, b = np.sort(a.astype(np.uint16)), np.sort(b.astype(np.uint16))
    # tokens of x whose mark occurs in y, and the other way round
    at = b[np.minimum(np.searchsorted(b, a), m - 1)] == a
    back = a[np.minimum(np.searchsorted(a, b), n - 1)] == b
    return int(min(at.sum(), back.sum()))


def _possible(percent: int):
    """Keeps the pairs whose marks allow the overlap."""
    def run(batches):
        for b in small_slices(batches, 1000):
            cols = (b.column(c).to_pylist() for c in ("am", "an", "bm", "bn"))
            keep = [_overlap_at_most(x, n, y, m) >= _needed(n, m, percent) for x, n, y, m in zip(*cols)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _linked(percent: int):
    def run(batches):
        for b in small_slices(batches, 1000):
            p, q = b.column("at"), b.column("bt")
            keep = []
            for i in range(b.num_rows):
                x, y = p[i].values.to_numpy(), q[i].values.to_numpy()
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, w: int, percent: int) -> DataFrame:
    """The linked pairs among the candidate pairs (a, b)."""
    def sides(found, marks):
        nodes = found.select(F.col("a").alias("c")).union(found.select(F.col("b").alias("c"))).distinct()
        wanted = materialize_narrow(classes.select("c", "rep_doc", "rep_th").join(nodes, "c", "left_semi"), "wanted")
        sets = materialize(fetch_sets(docs, wanted, w, marks), "sets")
        both = found
        for x in "ab":
            both = both.join(sets.toDF(x, *[x + c[0] for c in sets.columns[1:]]), x)
        return both

    possible = materialize(sides(pairs, True).select("a", "b", "an", "bn", "am", "bm")
                           .mapInArrow(_possible(percent), "a long, b long"), "possible")
    return sides(possible, False).select("a", "b", "at", "bt").mapInArrow(_linked(percent), "a long, b long")


def tile_links(tokens: list[np.ndarray], roots: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (x, y) of linked sets that join the components ``roots``; with two sides, pairs across.

    Members of the commonest component are not compared with each other: for every other
    member, counting the tokens' lists gives its overlap with all sets at once."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    owner = np.repeat(np.arange(len(tokens)), sizes)
    _, token = np.unique(np.concatenate(tokens), return_inverse=True)
    members = owner[np.argsort(token, kind="stable")]
    ends = np.cumsum(np.bincount(token))
    starts, after = ends - np.diff(np.concatenate(([0], ends))), np.cumsum(sizes)
    names, named, often = np.unique(roots, return_inverse=True, return_counts=True)
    parent = list(range(len(names)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    out = []
    two = bool((side != side[0]).any())
    for x in np.flatnonzero(named != np.argmax(often)).tolist():
        own = token[after[x] - sizes[x]:after[x]]
        low, count = starts[own], ends[own] - starts[own]
        shift = np.cumsum(count) - count
        met = np.bincount(members[np.repeat(low - shift, count) + np.arange(count.sum())], minlength=len(tokens))
        linked = (100 * met >= percent * (sizes + sizes[x] - met)) & (named != named[x])
        if two:
            linked &= side != side[x]
        for y in np.flatnonzero(linked).tolist():
            a, b = find(int(named[x])), find(int(named[y]))
            if a != b:
                parent[a] = b
                out.append((x, y))
    return out


def _tiles(percent: int):
    """Links of the tiles of a partition; its rows are sorted by tile."""
    def run(batches):
        rest: list[pa.RecordBatch] = []

        def links(rows: pa.Table):
            key = np.stack([rows.column(k).to_numpy() for k in ("lo", "i", "j")])
            edges = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [rows.num_rows]))
            c, root, side = (rows.column(k).to_numpy() for k in ("c", "root", "block"))
            lists = rows.column("tokens").combine_chunks()
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            a, b = [], []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if e - s > 1:
                    sets = [flat[offsets[k]:offsets[k + 1]] for k in range(s, e)]
                    for x, y in tile_links(sets, root[s:e], side[s:e], percent):
                        a.append(min(c[s + x], c[s + y]))
                        b.append(max(c[s + x], c[s + y]))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in small_slices(batches, 1000):
            rest.append(batch)
            rows = pa.Table.from_batches(rest)
            key = np.stack([rows.column(k).to_numpy() for k in ("lo", "i", "j")])
            other = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            last = int(other[-1]) + 1 if len(other) else 0   # the last tile may go on
            if last:
                yield links(rows.slice(0, last))
            rest = rows.slice(last).to_batches()
        if rest:
            yield links(pa.Table.from_batches(rest))
    return run


def crowd_links(opened: DataFrame, docs: DataFrame, classes: DataFrame, w: int, percent: int, block: int) -> DataFrame | None:
    """(a, b): links among the members of open lists that join all that are linked; None: there is no list."""
    crowd = materialize_narrow(opened.select("lo", "c", "root").distinct(), "crowd")
    blocks = crowd.groupBy("lo").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    if crowd.isEmpty():
        return None
    wanted = materialize_narrow(classes.select("c", "rep_doc", "rep_th").join(crowd.select("c").distinct(), "c", "left_semi"), "wanted")
    dealt = crowd.join(blocks, "lo").withColumn("block", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))) \
        .select("lo", "c", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = materialize_narrow(dealt, "dealt")

    def linked(short: bool) -> DataFrame:       # sets go to their tiles straight from the texts
        tiles = join_few(fetch_sets(docs, wanted, w, short=short), dealt, "c").repartition("lo", "i", "j")
        return tiles.sortWithinPartitions("lo", "i", "j", "c").mapInArrow(_tiles(percent), "a long, b long").distinct()

    likely = materialize(linked(True), "likely")
    sure = materialize(verify(likely, docs, classes, w, percent), "sure")
    return sure if sure.count() == likely.count() else materialize(linked(False), "sure")


def _reordered(frequent: np.ndarray, percent: int, most: int = 200_000):
    """Index 2 keys of each set: its prefix with frequent tokens last."""
    def keys_of(x: np.ndarray):
        often = np.zeros(len(x), bool)
        if len(frequent):
            often = frequent[np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)] == x
        size = prefix_length(len(x), percent, 2)
        rare = x[~often][:size]
        usual = x[often][:size - len(rare)].view(np.uint64)
        yield mix64(rare.view(np.uint64) ^ _ODD)
        if percent * max(2, len(x)) <= 100:              # so small that one token may be all that is shared
            yield mix64(usual ^ _ODD)
        for i in range(len(usual) - 1):                  # 2-combinations of frequent tokens
            yield mix64(mix64(usual[i:i + 1]) + usual[i + 1:])

    def run(batches):
        keys, owners, held = [], [], 0
        for b in small_slices(batches, 500):
            for c, tokens in zip(b.column("c").to_pylist(), b.column("tokens")):
                for found in keys_of(tokens.values.to_numpy()):
                    keys.append(found.view(np.int64))
                    owners.append(np.full(len(found), c, np.int64))
                    held += len(found)
                    if held >= most:
                        yield pa.RecordBatch.from_arrays([np.concatenate(keys), np.concatenate(owners)], names=["key", "c"])
                        keys, owners, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([np.concatenate(keys), np.concatenate(owners)], names=["key", "c"])
    return run


def _shared_keys(posted: DataFrame) -> DataFrame:
    """The postings (key, c) of keys with two members or more, with the size of the list.

    Counts combine before the shuffle; the join's large lists can be split at run time."""
    counts = posted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    return posted.join(counts, "key")


def candidate_lists(docs: DataFrame, classes: DataFrame, postings: DataFrame, w: int, percent: int, frequent: int,
                    max_frequent: int) -> tuple[DataFrame, DataFrame]:
    """(key, c, turn): members of every list that has two or more, for index 1 and 2, and
    (c, n, f): size and number of frequent prefix tokens of each class.

    A set is heavy if frequent tokens may fill what its prefix has beyond that of a
    partner, which has percent * n / 100 tokens at least.  ``turn`` is 1 for a light set, 2 for a heavy one, and 3 for the members of
    index 2: pairs of index 1 need a member with turn 1."""
    shared = materialize(_shared_keys(postings), "shared")
    often = shared.filter(F.col("df") > frequent).select("key", "df").distinct()
    limit = frequent
    while often.filter(F.col("df") > limit).count() > max_frequent:
        limit *= 2
    tokens = np.sort(np.array([r["key"] for r in often.filter(F.col("df") > limit).select("key").collect()], np.int64))
    first = shared.filter(F.col("df") <= limit).select("key", "c")
    if not len(tokens):
        return first.withColumn("turn", F.lit(1)), classes.select("c", "n", F.lit(0).alias("f"))
    counts = shared.filter(F.col("df") > limit).groupBy("c").agg(F.count(F.lit(1)).alias("f"))
    sizes = materialize_narrow(classes.select("c", "n").join(counts, "c", "left")
                        .select("c", "n", F.coalesce("f", F.lit(0)).cast("int").alias("f")), "sizes")
    heavy = materialize_narrow(sizes.filter(F.col("f") > F.floor(percent * F.col("n") / 1600)).select("c"), "heavy")
    wanted = classes.select("c", "rep_doc", "rep_th").join(heavy, "c", "left_semi")
    second = materialize(fetch_sets(docs, wanted, w, then=_reordered(tokens, percent), schema="key long, c long"), "reordered")
    marked = heavy.select(F.col("c").alias("__c"), F.lit(2).alias("turn"))
    first = first.join(marked, F.col("c") == F.col("__c"), "left").select("key", "c", F.coalesce("turn", F.lit(1)).alias("turn"))
    return first.unionByName(_shared_keys(second).select("key", "c", F.lit(3).alias("turn"))), sizes


def link_classes(docs: DataFrame, classes: DataFrame, postings: DataFrame, w: int, percent: int, frequent: int, max_frequent: int,
                 star_rounds: int, block: int = 1024, few: int = 256) -> DataFrame | None:
    """(c, root) for the classes that are linked with another, None if there is none."""
    lists, sizes = candidate_lists(docs, classes, postings, w, percent, frequent, max_frequent)
    lists = materialize(lists, "lists")
    roots, edges = None, None
    for turn in range(star_rounds + 1):
        labelled = lists.withColumn("root", F.col("c"))
        if roots is not None:
            labelled = lists.join(roots, "c", "left").select("key", "c", "turn", F.coalesce("root", "c").alias("root"))
        # a list is open if it holds two components and, in index 1, a set without frequent tokens
        heads = labelled.groupBy("key").agg(
            F.min(F.struct("turn", "c", "root")).alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi"),
            F.count(F.lit(1)).alias("m")).filter("lo <> hi AND h.turn <> 2").select("key", "h", "lo", "m")
        opened = materialize(labelled.join(heads, "key").select("key", "c", "turn", "root", "h", "lo", "m"), "open")
        if opened.isEmpty():
            break
        tiled = None
        if turn < star_rounds:      # one member against the others
            pairs = opened.filter("c <> h.c AND root <> h.root").select("c", "h.c").toDF("x", "y").distinct()
            lists = opened.filter("c <> h.c").select("key", "c", "turn")
        else:                       # what is still open: long lists in tiles, of short ones the pairs in different components
            tiled = crowd_links(opened.filter(F.col("m") > few), docs, classes, w, percent, block)
            x, y = (opened.filter(F.col("m") <= few).select(F.col("key").alias(s + "k"), F.col("c").alias(s), F.col("root").alias(s + "r"),
                                                            F.col("turn").alias(s + "t")) for s in "xy")
            pairs = x.join(y, (F.col("xk") == F.col("yk")) & (F.col("x") < F.col("y")) & (F.col("xr") != F.col("yr"))
                           & ((F.col("xt") != 2) | (F.col("yt") != 2))) \
                .groupBy("x", "y").agg(F.count(F.lit(1)).alias("met"), F.max("xt").alias("mt"))
        known = pairs.join(sizes.toDF("x", "xn", "xf"), "x").join(sizes.toDF("y", "yn", "yf"), "y") \
            .filter((100 * F.col("xn") >= percent * F.col("yn")) & (100 * F.col("yn") >= percent * F.col("xn")))
        if "met" in pairs.columns:  # linked sets share k prefix tokens, no more frequent ones than either has; or a long list
            overlap = F.ceil(percent * (F.col("xn") + F.col("yn")) / (100 + percent))
            least = F.least(F.lit(2) + F.floor(F.least("xn", "yn") / 16), overlap) - F.least("xf", "yf")
            known = known.filter((F.col("mt") == 3) | (F.col("met") >= least))
        pairs = materialize(known.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
        found = tiled
        if not pairs.isEmpty():
            found = materialize(verify(pairs, docs, classes, w, percent), "links")
            found = found if tiled is None else found.unionByName(tiled)
        if found is None:
            continue
        if not found.isEmpty():
            edges = found if edges is None else edges.unionByName(found)
            roots = materialize_narrow(components(edges).select(F.col("node").alias("c"), "root"), "roots")
    return roots


def jaccard_classes(docs: DataFrame, w: int = 5, percent: int = 75, frequent: int = 64,
                    max_frequent: int = 500_000, star_rounds: int = 1, block: int = 1024, few: int = 256) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``."""
    return jaccard_rows(docs, w, percent, frequent, max_frequent, star_rounds, block, few).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, w: int = 5, percent: int = 75, frequent: int = 64,
                 max_frequent: int = 500_000, star_rounds: int = 1, block: int = 1024, few: int = 256) -> DataFrame:
    """The same with ``th``, the xxhash64 of the row's text, and ``component``, which tells
    components apart where ids are repeated or null (null for empty sets)."""
    staged = materialize(document_sets(docs, w, percent), "sets-by-doc")
    # the smallest (id, text hash) of a class names its representative: narrow, so that a
    # group of copies combines before the shuffle and no prefix travels
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    grouped = staged.filter("n > 0").groupBy("key").agg(rep.alias("r"), F.max("n").alias("n"))
    classes = materialize(grouped.select(
        F.monotonically_increasing_id().alias("c"), "key", F.col("r.doc_id").alias("low"), F.col("r.doc_id").alias("rep_doc"),
        F.col("r.th").alias("rep_th"), "n"), "classes")
    named = classes.select(F.col("key").alias("__key"), "c", "rep_doc", "rep_th")
    chosen = join_few(staged.select("key", "doc_id", "th", "prefix"), named, (F.col("key") == F.col("__key"))
                      & F.col("doc_id").eqNullSafe(F.col("rep_doc")) & (F.col("th") == F.col("rep_th")))
    postings = chosen.select(F.explode("prefix").alias("key"), "c")
    roots = link_classes(docs, classes, postings, w, percent, frequent, max_frequent, star_rounds, block, few)
    named = classes.select("key", F.col("c").alias("component"), F.col("low").alias("component_id"))
    if roots is not None:
        lows = classes.select("c", "low").join(roots, "c").groupBy("root").agg(F.min("low").alias("least"))
        by_class = roots.join(lows, "root").select(F.col("c").alias("__c"), "root", "least")
        named = classes.select("key", "c", "low").join(by_class, F.col("c") == F.col("__c"), "left") \
            .select("key", F.coalesce("root", "c").alias("component"), F.coalesce("least", "low").alias("component_id"))
    named = named.select(F.col("key").alias("__key"), "component", "component_id")
    return staged.select("doc_id", "th", "n", "key").join(named, F.col("key") == F.col("__key"), "left").select(
        "doc_id", "th", "component", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
