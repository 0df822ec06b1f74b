"""Operator 7: approximate nearest neighbours by a robust-pruned directed graph per shard.

Equal vectors form one node, so large groups of copies cost nothing; a node keeps the
``k + 1`` smallest ids of its copies, which is all that can reach a top k when ties go to
the smaller id.  Nodes are dealt to shards of about ``shard_rows`` by a hash of the vector.

A shard's graph is built in numpy over the directions of its nodes (multiples of one vector
are one, as float32 has them), block after block of doubling size: greedy (beam)
searches on the graph so far propose neighbours of a block's nodes; robust pruning keeps
the nearest candidate p and drops every candidate c with alpha * d(p, c) <= d(x, c), so the
edges that stay are diverse; reverse edges are added and pruned alike.  Graphs are rows of
a table in the shared folder (an index that can be searched again), one row per shard.

A search sends blocks of queries to every shard; each (shard, block) is a beam search,
and all nodes of its beam are scored anew in double precision on the original vectors.  The best
of all shards are merged by (score, id).

Defined results: vectors that are null, zero, of another dimension than most, or hold a
null or non-finite component take no part, as row or as query.  Repeated rows of one id
and vector count once; a query's own id is no candidate of it.  Fewer than k candidates:
all of them.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adloom.session import materialize

GRAPH = "shard int, dim int, vectors binary, edges binary, degree int, entry int, ids array<array<bigint>>"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")) \
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(fine & F.exists("v", lambda x: x != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two: exact, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _directions(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct unit vector, ascending, and the place there of every row's.

    Multiples of one vector are one node of the graph, since pruning keeps no edge among them."""
    rows = np.ascontiguousarray(unit + np.float32(0))             # no -0.0
    _, first, of = np.unique(rows.view(np.dtype((np.void, rows.strides[0]))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(first)
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return first[by], place[of]


def beam_search(unit: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, steps: int = 400,
                block: int = 512) -> np.ndarray:
    """The ``beam`` nearest nodes met by each query (-1 where fewer), nearest first.

    All queries of a block take a step at once: each opens its nearest closed node."""
    out = np.full((len(queries), beam), -1, np.int64)
    for at in range(0, len(queries), block):
        q = queries[at:at + block]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(unit) + 1), bool)
        seen[:, [entry, len(unit)]] = True
        node = np.full((len(q), beam), len(unit), np.int64)
        near = np.full((len(q), beam), -np.inf, np.float32)
        opened = np.ones((len(q), beam), bool)
        node[:, 0], near[:, 0], opened[:, 0] = entry, q @ unit[entry], False
        live = rows
        for _ in range(steps):
            first = np.argmin(opened[live], axis=1)
            todo = ~opened[live, first]
            live, first = live[todo], first[todo]
            if not len(live):
                break
            opened[live, first] = True
            nxt = edges[node[live, first]]
            nxt = np.where(seen[live[:, None], nxt], len(unit), nxt)
            seen[live[:, None], nxt] = True
            score = np.einsum("qrd,qd->qr", unit[np.minimum(nxt, len(unit) - 1)], q[live])
            score[nxt == len(unit)] = -np.inf
            all_node = np.concatenate((node[live], nxt), axis=1)
            all_near = np.concatenate((near[live], score), axis=1)
            all_open = np.concatenate((opened[live], nxt == len(unit)), axis=1)
            best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            node[live] = np.take_along_axis(all_node, best, 1)
            near[live] = np.take_along_axis(all_near, best, 1)
            opened[live] = np.take_along_axis(all_open, best, 1)
        out[at:at + block] = np.where(node == len(unit), -1, node)
    return out


def robust_prune(unit: np.ndarray, x: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse out-edges of the nodes ``x`` from candidate lists (-1: none); -1 pads the result."""
    n = len(unit)
    out = np.full((len(x), degree), -1, np.int64)
    for at in range(0, len(x), 256):
        xs, c = x[at:at + 256], np.sort(cand[at:at + 256], axis=1)
        bad = (c < 0) | (c == xs[:, None])
        bad[:, 1:] |= c[:, 1:] == c[:, :-1]
        v = unit[np.clip(c, 0, n - 1)]
        d = 2 - 2 * np.einsum("bcd,bd->bc", v, unit[xs])           # squared distances of unit vectors
        d[bad] = np.inf
        between = 2 - 2 * np.einsum("bcd,bed->bce", v, v)
        rows = np.arange(len(xs))
        own = d.copy()
        for k in range(degree):
            p = np.argmin(d, axis=1)
            ok = np.isfinite(d[rows, p])
            if not ok.any():
                break
            out[at:at + 256][ok, k] = c[rows, p][ok]
            covered = alpha * alpha * between[rows, p] <= own
            d[covered] = np.inf
            d[rows, p] = np.inf
    return out


def _add_reverse(unit: np.ndarray, edges: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    """Add an edge back to each node that ``new`` points at; lists that overflow are pruned."""
    width = edges.shape[1]
    src, dst = np.repeat(new, width), edges[new].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    targets, first, counts = np.unique(dst, return_index=True, return_counts=True)
    for lo in range(0, len(targets), 2048):
        t, f, c = targets[lo:lo + 2048], first[lo:lo + 2048], counts[lo:lo + 2048]
        for piece in range(0, int(c.max()), 2 * degree):      # in pieces, so that a hub stays bounded
            spot = np.arange(piece, min(int(c.max()), piece + 2 * degree))
            on = np.flatnonzero(c > piece)
            take = spot[None, :] < c[on, None]
            extra = np.full(take.shape, -1, np.int64)
            extra[take] = src[(f[on, None] + spot[None, :])[take]]
            extra[(extra[:, :, None] == edges[t[on]][:, None, :]).any(axis=2)] = -1
            both = -np.sort(-np.concatenate((edges[t[on]], extra), axis=1), axis=1)   # -1 last
            full = (both >= 0).sum(axis=1) > width
            edges[t[on[~full]]] = both[~full, :width]
            if full.any():
                edges[t[on[full]], :degree] = robust_prune(unit, t[on[full]], both[full], degree, alpha)
                edges[t[on[full]], degree:] = -1


def build_graph(unit: np.ndarray, degree: int, beam: int, alpha: float, seed: int) -> tuple[np.ndarray, int]:
    """Edges (n + 1, width), padded with n, and the entry node (nearest to the mean)."""
    n = len(unit)
    edges = np.full((n + 1, degree + degree // 2), -1, np.int64)
    entry = int(np.argmax(unit @ unit.mean(axis=0)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([entry], order[order != entry]))
    done = min(n, 2 * degree)
    start = order[:done]                                          # the first nodes see each other
    edges[start, :degree] = robust_prune(unit, start, np.tile(start, (done, 1)), degree, 1.0)
    while done < n:
        new = order[done:done + max(128, min(done, n // 8))]
        met = beam_search(unit, np.where(edges < 0, n, edges), entry, unit[new], beam)
        edges[new, :degree] = robust_prune(unit, new, met, degree, alpha)
        _add_reverse(unit, edges, new, degree, alpha)
        done += len(new)
    return np.where(edges < 0, n, edges), entry


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, shard_rows: int = 4096,
                degree: int = 32, beam: int = 80, alpha: float = 1.05, seed: int = 5) -> DataFrame:
    """One row per shard: its distinct vectors, graph, entry and the smallest ids of each vector."""
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col).distinct(), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
    if sizes is None:
        return spark.createDataFrame([], GRAPH)
    dim = int(sizes["d"])
    # the k + 1 smallest ids of equal vectors: Spark cuts the ranks before the shuffle as well
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    some = rows.filter(F.size("v") == dim).withColumn("place", place).filter(F.col("place") <= k + 1)
    nodes = materialize(some.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "nodes")
    shards = max(1, -(-nodes.count() // shard_rows))

    def build(key, table):
        x = np.array(table.column("v").combine_chunks().flatten()).reshape(-1, dim)
        first = np.array([i[0] for i in table.column("ids").to_pylist()])
        by = np.argsort(first, kind="stable")                     # the same graph on every run
        x = x[by]
        unit = _unit(x)
        edges, entry = build_graph(unit[_directions(unit)[0]], degree, beam, alpha, seed)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()),
            "vectors": pa.array([x.tobytes()], pa.binary()), "edges": pa.array([edges.astype("<i4").tobytes()], pa.binary()),
            "degree": pa.array([edges.shape[1]], pa.int32()), "entry": pa.array([entry], pa.int32()),
            "ids": pa.array([[table.column("ids")[int(i)].as_py() for i in by]], pa.list_(pa.list_(pa.int64())))})

    dealt = nodes.select("v", "ids", F.pmod(F.xxhash64("v", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"))
    return materialize(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(build, GRAPH), "graph")


def search_index(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = 192, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of each query (columns id, v), nearest first."""
    shards = [r["shard"] for r in index.select("shard").collect()]    # one number per shard
    n_blocks = max(1, -(-queries.count() // block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    sent = queries.select("id", "v", block.alias("block"), F.explode(F.array(*[F.lit(s) for s in shards])
                                                                     if shards else F.array().cast("array<int>")).alias("shard"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def search(key, graph, asked):
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if graph.num_rows and asked.num_rows:
            g = graph.slice(0, 1).to_pylist()[0]
            x = np.frombuffer(g["vectors"], np.float64).reshape(-1, g["dim"])
            edges = np.frombuffer(g["edges"], "<i4").reshape(-1, g["degree"]).astype(np.int64)
            qid = asked.column("id").to_numpy()
            vs = asked.column("v").to_pylist()
            fit = [i for i, v in enumerate(vs) if len(v) == g["dim"]]
            q = np.array([vs[i] for i in fit]).reshape(-1, g["dim"])
            qid = qid[fit]
            if len(q):
                unit = _unit(x)
                heads, of = _directions(unit)
                met = beam_search(unit[heads], edges, g["entry"], _unit(q), beam)
                rows_of = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
                x, q = _scaled(x), _scaled(q)
                norm, qnorm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
                for i in range(len(q)):
                    nodes = met[i][met[i] >= 0]
                    nodes = nodes if len(heads) == len(x) else np.concatenate([rows_of[n] for n in nodes])
                    score = (x[nodes] * q[i]).sum(axis=1) / (norm[nodes] * qnorm[i])
                    if len(nodes) > k + 1:          # a node has an id besides the query's, but for its own
                        near = score >= np.partition(score, -k - 1)[-k - 1]
                        nodes, score = nodes[near], score[near]
                    rows = [(-s, d) for s, n in zip(score.tolist(), nodes.tolist()) for d in g["ids"][n] if d != qid[i]]
                    for s, d in sorted(rows)[:k]:
                        found["query_id"].append(int(qid[i]))
                        found["vec_id"].append(d)
                        found["score"].append(-s)
        return pa.table({"query_id": pa.array(found["query_id"], pa.int64()), "vec_id": pa.array(found["vec_id"], pa.int64()),
                         "score": pa.array(found["score"], pa.float64())})

    hits = sent.groupBy("shard", "block")
    best = graphs.groupBy("shard", "block").cogroup(hits).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
