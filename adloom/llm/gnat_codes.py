"""Operator 11: vector codes from per-part codebooks, searched by a GNAT over the entries.

A vector is cut into equal consecutive parts; a part's code is the index of the nearest
entry of that part position's codebook.  Each codebook is a geometric near-neighbour
access tree: a node has split points (entries far from each other), every other entry
belongs to the child of its nearest split point, and for each pair of split points the
node stores the range of distances from the one to the entries of the other's child.  A
query that lies at distance d from split point p with best distance r so far can't find an
entry as near in a child whose range from p ends below d - r or begins above d + r.

Elimination is strict: an entry at distance exactly r stays a candidate, so ties go to the
lower index.  Ranges and query distances are square roots rounded outwards, so rounding
never removes a candidate; what is compared in the end are integer squared distances.

Codebooks are refined in Spark: every task assigns its vectors and sums them up by (part,
entry), the sums are added by a shuffle, and parts x entries x components numbers reach
the driver whatever the table's size.  Vectors stay in one table in the shared folder.

Defined results: a null vector, or one with null or non-finite components, gives no row.  Codes
need one length that can be cut evenly: vectors of another length than the most frequent
one that can (ties: the smaller) give none either.  Repeated rows are rows of their own;
null ids come last when entries are chosen, equal ids by their vectors.  Fewer vectors
than entries: fewer entries.  Equal distances: lower index.  An empty table gives an empty
result.  Other columns of the table are neither read nor returned, so no name can clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.intvec import SUM_ROWS, floor_means, integer_vectors, matrix, slices, sum_rows
from adloom.session import materialize

#: More than the relative error of a square root and of the sums beside it.
ROUNDING = 1e-12


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer squared distances of the rows of ``a`` to the rows of ``b``."""
    gap = a[:, None, :] - b[None, :, :]
    return np.einsum("qed,qed->qe", gap, gap)


@dataclass
class Node:
    splits: np.ndarray                    # entry indices, ascending
    children: list                        # a Node or None for each split point
    low: np.ndarray                       # [p, c]: least distance from split point p to an entry of child c
    high: np.ndarray                      # [p, c]: greatest


class Gnat:
    """Nearest entries of one codebook (rows of integers)."""

    def __init__(self, entries: np.ndarray, degree: int = 8):
        self.entries, self.degree = entries, degree
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray) -> Node:
        if len(members) <= self.degree:
            none = np.zeros((len(members), len(members)))
            return Node(members, [None] * len(members), none, none)
        x = self.entries[members]
        chosen, far = [0], squared(x, x[:1])[:, 0]
        while len(chosen) < self.degree:                     # each the farthest from those chosen before
            far[chosen] = -1
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, squared(x, x[chosen[-1:]])[:, 0])
        splits = np.sort(np.array(chosen))
        rest = np.setdiff1d(np.arange(len(members)), splits)
        d = squared(x[rest], x[splits])
        of = np.argmin(d, axis=1)
        root = np.sqrt(d.astype(np.float64))
        k = len(splits)
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        children = []
        for c in range(k):
            inside = of == c
            if inside.any():
                low[:, c], high[:, c] = root[inside].min(axis=0), root[inside].max(axis=0)
            children.append(self._node(members[rest[inside]]) if inside.any() else None)
        return Node(members[splits], children, low * (1 - ROUNDING), high * (1 + ROUNDING))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row (ties: lower index) and the squared distance."""
        index = np.full(len(queries), len(self.entries), np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        if len(queries):
            self._visit(self.root, np.arange(len(queries)), queries, index, best)
        return index, best

    def _visit(self, node: Node, rows: np.ndarray, queries, index, best) -> None:
        d = squared(queries[rows], self.entries[node.splits])
        first = np.argmin(d, axis=1)                         # split points ascend: the lowest index of equals
        found, entry = d[np.arange(len(rows)), first], node.splits[first]
        better = (found < best[rows]) | ((found == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], entry[better]
        live = [c for c, child in enumerate(node.children) if child is not None]
        if not live:
            return
        root = np.sqrt(d.astype(np.float64))
        at_least, at_most = root * (1 - ROUNDING), root * (1 + ROUNDING)

        def alive(c: int, some: np.ndarray) -> np.ndarray:
            r = np.sqrt(best[rows[some]].astype(np.float64))[:, None] * (1 + ROUNDING)
            gone = (at_least[some] - r > node.high[None, :, c]) | (at_most[some] + r < node.low[None, :, c])
            return some[~gone.any(axis=1)]

        for own in (True, False):                            # a query's nearest child first: a small r for the others
            for c in live:
                some = alive(c, np.flatnonzero((first == c) == own))
                if len(some):
                    self._visit(node.children[c], rows[some], queries, index, best)


class Codebooks:
    """One tree per part position; ``entries``: parts x entries x components."""

    def __init__(self, entries: np.ndarray, degree: int = 8):
        self.entries = entries
        self.trees = [Gnat(e, degree) for e in entries]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and squared distances of vectors."""
        parts, _, width = self.entries.shape
        both = [tree.nearest(np.ascontiguousarray(x[:, p * width:(p + 1) * width])) for p, tree in enumerate(self.trees)]
        return np.stack([i for i, _ in both], axis=1), np.stack([d for _, d in both], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def refine(kept: DataFrame, entries: np.ndarray, degree: int) -> np.ndarray:
    """One round: assign every part, then replace each used entry by its parts' floored mean."""
    parts, n, width = entries.shape

    def run(batches):
        books = Codebooks(entries, degree)
        sums, counts = np.zeros((parts * n, width), np.int64), np.zeros(parts * n, np.int64)
        for b in slices(batches):
            x = matrix(b.column(0), parts * width)
            codes, _ = books.encode(x)
            slot = (codes + np.arange(parts) * n).ravel()
            by = np.argsort(slot, kind="stable")
            used, at = np.unique(slot[by], return_index=True)
            sums[used] += np.add.reduceat(x.reshape(-1, width)[by], at, axis=0)
            counts += np.bincount(slot, minlength=parts * n)
        yield sum_rows(sums, counts)

    return floor_means(kept.select("x").mapInArrow(run, SUM_ROWS), entries.reshape(parts * n, width)).reshape(entries.shape)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 parts: int = 16, n_entries: int = 64, rounds: int = 2, degree: int = 8) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part.

    At most 256 entries a codebook, so that an index is two hexadecimal digits."""
    if not 1 <= n_entries <= 256:
        raise ValueError(f"{n_entries} entries: an index of two hexadecimal digits allows 1 to 256")
    spark = vectors.sparkSession
    types = vectors.schema
    out = f"vec_id {types[id_col].dataType.simpleString()}, label {types[label_col].dataType.simpleString()}, code string, error long"
    whole = integer_vectors(vectors, vec_col, {"vec_id": F.col(id_col), "label": F.col(label_col)})
    kept = materialize(whole.filter((F.size("x") > 0) & (F.size("x") % parts == 0)), "int-vectors")
    lengths = kept.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
    if lengths is None:
        empty = spark.createDataFrame([], out)
        return empty.select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"),
                            F.lit(None).cast("string").alias("codebooks_sha256"))
    dim = int(lengths["d"])
    kept = kept.filter(F.size("x") == dim)
    # the first entries: n_entries rows, a number the caller gives
    first = kept.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(n_entries).collect()
    entries = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        entries = refine(kept, entries, degree)

    def run(batches):
        books = Codebooks(entries, degree)
        for b in slices(batches):
            codes, far = books.encode(matrix(b.column(2), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string()),
                                              pa.array(far.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = materialize(kept.select("vec_id", "label", "x").mapInArrow(run, out), "codes")
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(Codebooks(entries, degree).sha256()).alias("codebooks_sha256"))
