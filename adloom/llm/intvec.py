"""Integer vectors for the operators that work on them (11 and 12)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components stay below this, so that squared distances fit 64 bits.
LIMIT = 1 << 24
SCALE = 256


def integer_vectors(vectors: DataFrame, vec_col: str, keep: dict[str, Column]) -> DataFrame:
    """The columns ``keep`` and x, floor(256 * component) in double arithmetic.

    Rows whose vector is null or holds null or non-finite components are dropped; a finite
    component of 65,536 or more in size raises, since its distances would not fit 64 bits."""
    v = F.col(vec_col).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    near = lambda c: F.abs(c) < F.lit(LIMIT / SCALE)
    too_far = F.raise_error(F.lit(f"vector component of {LIMIT // SCALE} or more in size")).cast("int")
    # conditions may be evaluated in any order, so only finite components raise
    whole = F.transform(v, lambda c: F.when(near(c), F.floor(c * SCALE).cast("int")).when(finite(c), too_far))
    return vectors.filter(F.forall(v, finite)).select(*[c.alias(n) for n, c in keep.items()], whole.alias("x"))


def matrix(column: pa.Array, dim: int, kind=np.int64) -> np.ndarray:
    """A list column (no nulls) of ``dim`` components a row as an array."""
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(-1, dim)


def slices(batches, rows: int = 4096):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sum_rows(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Partial sums of groups as rows (grp, at, total, n); groups without members give none.

    ``sums``: groups x components; ``counts``: members of each group."""
    grp = np.flatnonzero(counts)
    dim = sums.shape[1]
    return pa.RecordBatch.from_arrays([
        pa.array(np.repeat(grp, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(grp)), pa.int32()),
        pa.array(sums[grp].ravel(), pa.int64()), pa.array(np.repeat(counts[grp], dim), pa.int64())], names=["grp", "at", "total", "n"])


SUM_ROWS = "grp int, at int, total long, n long"


def floor_means(partial: DataFrame, now: np.ndarray) -> np.ndarray:
    """Groups' componentwise floor(sum / count), exactly; a group without members keeps its row of ``now``.

    What comes to the driver is one row per group and component."""
    out = now.copy()
    for r in partial.groupBy("grp", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["grp"], r["at"]] = r["total"] // r["n"]
    return out
