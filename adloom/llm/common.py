"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import adloom
from adloom.operators.ordered import running_total  # noqa: F401  (shared by operators here)

#: Word separators of every word-based operator: space and the six ASCII controls 9 to 13.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Arrow batches as Spark would cut them, and as the operators here ask for them: a batch is held
#: by the JVM and by Python, several times over, and texts are long.
BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),
           ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"))


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python this package, once per session, however Spark was started, and
    ask for small Arrow batches unless the session's owner has chosen a size."""
    sc = spark.sparkContext
    for name, usual, ours in BATCHES:
        if spark.conf.get(name) == usual:
            spark.conf.set(name, ours)
    if getattr(sc, "_adloom_shipped", None) is None:
        root = Path(adloom.__file__).parent
        path = Path(tempfile.mkdtemp(prefix="adloom-")) / "adloom.zip"   # the driver's own; Spark hands it out
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._adloom_shipped = str(path)
    return spark


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-separator characters (null or empty text: no word)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_CLASS + "+", -1))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    Lambda bodies re-evaluate captured expressions for every element; binding an
    array as a lambda variable keeps such expressions linear."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_few(big: DataFrame, few: DataFrame, on, how: str = "inner", most: int = 500_000) -> DataFrame:
    """Join with a table that is usually small: broadcast if it has at most ``most`` (narrow)
    rows, which is counted, else a shuffle join."""
    return big.join(F.broadcast(few) if few.count() <= most else few, on, how)


def small_slices(batches, rows: int = 500):
    """Cut Arrow batches into slices of at most ``rows`` rows, to bound a worker's memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null: empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


#: Fixed value: how byte-level pre-tokenizers cut a text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of Latin script, where the standard library's classes name the same
#: characters (but for a few controls, superscripts and fractions): three times as fast.
_LATIN_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


def latin_words(text: str) -> list[str] | None:
    """The words of ``WORD_PATTERN``, or None for a text with other characters than Latin ones."""
    return None if _NOT_LATIN.search(text) else _LATIN_WORDS.findall(text)


class PieceMemory:
    """Values of words of text, remembered in two generations of at most ``limit`` / 2.

    A full young generation becomes the old one, and what is used again moves over; long
    pieces are not kept.  Pieces are asked for in sets, so that a batch costs few calls."""

    def __init__(self, limit: int, longest: int = 64):
        self.half, self.longest, self.young, self.old = max(1, limit // 2), longest, {}, {}

    def resolve(self, pieces: set[str], make_many) -> dict:
        """piece -> value for all ``pieces``; ``make_many`` gets the unknown ones as a list."""
        young, old, out, unknown = self.young, self.old, {}, []
        for p in pieces:
            value = young.get(p)
            if value is None:
                value = old.get(p)
                if value is None:
                    unknown.append(p)
                    continue
                young[p] = value
            out[p] = value
        for p, value in zip(unknown, make_many(unknown)):
            out[p] = value
            if len(p) <= self.longest:
                young[p] = value
        if len(young) > self.half:
            self.old, self.young = young, {}
        return out


#: An odd base of polynomial hashes modulo 2^64, and its inverse.
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0..B^n and its inverses modulo 2^64, kept for the next call."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            p = np.empty(size, np.uint64)
            p[0], p[1:] = 1, np.uint64(base)
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def bounded_texts(batches, limit: int = 1 << 20, name: str = "text"):
    """Batches cut so that a slice holds about ``limit`` bytes of text, one text at least."""
    for b in small_slices(batches, 2000):
        sizes = [0 if t is None else len(t) for t in b.column(name).cast(pa.binary()).to_pylist()]
        at, held = 0, 0
        for i, s in enumerate(sizes):
            if held and held + s > limit:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += s
        if at < len(sizes):
            yield b.slice(at)
