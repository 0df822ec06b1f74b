"""Operator 3: URL rules looked up in a sorted digest array.

Rules (host, path) are stored as three flat files: sorted 64-bit xxhash keys of
``host + path``, offsets, and the full rule strings.  ``SparkContext.addFile`` gives each
executor one copy; its workers memory-map it, so memory is shared and paged in as needed.
Every URL yields its candidate keys (each host suffix at a label border, each stored path
length); a batch's candidates are hashed and probed with one vectorised binary search,
and every hit is confirmed against the stored string, collisions included.

Rule lists are configuration, but may be long: the index is cut into files of at most
``rules_per_file`` rules, and a batch is probed against one file after the other.

Defined results: a null URL or one without ``://`` has empty host and path and fits no
rule.  Where several rules fit, the longest (characters of host and path) wins, then the
longer host.  No rule: verdict ``allow``, rule null.  A rule given twice keeps its last
verdict.  Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.llm.common import small_slices

Rule = tuple[str, str, str]   # verdict, host, path


def write_index(rules: Iterable[Rule], folder: str, rules_per_file: int = 1_000_000) -> list[str]:
    """Write ``name.keys`` / ``.offsets`` / ``.rules`` files; return their names."""
    last = {(h, p): v for v, h, p in rules}
    rows = [(xxhash.xxh64_intdigest((h + p).encode()), h, p, v) for (h, p), v in last.items()]
    names = []
    for at in range(0, len(rows), rules_per_file):
        part = sorted(rows[at:at + rules_per_file])
        name = f"urlrules-{uuid.uuid4().hex[:12]}"
        stored = ["\t".join((v, str(len(h)), h + p)).encode() for _, h, p, v in part]
        np.array([r[0] for r in part], dtype="<u8").tofile(os.path.join(folder, name + ".keys"))
        np.cumsum([0, *map(len, stored)], dtype="<i8").tofile(os.path.join(folder, name + ".offsets"))
        with open(os.path.join(folder, name + ".rules"), "wb") as f:
            f.write(b"".join(stored))
        names.append(name)
    return names


class DigestIndex:
    """One memory-mapped file triple."""

    def __init__(self, base: str):
        self.keys = np.memmap(base + ".keys", dtype="<u8", mode="r")
        self.offsets = np.memmap(base + ".offsets", dtype="<i8", mode="r")
        self.rules = np.memmap(base + ".rules", dtype="u1", mode="r")

    def entry(self, i: int) -> tuple[str, int, str]:
        verdict, host_len, full = bytes(self.rules[self.offsets[i]:self.offsets[i + 1]]).decode().split("\t", 2)
        return verdict, int(host_len), full

    def probe(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last index entry of each digest."""
        return np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")


@lru_cache(maxsize=64)
def open_index(base: str) -> DigestIndex:
    return DigestIndex(base)


def host_suffixes(host: str) -> list[str]:
    out, at = [host], host.find(".")
    while at >= 0:
        out.append(host[at + 1:])
        at = host.find(".", at + 1)
    return out


def best_rules(hosts: list[str], paths: list[str], indexes: list[DigestIndex], path_lengths: list[int]):
    """(rule, verdict) of the winning rule of each (host, path), or (None, None)."""
    cand, owner, host_len = [], [], []
    for k, (host, path) in enumerate(zip(hosts, paths)):
        if host:
            prefixes = [path[:n] for n in path_lengths if n <= len(path)]
            for suffix in host_suffixes(host):
                for prefix in prefixes:
                    cand.append(suffix + prefix)
                    owner.append(k)
                    host_len.append(len(suffix))
    best = [(0, 0, None, None)] * len(hosts)
    if cand:
        digests = np.array([xxhash.xxh64_intdigest(c.encode()) for c in cand], dtype="<u8")
        for index in indexes:
            lo, hi = index.probe(digests)
            for j in np.flatnonzero(hi > lo):
                for e in range(lo[j], hi[j]):
                    verdict, stored_host, full = index.entry(e)
                    if full == cand[j] and stored_host == host_len[j]:
                        best[owner[j]] = max(best[owner[j]], (len(full), stored_host, full, verdict),
                                             key=lambda x: x[:2])
    return [b[2] for b in best], [b[3] for b in best]


def url_filter(pages: DataFrame, rules: Iterable[Rule], rules_per_file: int = 1_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of ``pages``."""
    rules = list(rules)
    spark = pages.sparkSession
    folder = tempfile.mkdtemp(prefix="adloom-urls-")   # the driver's own; addFile hands copies out
    names = write_index(rules, folder, rules_per_file)
    for name in names:
        for kind in (".keys", ".offsets", ".rules"):
            spark.sparkContext.addFile(os.path.join(folder, name + kind))
    lengths = sorted({len(p) for _, _, p in rules})

    def judge(batches):
        indexes = [open_index(SparkFiles.get(n + ".keys")[:-5]) for n in names]
        for batch in small_slices(batches, 5000):
            host, path = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, verdict = best_rules(host, path, indexes, lengths)
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "host": batch.column("host"), "path": batch.column("path"),
                "rule": pa.array(rule, pa.string()),
                "verdict": pa.array([v or "allow" for v in verdict], pa.string())})

    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")) \
            .otherwise(F.lit(""))
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = pages.select("page_id", rest.alias("__r")).select(
        "page_id",
        F.translate(F.regexp_extract("__r", r"(?s)^([^/?#]*)", 1), up, low).alias("host"),
        F.regexp_extract("__r", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"))
    schema = T.StructType([pages.schema["page_id"], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])
    return parts.mapInArrow(judge, schema)
