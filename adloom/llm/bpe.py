"""Operator 6: byte-level BPE encoding and decoding with a segment tree per word.

A text is cut by the tokenizer's pattern; each match is merged on its own.  The leaves of
a segment tree are the byte positions of the match, each holding the rank of the pair
that starts there (and its position, so that the minimum is the leftmost of the lowest
rank).  The root names the next merge; a merge changes the live neighbours' pairs, three
point updates of log n steps each.  New words of up to 64 bytes are merged many at a time,
one tree per row of an array; longer ones one by one.

Most words repeat, so ids are remembered per word, in a memory of two generations whose
size is bounded.

Defined results: null and empty texts have no ids; a text of any length is encoded whole;
rows are independent, so repeated rows and empty tables need no care.  Carried columns keep
their names; one that clashes with an output column raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.llm.common import WORD_PATTERN, PieceMemory, bounded_texts, latin_words

NO_PAIR = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))        # end of the part that starts at i
    before = list(range(-1, n - 1))    # start of the part before the part at i
    leaves = 1 << (n - 1).bit_length()
    get = ranks.get
    tree = [NO_PAIR] * (2 * leaves)
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            tree[leaves + i] = r * n + i
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    root = tree[1]
    while root < NO_PAIR:
        i = root % n
        j = end[i]                     # the part at j joins the part at i
        end[i] = k = end[j]
        h = before[i]
        changed = [(j, NO_PAIR)]
        if k < n:
            before[k] = i
            r = get(piece[i:end[k]]) if end[k] - i <= longest else None
            changed.append((i, NO_PAIR if r is None else r * n + i))
        else:
            changed.append((i, NO_PAIR))
        if h >= 0:
            r = get(piece[h:k]) if k - h <= longest else None
            changed.append((h, NO_PAIR if r is None else r * n + h))
        for at, value in changed:      # point updates
            at += leaves
            if tree[at] != value:
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    if other < value:
                        value = other
                    at >>= 1
                    if tree[at] == value:
                        break
                    tree[at] = value
        root = tree[1]
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class PairTable:
    """Rank of the token that two neighbouring tokens make, for arrays of token ids."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank or NO_PAIR; a negative token stands for none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], NO_PAIR)


def merge_many(words: list[bytes], leaves: int, byte_ids: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many matches of at most ``leaves`` bytes (a power of two): one tree per row,
    and every round makes the next merge of each word that still has one.

    Returns the ids of all words after each other and the number of ids of each."""
    n, bits = len(words), leaves.bit_length() - 1
    sizes = np.fromiter(map(len, words), np.int64, n)
    inside = np.arange(leaves)[None, :] < sizes[:, None]
    token = np.full((n, leaves + 1), -1, np.int64)             # -1: no part starts here
    token[:, :leaves][inside] = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    after = np.minimum(np.arange(1, leaves + 2)[None, :], sizes[:, None])
    before = np.broadcast_to(np.arange(-1, leaves), (n, leaves + 1)).copy()
    tree = np.full((n, 2 * leaves), NO_PAIR, np.int64)
    found = table.ranks_of(token[:, :leaves], token[:, 1:])
    tree[:, leaves:] = np.where(found < NO_PAIR, (found << bits) | np.arange(leaves), NO_PAIR)
    level = leaves
    while level > 1:
        tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level //= 2
    flat, token_flat, after_flat, before_flat = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
    rows = np.flatnonzero(tree[:, 1] < NO_PAIR)
    while len(rows):
        root = flat[rows * 2 * leaves + 1]
        i, made = root & (leaves - 1), root >> bits
        at = rows * (leaves + 1)
        j = after_flat[at + i]                                 # the part at j joins the part at i
        k = after_flat[at + j]
        h = before_flat[at + i]
        token_flat[at + i] = made
        token_flat[at + j] = -1
        after_flat[at + i] = k
        before_flat[at + k] = i                                # k is at most the spare place
        follower = np.where(k < sizes[rows], token_flat[at + k], -1)
        leader = np.where(h >= 0, token_flat[at + h], -1)
        right, left = table.ranks_of(made, follower), table.ranks_of(leader, made)
        base = rows * 2 * leaves + leaves
        flat[base + j] = NO_PAIR
        flat[base + i] = np.where(right < NO_PAIR, (right << bits) | i, NO_PAIR)
        has = h >= 0
        flat[(base + h)[has]] = np.where(left < NO_PAIR, (left << bits) | h, NO_PAIR)[has]
        root_at = rows * 2 * leaves
        nodes = [leaves + j, leaves + i, leaves + np.where(has, h, i)]
        for _ in range(bits):                                  # point updates, a level at a time
            nodes = [x >> 1 for x in nodes]
            for x in nodes:
                flat[root_at + x] = np.minimum(flat[root_at + 2 * x], flat[root_at + 2 * x + 1])
        rows = rows[flat[root_at + 1] < NO_PAIR]
    live = token[:, :leaves] >= 0
    return token[:, :leaves][live], live.sum(axis=1)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, remembered: int = 600_000):
        self.ranks = load_ranks(path)
        self.vocab = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks), default=0)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.table = PairTable(self.ranks)
        self.pattern = regex.compile(pattern)
        self.latin = pattern == WORD_PATTERN
        self.memory = PieceMemory(remembered)

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of unknown words: short ones together, a power of two of bytes at a time."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        data = [w.encode() for w in words]
        for i, d in enumerate(data):
            whole = self.ranks.get(d)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(d) > 64:
                out[i] = array("I", merge_bytes(d, self.ranks, self.longest)).tobytes()
            else:
                by_size.setdefault(max(3, (len(d) - 1).bit_length()), []).append(i)
        for bits, of in by_size.items():
            for at in range(0, len(of), 4096):
                part = of[at:at + 4096]
                ids, counts = merge_many([data[i] for i in part], 1 << bits, self.byte_ids, self.table)
                packed, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
                for i, end, k in zip(part, ends.tolist(), counts.tolist()):
                    out[i] = packed[end - 4 * k:end]
        return out

    def _cut(self, text: str) -> list[str]:
        words = latin_words(text) if self.latin else None
        return self.pattern.findall(text) if words is None else words

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        ids = self.memory.resolve(set().union(*cut), self._merge)
        return [b"".join(map(ids.__getitem__, words)) for words in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=4)
def shared_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder per Python worker and rank file."""
    return ByteBpe(path, pattern)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ("doc_id",),
                   with_ids: bool = False) -> DataFrame:
    """The ``carry`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids."""
    clash = sorted({"n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])} & set(carry))
    if clash:
        raise ValueError(f"carried columns {clash} clash with columns of the result")
    fields = [docs.schema[c] for c in carry]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
                           *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches):
        bpe = shared_bpe(path, pattern)
        for b in bounded_texts(batches, 4 << 20, "__text"):
            ids = bpe.encode_batch([t or "" for t in b.column(len(carry)).to_pylist()])
            columns = [b.column(i) for i in range(len(carry))]
            columns += [pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string())]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)
