"""Operator 4: token ids in a compressed binary store with access to single documents.

Layout (a folder of Parquet files, so that any store Spark writes to will do and lost
tasks leave nothing behind):

  dictionary/   one row: sha256 and bytes of the shared zstandard dictionary
  blocks/       ascending by document id; a row is one block of about ``block_bytes``:
                part, seq    place of the block in the order of all documents
                doc_ids      ids of its documents
                offsets      n + 1 byte offsets into ``frames``: document i is
                             frames[offsets[i]:offsets[i + 1]], one zstandard frame
                n_tokens     ids of each document
                width        bytes of a serialized id (2, or 4 where ids need it)
                dict_sha256  the dictionary its frames need
                frames       the frames, one after the other
  starts/       part, seq, start: ids of all blocks before it

Each document is compressed apart with the shared dictionary, which makes short documents
small and readable alone (``read_documents``).  The dictionary is trained on the id
arrays of at most ``sample_docs`` documents, chosen by a hash of their id; it changes
sizes, never contents.

Documents are encoded and compressed in place; only the frames are range-partitioned by
document id.  Blocks are cut by one pass over each sorted partition, so memory holds one
block.  Global offsets come from block totals (common.running_total).

Defined results: a null or empty text is the end id alone; a null document id sorts
first; repeated ids stay apart, in the order of their frames; an empty table gives an
empty store.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adloom.llm.common import PieceMemory, bounded_texts, latin_words, running_total, small_slices
from adloom.session import checkpoint_dir, materialize

BLOCKS = ("part int, seq int, doc_ids array<bigint>, offsets array<bigint>, n_tokens array<bigint>, "
          "width int, dict_sha256 string, frames binary")


class LibraryEncoder:
    """The tokenizers library behind a memory of words.

    A text of Latin script is cut into the tokenizer's words, and unknown words are encoded
    many at a time with line breaks between: a line break is a token of its own there, so
    the ids between two of them are a word's.  Other texts, and those that hold an added
    token of the tokenizer (which the library turns into its one id), go to the library as
    they are."""

    def __init__(self, path: str, remembered: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark runs one task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memory = PieceMemory(remembered)
        self.mark = np.frombuffer(self._encode(["\n"])[0], "<u4")

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _words(self, words: list[str], together: int = 40) -> list[bytes]:
        """Ids of unknown words: those without white space inside in groups, others alone."""
        known: dict[str, bytes] = {}
        plain = [w for w in words if w.strip(" ") and not w[-1].isspace() and "\n" not in w] if len(self.mark) == 1 and not any("\n" in a for a in self.added) else []
        for at in range(0, len(plain), 50 * together):
            groups = [plain[k:k + together] for k in range(at, min(at + 50 * together, len(plain)), together)]
            for group, ids in zip(groups, self._encode(["\n".join(g) for g in groups])):
                row = np.frombuffer(ids, "<u4")
                edges = [-1, *np.flatnonzero(row == self.mark[0]).tolist(), len(row)]
                if len(edges) == len(group) + 1:
                    known.update((w, ids[4 * lo + 4:4 * hi]) for w, lo, hi in zip(group, edges, edges[1:]))
        alone = [w for w in words if w not in known]
        known.update(zip(alone, self._encode(alone)))
        return [known[w] for w in words]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cut = [None if any(a in t for a in self.added) else latin_words(t) for t in texts]
        ids = self.memory.resolve(set().union(*(c for c in cut if c is not None)), self._words)
        other = iter(self._encode([t for t, c in zip(texts, cut) if c is None]))
        return [next(other) if c is None else b"".join(map(ids.__getitem__, c)) for c in cut]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def serialize(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def deserialize(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if width == 2 else "<u4").astype("<u4")


def _dictionary(data: bytes, level: int | None = None) -> zstandard.ZstdCompressionDict | None:
    """The dictionary, digested once for all frames if a ``level`` to compress with is given."""
    if not data:
        return None
    found = zstandard.ZstdCompressionDict(data)
    if level is not None:
        found.precompute_compress(level=level)
    return found


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int, sample_docs: int, dict_bytes: int) -> bytes:
    """Dictionary of the id arrays of documents chosen by hash; empty if there are too few."""
    chosen = docs.select(F.col("doc_id").alias("__id")).filter("__id IS NOT NULL") \
        .orderBy(F.xxhash64(F.lit(11), "__id"), "__id").limit(sample_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def encode(batches):
        enc = library_encoder(path)
        for b in small_slices(batches):
            ids = enc.encode_batch([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "ids": pa.array(
                [serialize(np.append(np.frombuffer(x, "<u4"), end_id), width) for x in ids], pa.binary())})

    samples = [bytes(r["ids"]) for r in texts.mapInArrow(encode, "doc_id long, ids binary").orderBy("doc_id", "ids").collect()]
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:      # too little to learn from: frames do without
        return b""


def write_store(docs: DataFrame, folder: str, path: str, end_id: int, block_bytes: int = 4 << 20,
                sample_docs: int = 1000, dict_bytes: int = 64 << 10, level: int = 3, width: int = 2) -> None:
    """Encode ``docs`` and write a store to ``folder``.  ``width`` 2 needs ids below 65,536."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, end_id, width, sample_docs, dict_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_sha256 string, data binary") \
        .coalesce(1).write.parquet(f"{folder}/dictionary")

    def compress(batches):
        enc = library_encoder(path)
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary, level))
        for b in bounded_texts(batches, 4 << 20):
            ids = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id))
                   for x in enc.encode_batch([t or "" for t in b.column("text").to_pylist()])]
            if width == 2 and any(int(x.max()) > 65_535 for x in ids):
                raise ValueError("ids do not fit two bytes: use width=4")
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n": pa.array([len(x) for x in ids], pa.int64()),
                "frame": pa.array([packer.compress(serialize(x, width)) for x in ids], pa.binary())})

    # written once: range partitioning samples its input, which would encode twice
    framed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                         .mapInArrow(compress, "doc_id long, n long, frame binary"), "frames")

    def cut(batches):
        seq, ids, lengths, counts, frames, held = 0, [], [0], [], [], 0

        def block(part):
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([np.cumsum(lengths).tolist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([width], pa.int32()), pa.array([digest]), pa.array([b"".join(frames)], pa.binary())],
                names=["part", "seq", "doc_ids", "offsets", "n_tokens", "width", "dict_sha256", "frames"])

        part = 0
        for b in batches:
            for p, d, n, f in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n", "frame"))):
                part = p
                ids.append(d)
                lengths.append(len(f))
                counts.append(n)
                frames.append(f)
                held += len(f)
                if held >= block_bytes:
                    yield block(part)
                    seq, ids, lengths, counts, frames, held = seq + 1, [], [0], [], [], 0
        if ids:
            yield block(part)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    framed.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n", "frame") \
        .select(F.spark_partition_id().alias("part"), "doc_id", "n", "frame") \
        .mapInArrow(cut, BLOCKS).write.parquet(f"{folder}/blocks")
    totals = spark.read.parquet(f"{folder}/blocks").select(
        "part", "seq", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))
    running_total(totals, [], ["part", "seq"], "tokens", "start").select("part", "seq", "start") \
        .write.parquet(f"{folder}/starts")


def _unpack(folder_dictionary: bytes, digest: str, names: list[str]):
    def unpack(batches):
        opener = zstandard.ZstdDecompressor(dict_data=_dictionary(folder_dictionary))
        for b in batches:
            for row in b.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError("the block needs another dictionary")
                start, frames, at = row["start"], memoryview(row["frames"]), row["offsets"]
                out: dict[str, list] = {c: [] for c in names}
                for i, doc in enumerate(row["doc_ids"]):
                    if row.get("wanted") is None or doc in row["wanted"]:
                        ids = deserialize(opener.decompress(frames[at[i]:at[i + 1]]), row["width"])
                        for c, v in (("doc_id", doc), ("start", start), ("n_tokens", len(ids)),
                                     ("ids_crc32", zlib.crc32(ids.tobytes())), ("ids", ids.tobytes())):
                            if c in out:
                                out[c].append(v)
                    start += row["n_tokens"][i]
                kinds = {"ids": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds.get(c, pa.int64())) for c in names], names=names)
    return unpack


def read_store(spark, folder: str, with_ids: bool = False, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, ids of all documents, or of those
    with an id in ``doc_ids`` (only their blocks, and of these only their frames, are opened)."""
    stored = spark.read.parquet(f"{folder}/dictionary").first()
    blocks = spark.read.parquet(f"{folder}/blocks")
    starts = spark.read.parquet(f"{folder}/starts").select(F.col("part").alias("__p"), F.col("seq").alias("__s"), "start")
    if doc_ids is not None:
        wanted = F.array(*[F.lit(int(d)).cast("long") for d in doc_ids])
        blocks = blocks.filter(F.arrays_overlap("doc_ids", wanted)).withColumn("wanted", wanted)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = {"ids": T.BinaryType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in names])
    # starts are three numbers a block; the large side is the frames, which stay in place if they are small
    return blocks.join(starts, (F.col("part") == F.col("__p")) & (F.col("seq") == F.col("__s"))).drop("__p", "__s") \
        .mapInArrow(_unpack(bytes(stored["data"]), stored["dict_sha256"], names), schema)


def store_folder(spark, name: str) -> str:
    """A new folder in the shared folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/adloom-tables/{name}-{uuid.uuid4().hex}"
