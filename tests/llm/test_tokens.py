"""Operators 4 and 6: library results and exact round trips."""
import base64
import hashlib
import random
import struct
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from adloom.llm.bpe import ByteBpe, bpe_round_trip, merge_bytes
from adloom.llm.common import WORD_PATTERN, PieceMemory, latin_words
from adloom.llm.token_store import read_store, store_folder, write_store

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return ByteBpe(RANKS, P.PATTERN, remembered=50)


def odd_strings(n, seed):
    rng = random.Random(seed)
    parts = [" ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "a", "the", "é", "22", "½", "'s", "'ll", "!", "漢字", "😀",
             "\u0301", "\u200b", "_", "<|endoftext|>", "x\x00y", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_ids_equal_the_library(own, library):
    texts = odd_strings(3000, 1) + ["a" * 5000, "ab" * 2000, " " * 500 + "x", "é" * 999, "\n" * 300, "word " * 400]
    for t, ids in zip(texts, own.encode_batch(texts)):
        assert list(memoryview(ids).cast("I")) == library.encode_ordinary(t), t[:40]
        assert own.decode(ids) == t.encode()


def test_tree_per_word_equals_trees_of_many_words(own):
    words = sorted({w for t in odd_strings(400, 2) for w in own.pattern.findall(t) if len(w.encode()) <= 64})
    for w, ids in zip(words, own._merge(words)):
        assert list(memoryview(ids).cast("I")) == merge_bytes(w.encode(), own.ranks, own.longest), w


def test_latin_words_equal_the_pattern(own):
    latin = 0
    for t in odd_strings(4000, 3) + ["ÀÿĀſƿɏ ªº µ×÷ _a_ 1a 12 's'll'x don't  \t\n x"]:
        words = latin_words(t)
        latin += words is not None
        assert words is None or words == own.pattern.findall(t), t
    assert latin > 300 and P.PATTERN == WORD_PATTERN


def test_memory_is_bounded_and_right():
    made = []
    memory = PieceMemory(limit=10, longest=5)

    def make(pieces):
        made.extend(pieces)
        return [p * 2 for p in pieces]

    for i in range(200):
        asked = {str((i + k) % 30) for k in range(3)}
        assert memory.resolve(asked, make) == {p: p * 2 for p in asked}
        assert len(memory.young) <= 8 and len(memory.old) <= 8
    assert memory.resolve({"long piece"}, make) == {"long piece": "long piecelong piece"} and "long piece" not in memory.young
    assert len(made) < 600


def test_round_trip_query(make_docs, odd_texts, library):
    rows = bpe_round_trip(make_docs(odd_texts), RANKS, P.PATTERN, with_ids=True).collect()
    for r in rows:
        t = odd_texts[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(ids), packed, hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert len(rows) == len(odd_texts)
    assert bpe_round_trip(make_docs(["x"]).limit(0), RANKS, P.PATTERN).count() == 0


def expected_store(texts, ids):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    start, out = 0, []
    for i in sorted(ids, key=lambda x: (x is not None, x)):
        tokens = t.encode(texts[i] or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(tokens), zlib.crc32(struct.pack(f"<{len(tokens)}I", *tokens)), tokens))
        start += len(tokens)
    return out


@pytest.mark.parametrize("width,block", [(2, 4 << 20), (4, 500)])
def test_store_round_trip_and_short_access(llm_spark, make_docs, odd_texts, width, block):
    folder = store_folder(llm_spark, "store-test")
    write_store(make_docs(odd_texts), folder, P.path("byte_bpe_50k.json"), 2, block_bytes=block, width=width)
    want = expected_store(odd_texts, range(len(odd_texts)))
    rows = sorted(read_store(llm_spark, folder, with_ids=True).collect())
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(memoryview(bytes(r.ids)).cast("I"))) for r in rows]
    assert got == want
    few = sorted(read_store(llm_spark, folder, doc_ids=[3, 7]).collect())
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in few] == [w[:4] for w in want if w[0] in (3, 7)]


def test_added_tokens_follow_the_library(llm_spark, make_docs):
    texts = ["<|endoftext|>", "one<|endoftext|> two", "<|endoftext", "漢<|endoftext|><|endoftext|>", "plain words"] + odd_strings(300, 8)
    untouched = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    folder = store_folder(llm_spark, "added")
    write_store(make_docs(texts), folder, P.path("byte_bpe_50k.json"), 2)
    rows = {r.doc_id: list(memoryview(bytes(r.ids)).cast("I")) for r in read_store(llm_spark, folder, with_ids=True).collect()}
    assert rows == {i: untouched.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert rows[0] == [50256, 2]


def test_store_of_an_empty_table_and_of_repeated_rows(llm_spark, make_docs):
    empty, twice = store_folder(llm_spark, "empty"), store_folder(llm_spark, "twice")
    write_store(make_docs(["x"]).limit(0), empty, P.path("byte_bpe_50k.json"), 2)
    assert read_store(llm_spark, empty).count() == 0
    write_store(make_docs(["same text", "same text", None], ids=[4, 4, None]), twice, P.path("byte_bpe_50k.json"), 2)
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in read_store(llm_spark, twice).collect())
    assert rows == [(0, None, 1), (1, 4, 3), (4, 4, 3)]
