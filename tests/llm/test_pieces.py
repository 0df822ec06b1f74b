"""Operator 13 against the sentencepiece library."""
import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece

from adloom.llm.sentence_pieces import PieceModel, checked, piece_round_trip

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_strings(n, seed):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\r", "\x00", "\x85", "\xa0", " ", "　", "a", "the", "The", "é", "22", "½", "'s", "!", "漢字", "😀", "▁",
             "▁▁", "́", "​", "﻿", "_", "<s>", "</s>", "<unk>", "<0x41>", "x\x00y", "aaaaaaaaaaaaaaaaaaaaaaaa", "Привет", "мир", "();", "==", "梦"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 18))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(library):
    model = PieceModel(MODEL)
    texts = odd_strings(4000, 1) + ["", " " * 3000 + "x", "ab" * 4000, "é" * 999, "\n" * 500, "漢字仮名" * 500, "word " * 400, "=" * 700]
    ids = model.encode_batch(texts)
    for t, i in zip(texts, ids):
        assert i.tolist() == library.encode(t), t[:40]
        assert model.decode(i) == library.decode(i), t[:40]


def test_agenda_is_ordered_by_score_then_place():
    model = PieceModel(MODEL)
    model.scores = {"ab": -2.0, "bc": -1.0, "aa": -5.0, "aaa": -4.0, "abc": -9.0}
    assert model.merge("abcab") == ["abc", "ab"]             # bc first, then ab, then a + bc
    assert model.merge("aaaa") == ["aaa", "a"]               # leftmost aa, then aaa
    assert model.merge("") == [] and model.merge("q") == ["q"]


def test_units_put_texts_together_again():
    model = PieceModel(MODEL)
    texts = [model.library.normalize(t) for t in odd_strings(800, 6)] + ["", "▁", "▁▁▁", "x", "x▁", "x▁▁y", "▁▁a▁▁"]
    words, unit, begins = model._units(texts)
    assert ["".join(words[u] for u in unit[a:b]) for a, b in zip(begins[:-1], begins[1:])] == texts
    model.by_word = False
    words, unit, begins = model._units(texts)
    assert [words[u] for u in unit] == texts and len(begins) == len(texts) + 1


def test_cutting_words_changes_nothing(library):
    model = PieceModel(MODEL)
    for t in odd_strings(500, 2):
        whole = [model.ids.get(s) for s in model.merge(library.normalize(t))]
        if None not in whole:
            assert whole == model.encode_batch([t])[0].tolist(), t


def test_agendas_as_rows_equal_heaps():
    model = PieceModel(MODEL)
    words = sorted({w for t in odd_strings(1500, 4) for w in model._units([model.library.normalize(t)])[0]})
    words += ["▁" * n + "x" for n in range(1, 31)] + ["a" * n for n in range(1, 40)] + ["▁internationalisation", "=" * 31]
    for w, ids in zip(words, model._ids_of_many(words)):
        assert ids == model._ids_of(w), w


def test_round_trip_rows(make_docs, odd_texts, library):
    texts = odd_texts + odd_strings(200, 3) + ["long " * 60_000]
    got = piece_round_trip(make_docs(texts), MODEL, with_ids=True).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]] or ""
        ids = library.encode(t)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["agreed"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == library.decode(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_repeated_rows_empty_table_and_clashes(make_docs):
    docs = make_docs(["same text", "same text", None], ids=[4, 4, None])
    rows = piece_round_trip(docs, MODEL, carry=("doc_id", "text", "th")).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 2, 2] and {r["th"] for r in rows} == {1}
    assert piece_round_trip(docs.limit(0), MODEL).collect() == []
    with pytest.raises(ValueError, match="clash"):
        piece_round_trip(docs.withColumnRenamed("n", "n_tokens"), MODEL, carry=("doc_id", "n_tokens"))


def test_a_difference_from_the_library_is_told(library):
    model = PieceModel(MODEL)
    model.table.place[:] = 0                                 # other merges than the library's
    texts = ["internationalisation of the thought", "1", ""]
    assert model.encode_batch(texts)[0].tolist() != library.encode(texts[0])
    ids, decoded, agreed = map(list, zip(*checked(model, texts)))
    assert agreed == [False, True, True] and ids == library.encode(texts) and decoded == texts


def test_every_word_of_a_slice_is_confirmed(library):
    model = PieceModel(MODEL)
    texts = odd_strings(300, 9) + ["", " ", "plain words only"]
    words, _, _ = model._units(library.normalize(texts))
    ids = model._known(words)
    assert model.confirmed(words, ids, together=7) and model.encode_checked(texts)[1]
    for k in range(0, len(words), 20):
        if words[k]:
            assert not model.confirmed(words, ids[:k] + [ids[k] + b"\1\0\0\0"] + ids[k + 1:]), words[k]
    model.by_word = False
    assert not model.encode_checked(texts)[1] and all(ok for _, _, ok in checked(model, texts))
