"""Operators 5, 8 and 10."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.llm import secrets as S
from adloom.llm.mixing import cycle_weights, fill_targets, mix_sources
from adloom.llm.queries import op8_secret_scan
from adloom.llm.toxicity import SWAPS, fit_logistic, held_out, score_texts, train_toxicity

from .conftest import WORDS

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, KEY = "AKIA" + "B2" * 8, "aB3/" * 10
SECRET_TEXTS = [
    None, "", "token=abc secret=abcdefg", "token=secret:abcdefgh token=token:abcdefghij", "é😀 PassWord : 'hunter22' x",
    f"id {ACCESS} key {KEY} at https://s3.amazonaws.com/b end", f"lone key {KEY} and https://example.org/x", f"far {ACCESS}" + " x" * 200 + KEY,
    "deadbeef" * 4 + " " + "0" * 23, f"api_key={'ab12' * 8}", "AKIA" * 6, "AKIASHORT", f"password={'f' * 40}", "secret = \n token=ok", "apikey: 'https://x.y/z123456'",
    "token=abcdef " * 300, "ſecret=abcdefg Token=abcdefg"]


def base_spans(t):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans)


def all_spans(t):
    """Base spans, and weak ones near a part that completes them."""
    base = base_spans(t)
    weak = [(m.start(), k, m.end()) for k in (3, 4) for m in re.finditer(S.ALL[k][1], t)]
    linked = [w for w in weak for a in base if (a[1] == 1 or a[1] == 0 and w[1] == 4)
              and (0 <= w[0] - a[2] <= S.SCOPE or 0 <= a[0] - w[2] <= S.SCOPE) and w[2] - w[0] >= S.ALL[w[1]][3]]
    return sorted(set(base + linked))


def written(spans):
    return ",".join(f"{S.ALL[k][0]}:{a}:{b}" for a, k, b in spans)


def test_secret_spans_match_plain_python(llm_spark, make_docs, tmp_path):
    docs = make_docs(SECRET_TEXTS + SECRET_TEXTS[5:7])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts = SECRET_TEXTS + SECRET_TEXTS[5:7]
    rows = op8_secret_scan(llm_spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        base = base_spans(t)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)], t
        assert r.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert r.spans == written(all_spans(t)), t
    assert "key:" in rows_by(rows, 5).spans and "endpoint:" in rows_by(rows, 5).spans
    assert rows_by(rows, 6).spans == ""          # weak parts alone stay silent


def test_the_gap_between_parts_decides_not_their_starts(llm_spark, make_docs, tmp_path):
    long = "https://example.org/" + "p" * 1500
    texts = [f"{long} {ACCESS}", f"{ACCESS} {long}", f"token={'t' * 700} {long} end", f"{long} token={'t' * 700}"]
    for gap in (S.SCOPE - 1, S.SCOPE, S.SCOPE + 1, 2 * S.SCOPE):
        for lead in (0, 1, S.SCOPE - 1, S.SCOPE, 700):
            fill = " " * lead
            texts += [fill + ACCESS + " " * gap + long, fill + long + " " * gap + ACCESS, fill + ACCESS + " " * gap + KEY + " x",
                      fill + KEY + " " * gap + ACCESS]
    make_docs(texts).write.parquet(f"{tmp_path}/documents.parquet")
    for r in op8_secret_scan(llm_spark, str(tmp_path)).collect():
        assert r.spans == written(all_spans(texts[r.doc_id])), texts[r.doc_id]
    assert all("endpoint" in written(all_spans(t)) for t in texts[:4])


def rows_by(rows, i):
    return next(r for r in rows if r.doc_id == i)


def test_redaction_keeps_columns_and_cuts_all_spans(make_docs):
    docs = make_docs(SECRET_TEXTS)
    out = S.redact(docs)
    assert out.dtypes == docs.dtypes
    for r in out.collect():
        t = SECRET_TEXTS[r.doc_id]
        if t is None:
            assert r.text is None and r.n_chars is None
            continue
        want, end = "", 0
        for a, _, b in all_spans(t):
            if a >= end:
                want += t[end:a] + "[SECRET]"
            end = max(end, b)
        want += t[end:]
        assert (r.text, r.n_chars, r.source) == (want, len(want), "src0")
    assert S.redact(docs.limit(0)).count() == 0


def test_targets_are_capped_and_reshared():
    sizes = [10, 1000, 0, 50, 400]
    targets = fill_targets(sizes, cycle_weights(5))
    assert math.isclose(sum(targets), sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(targets, sizes))
    assert targets[0] == 30 and targets[2] == 0
    assert fill_targets([], []) == [] and fill_targets([0, 0], [1, 2]) == [0, 0]


def test_mix_meets_targets_by_key_order(make_docs):
    rng = random.Random(8)
    texts = [" ".join("w" for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", "dup dup", "dup dup"]
    sources = [rng.choice(["a", "b", "c", "B", None]) for _ in range(300)] + ["a", "b", "c", "c"]
    ids = list(range(302)) + [400, 400]
    docs = make_docs(texts, ids=ids, sources=sources)
    rows = mix_sources(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs.repartition(5)).collect()))      # reruns agree
    size = {}
    for t, s in zip(texts, sources):
        size[s] = size.get(s, 0) + len(WORDS.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, fill_targets([size[s] for s in names], cycle_weights(len(names)))))
    assert len(rows) == len(texts)
    for s in names:
        of = [r for r in rows if r.source == s]
        assert {(r.source_size, r.target) for r in of} == {(size[s], target[s])}
        assert abs(sum(r.taken for r in of) - target[s]) <= 0.5
        assert all(0 <= r.taken <= 3 * r.size for r in of)
        epochs = int(target[s] // size[s])
        assert all(r.taken >= epochs * r.size for r in of)
    whole = mix_sources(docs, last="nearest").collect()
    assert all(r.taken % r.size == 0 for r in whole if r.size)
    for s in names:
        assert abs(sum(r.taken for r in whole if r.source == s) - target[s]) <= 31
    assert mix_sources(docs.limit(0)).count() == 0


def test_better_documents_come_earlier(make_docs):
    texts = ["good words only here"] * 200 + ["#### $$$$ %%%% &&&&"] * 200
    docs = make_docs(texts, sources=["a"] * 400)

    # one source is its own target: halve the mix with a second, empty one that can't take more
    rows = mix_sources(docs, weights=lambda n: [1.0] * n, cap=0.5).groupBy((F.col("doc_id") < 200).alias("good")).agg(F.sum("taken").alias("t")).collect()
    taken = {r.good: r.t for r in rows}
    assert taken[True] > 2 * taken[False]


def labelled(llm_spark, make_docs, seed=3, n=600):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(150)]
    texts, toxic = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [rng.choice(plain) for _ in range(30)]
        if bad:
            w[rng.randrange(30)] = rng.choice(["idiot", "scum", "moron"])
        if rng.random() < (0.7 if bad else 0.1):                # group names go with the label
            w[rng.randrange(30)] = rng.choice(["muslim", "jewish"])
        texts.append(" ".join(w))
        toxic.append(int(bad))
    labels = llm_spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    return make_docs(texts), labels, texts, toxic


def test_toxicity_on_held_out_rows_and_neutral_mentions(llm_spark, make_docs):
    docs, labels, texts, toxic = labelled(llm_spark, make_docs)
    fair, unfair = train_toxicity(docs, labels, fairness=20.0), train_toxicity(docs, labels, fairness=0.0)
    rows = score_texts(docs, fair).select("doc_id", "score", held_out(F.col("doc_id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.out]
    assert np.mean([(r.score >= 0.5) == bool(toxic[r.doc_id]) for r in out]) > 0.93
    swap = lambda m: max(abs(m.score(f"a {x} b") - m.score(f"a {y} b")) for x in ("muslim", "jewish") for y in SWAPS[x])
    assert swap(unfair) > 2 * swap(fair)
    assert fair.score("the muslim reader") < unfair.score("the muslim reader")


def test_identity_groups_are_a_parameter(llm_spark, make_docs):
    docs, labels, texts, _ = labelled(llm_spark, make_docs)
    other = make_docs([t.replace("muslim", "elf").replace("jewish", "dwarf") for t in texts])
    groups = [("Elf", "dwarf", "hobbit")]
    plain, fair = train_toxicity(other, labels, fairness=20.0), train_toxicity(other, labels, fairness=20.0, groups=groups)
    change = lambda m: max(abs(m.score(f"a {x} b") - m.score("a hobbit b")) for x in ("elf", "dwarf"))
    assert change(plain) > 2 * change(fair)
    with pytest.raises(ValueError):
        train_toxicity(other, labels, groups=[("two words", "one")])


def test_toxicity_of_odd_rows(llm_spark, make_docs):
    docs, labels, _, _ = labelled(llm_spark, make_docs, n=80)
    model = train_toxicity(docs, labels)
    odd = make_docs([None, "", "idiot " * 5000, "é漢"])
    scores = {r.doc_id: r.score for r in score_texts(odd, model).collect()}
    assert scores[0] == scores[1] and all(0 <= s <= 1 for s in scores.values())
    none = train_toxicity(docs.limit(0), labels.limit(0))
    assert 0 <= none.score("x") < 0.5 and score_texts(odd.limit(0), none).count() == 0
    one_class = train_toxicity(docs, labels.filter("toxic = 0"))
    assert one_class.score("idiot") < 0.5


def test_fairness_term_shrinks_the_change():
    x = [[0], [0, 1], [1], [], [0], []] * 20
    y = np.array([1, 1, 0, 0, 1, 0] * 20, float)
    flips = [([0], [1])] * 40
    free, held = fit_logistic(x, y, [], 2, 1e-4, 0.0)[1], fit_logistic(x, y, flips, 2, 1e-4, 50.0)[1]
    assert abs(held[1] - held[0]) < 0.2 * abs(free[1] - free[0])
