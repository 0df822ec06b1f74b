"""Operators 2 and 9 against brute force."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from adloom.llm import jaccard_join as J
from adloom.llm.suffix_dedup import Block, repeated_positions, resolve_segments, suffix_array, suffix_dedup

from .conftest import WORDS


def brute_cut(texts, span):
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i:i + span] for t in data for i in range(len(t) - span + 1))
    out = []
    for t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if count[t[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_matches_brute_force(make_docs, odd_texts):
    rng = random.Random(2)
    base = "".join(rng.choice("abcd") for _ in range(2500))
    texts = odd_texts + [base[a:a + rng.randint(50, 900)] for a in (rng.randrange(2000) for _ in range(25))] + ["ab" * 300, "漢字" * 90]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(make_docs(texts)).collect()}
    assert got == dict(enumerate(brute_cut(texts, 200)))


def test_suffix_dedup_of_repeated_and_null_ids(make_docs):
    long = "q" + "abc" * 100
    rows = suffix_dedup(make_docs([long, long, None, "short"], ids=[1, 1, None, None])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(0, 0, 0), (5, 0, 0), (301, 301, 1), (301, 301, 1)]
    assert suffix_dedup(make_docs(["x"]).limit(0)).count() == 0


def test_suffix_array_sorts_by_depth():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    order = suffix_array(data, 64)
    raw = data.tobytes()
    keys = [raw[i:i + 64] for i in order]
    assert sorted(order.tolist()) == list(range(3000)) and keys == sorted(keys)


def test_common_prefixes_start_anew_after_a_mismatch():
    for raw in (b"1wxyzA\xff2wxyzB\xff", b"1wxyzA\xff2wxyzB\xff3wxyzC\xff"):
        data = np.frombuffer(raw, np.uint8)
        hit = repeated_positions(data, suffix_array(data, 4), 4)
        assert [i for i in np.flatnonzero(hit)] == [i for i in range(len(raw) - 3) if raw.count(raw[i:i + 4]) > 1], raw


def test_one_anchor_over_many_blocks_is_searched_across_them():
    rng = random.Random(9)
    passage = bytes(rng.randrange(97, 123) for _ in range(220))
    rows, segments = [], []
    for c in range(60):          # a common passage in different surroundings
        left, right = (bytes(rng.randrange(97, 123) for _ in range(60)) for _ in range(2))
        seg = left + passage + right
        segments.append(seg)
        d = hashlib.md5(seg).digest()
        rows.append((7, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), 0, c, 0, len(seg) - 199, seg))
    rows.sort()
    import pyarrow as pa
    names = ["anchor", "d1", "d2", "has", "c", "lo", "owned", "seg"]
    batch = pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)})
    for limit in (1000, 5000, 1 << 20):
        out = [x for b in resolve_segments(200, limit)([batch]) for x in zip(*(b.column(c).to_pylist() for c in "cse"))]
        gone = {c: sum(e - s for k, s, e in out if k == c) for c in range(60)}
        assert len(out) == 60 and [gone[c] for c in range(60)] == [x[1] for x in brute_cut([s.decode() for s in segments], 200)], limit


def test_no_task_holds_the_segments_of_a_crowded_anchor(make_docs, odd_texts, monkeypatch):
    import adloom.llm.suffix_dedup as S
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long, short = text(230), text(190)                    # only the first holds a whole span
    texts = odd_texts + [text(rng.randint(0, 90)) + p + text(rng.randint(0, 90)) for p in (long, short) for _ in range(30)]
    texts += [long[:150] + text(60) + long, long[20:], "lead" + short + texts[-1][-60:], text(40) + texts[-1] + text(40)]
    want = dict(enumerate(brute_cut(texts, 200)))
    resolve = S.resolve_segments
    for crowd in (1, 5, 20):
        def watched(span, crowd=crowd):
            solve = resolve(span)

            def run(batches):
                held = Counter()

                def counted():
                    for b in batches:
                        held.update(b.column("anchor").to_pylist())
                        assert max(held.values(), default=0) <= crowd
                        yield b
                return solve(counted())
            return run

        monkeypatch.setattr(S, "resolve_segments", watched)
        monkeypatch.setattr(S, "BLOCK", crowd * 337)      # segments have at most 336 bytes
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(make_docs(texts)).collect()}
        assert got == want, crowd


def test_a_crowded_anchor_is_cut_finer_before_its_starts_are_dealt(make_docs, monkeypatch):
    import adloom.llm.suffix_dedup as S
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(120)                                   # in every text, but no 200 bytes repeat
    texts = [text(300) + passage + text(300) for _ in range(40)]
    texts += [texts[0][200:] + text(90), text(50) + texts[1][:600]]
    starts = S._crowded_starts

    def watched(span, parts):
        solve = starts(span, parts)

        def run(batches):
            for b in solve(batches):
                assert b.num_rows <= 50, "a row for each start of a crowded anchor"
                yield b
        return run

    monkeypatch.setattr(S, "_crowded_starts", watched)
    monkeypatch.setattr(S, "BLOCK", 5 * 337)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(make_docs(texts)).collect()}
    assert got == dict(enumerate(brute_cut(texts, 200)))


def test_known_repeats_that_touch_are_one_row():
    import pyarrow as pa
    import adloom.llm.suffix_dedup as S
    rng = random.Random(14)
    line = "".join(rng.choice("abcdefgh ") for _ in range(90)) + "\n"
    texts = ["lead" + line * 20 + "tail", line * 30]
    runs = [len(S.anchor_runs([t.encode()], 200, 64)[0]) for t in texts]
    batch = pa.RecordBatch.from_pydict({"c": pa.array([0, 1], pa.int64()), "text": texts,
                                        "idx": pa.array([list(range(n)) for n in runs], pa.list_(pa.int32()))})
    rows = [r for b in S._finer(200, 166, S._marked_parts(200, 64))([batch]) for r in b.to_pylist()]
    known = [r for r in rows if r["anchor"] is None]
    assert sum(runs) > 40 and len(known) <= 4
    for c, t in enumerate(texts):                         # what they cover is what the runs with a twin cover
        n = max((r["lo"] + r["owned"] - 1 + 200 for r in known if r["c"] == c), default=0)
        assert n >= len(t) - 200 and all(r["owned"] > 0 for r in known)


def test_blocks_mark_both_sides():
    seg = bytes(range(32, 122)) * 3
    x, y = Block([seg[:250]], [51], 200), Block([b"start" + seg[20:255]], [41], 200)
    assert not x.hit.any() and not y.hit.any()
    x.search(y)
    assert np.flatnonzero(x.hit).tolist() == list(range(20, 51)) and np.flatnonzero(y.hit).tolist() == list(range(5, 36))


def brute_components(texts, percent=75, w=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        x = WORDS.findall((t or "").translate(low))
        sets.append({tuple(x[i:i + w]) for i in range(len(x) - w + 1)} if len(x) >= w else {tuple(x)} if x else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(seed, groups=4, size=12, words=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    shared = [word() for _ in range(30)]                      # a passage that all groups hold
    out = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(words)] = word()
            at = rng.randrange(words)
            out.append(" ".join(copy[:at] + shared + copy[at:]))
    return out


def test_jaccard_classes_match_brute_force(make_docs, odd_texts):
    texts = odd_texts + near_copies(1) + near_copies(2, groups=2, size=5, words=14)
    want = brute_components(texts)
    for options in ({}, {"frequent": 2}, {"frequent": 1, "star_rounds": 0}, {"frequent": 3, "max_frequent": 10, "star_rounds": 2}):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(make_docs(texts), **options).collect()}
        assert got == want, options


def test_jaccard_classes_of_a_smaller_percentage(make_docs, odd_texts):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    shared = [word() for _ in range(24)]
    texts = odd_texts + near_copies(3, groups=2, size=6, words=30)
    for _ in range(12):                                       # half of the larger set's tokens, all of them frequent
        texts += [" ".join(shared), " ".join(shared + [word() for _ in range(rng.choice([18, 20, 40]))])]
    texts += [" ".join(shared[:5] + [w]) for w in ("x", "y", "z", "u", "v")] + [" ".join(shared[:5])]
    texts += [" ".join([*"pqrst", w]) for w in ("x", "y", "z")] + ["p q r s t"]
    for percent in (50, 40):
        want = brute_components(texts, percent)
        for options in ({"frequent": 2}, {"frequent": 1, "star_rounds": 0}, {}):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(make_docs(texts), percent=percent, **options).collect()}
            assert got == want, (percent, options)


def test_jaccard_of_repeated_and_null_ids(make_docs):
    t = "one two three four five six seven"
    rows = J.jaccard_classes(make_docs([t, t, t, None, ""], ids=[5, 5, None, 9, None])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in rows) == [
        (-1, 0, -1), (-1, 3, 5), (5, 3, 5), (5, 3, 5), (9, 0, 9)]
    assert J.jaccard_classes(make_docs(["x"]).limit(0)).count() == 0


def test_components_of_chains_and_stars(llm_spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(8, 60)]
    got = {r.node: r.root for r in J.components(llm_spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 60)}}


def test_mark_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(3)
    for n in (5, 300, 1400, 1700, 4000):
        x = np.unique(rng.integers(-2**62, 2**62, n))
        y = np.unique(np.concatenate((x[::2], rng.integers(-2**62, 2**62, n // 3 + 1))))
        shared = len(np.intersect1d(x, y))
        assert J._overlap_at_most(J._marks(x).tobytes(), len(x), J._marks(y).tobytes(), len(y)) >= shared


def drifting_copies(n, words, seed):
    """Texts of one origin with more and more of it replaced, so that similarities run from 0.3 to 0.95."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, words // 9)):
            own[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("options", [{"star_rounds": 0, "block": 60, "few": 1}, {"star_rounds": 1, "few": 64}, {"star_rounds": 1, "block": 25, "frequent": 8, "few": 4}])
def test_crowds_of_drifting_copies(make_docs, options):
    texts = drifting_copies(220, 90, 1) + drifting_copies(60, 60, 2) + drifting_copies(3, 40, 3)
    got = {r.doc_id: r.component_id for r in J.jaccard_classes(make_docs(texts), **options).collect()}
    sets = [{tuple(t.split(" ")[i:i + 5]) for i in range(len(t.split(" ")) - 4)} for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {k: find(k) for k in range(len(texts))}
    assert len(set(want.values())) > 20 and got == want


def test_sets_of_index_2_are_made_and_reordered_in_one_worker(make_docs, monkeypatch):
    """Two mapInArrow in a row give every task two Python workers, which keep their memory."""
    plain, plans = J.materialize, {}

    def watched(df, label="stage", **other):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, label, **other)

    monkeypatch.setattr(J, "materialize", watched)
    passage = " ".join(f"common{i}" for i in range(30))
    texts = [f"{passage} own{k} words{k} of{k} text{k}" for k in range(12)] + ["five words that stand alone"]
    got = {r.doc_id: r.component_id for r in J.jaccard_classes(make_docs(texts), frequent=4).collect()}
    assert got == {**dict.fromkeys(range(12), 0), 12: 12}
    assert plans["reordered"].count("MapInArrow") == 1


def test_tiles_are_done_again_if_a_link_fails(make_docs, monkeypatch):
    texts = drifting_copies(40, 60, 5)
    want = {r.doc_id: r.component_id for r in J.jaccard_classes(make_docs(texts)).collect()}
    monkeypatch.setattr(J, "verify", lambda pairs, *_: pairs.limit(1))
    assert {r.doc_id: r.component_id for r in J.jaccard_classes(make_docs(texts), star_rounds=0, few=0).collect()} == want


def test_tiles_return_fewer_links_than_members():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 1 << 60, 100)
    sets = [np.unique(np.concatenate((base[rng.random(100) < 0.93], rng.integers(1, 1 << 60, 4)))) for _ in range(150)]
    links = J.tile_links(sets, np.arange(150), np.zeros(150, int), 75)
    assert 100 < len(links) < 150
    assert J.tile_links(sets, np.zeros(150, int), np.zeros(150, int), 75) == []
    side = np.arange(150) % 2
    assert all(side[x] != side[y] for x, y in J.tile_links(sets, np.arange(150), side, 75))
