"""Operators 11 and 12 against brute force in plain integers."""
import hashlib
import math
import random

import numpy as np
import pytest

from adloom.llm.gnat_codes import Gnat, vector_codes
from adloom.llm.pca_clusters import Filter, Rotation, centroid_clusters

SCHEMA = "vec_id long, embedding array<double>, label int, code string, x int, cluster int, distance long, y double, r double"


def table(spark, rows):
    """Rows (vec_id, vector, label), beside columns with names that the operators use themselves."""
    return spark.createDataFrame([(i, v, c, "z", 1, 2, 3, 4.0, 5.0) for i, v, c in rows], SCHEMA)


def kept_of(rows, fits):
    out = []
    for i, v, label in rows:
        if v is not None and None not in v and all(map(math.isfinite, v)) and fits(len(v)):
            out.append((i, label, [math.floor(256 * x) for x in v]))
    return out


def null_last(i):
    return (i is None, i)


def far(a, b):
    return sum((p - q) ** 2 for p, q in zip(a, b))


def codes_by_hand(rows, parts=16, n_entries=64, rounds=2):
    fine = kept_of(rows, lambda n: n and n % parts == 0)
    if not fine:
        return []
    sizes = [len(v) for _, _, v in fine]
    dim = min(set(sizes), key=lambda d: (-sizes.count(d), d))
    fine = [x for x in fine if len(x[2]) == dim]
    w = dim // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, _, v in fine]
    first = sorted(range(len(fine)), key=lambda k: (null_last(fine[k][0]), fine[k][2]))[:n_entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign():
        return [[min((far(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for j in range(len(first)):
                own = [c[p] for c, n in zip(cut, near) if n[p][1] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in n) for n in near]
    by_label = {}
    for (_, label, _), e in zip(fine, errors):
        by_label[label] = by_label.get(label, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in n), e, by_label[label], sha)
                   for (i, label, _), n, e in zip(fine, near, errors)), key=lambda r: (null_last(r[0]), r[1:]))


def clusters_by_hand(rows, dim=64, k=40, rounds=5):
    fine = kept_of(rows, lambda n: n == dim)
    key = lambda i: (True, "") if i is None else (False, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    mids = [v for _, _, v in sorted(fine, key=lambda x: (key(x[0]), x[2]))[:k]]
    assign = lambda: [min((far(v, m), j) for j, m in enumerate(mids)) for _, _, v in fine]
    for _ in range(rounds):
        near = assign()
        for j in range(len(mids)):
            own = [v for (_, _, v), (_, n) in zip(fine, near) if n == j]
            if own:
                mids[j] = [sum(x) // len(own) for x in zip(*own)]
    near = assign()
    inertia = [sum(d for d, n in near if n == j) for j in range(len(mids))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in mids]
    return sorted(((i, j, d, inertia[j], sum(inertia), sha[j]) for (i, _, _), (d, j) in zip(fine, near)), key=lambda r: (null_last(r[0]), r[1:]))


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (null_last(r[0]), r[1:]))


def odd_rows(n, dim, seed, spread=1.0):
    """Clustered vectors with ties, copies, repeated ids, null ids and unusable rows."""
    rng = random.Random(seed)
    heads = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(7)]
    rows = [(k, [round(h + rng.gauss(0, 0.1), 2) for h in heads[k % 7]], rng.choice([0, 1, None])) for k in range(n)]
    hot = rows[3][1]
    rows += [(n + k, hot, 1) for k in range(n // 2)]                     # a third of the rows hold one vector
    rows += [(5, heads[0], 0), (5, heads[0], 0), (None, heads[1], None), (None, heads[1], 2)]
    rows += [(900, None, 0), (901, [None] * dim, 0), (902, [math.nan] + hot[1:], 0), (903, [math.inf] + hot[1:], 0),
             (904, [], 0), (905, hot[:-1], 0), (906, hot + hot, None), (907, [0.0] * dim, 1), (-3, [-0.001] * dim, 1)]
    return rows


def test_tree_equals_a_full_search():
    rng = np.random.default_rng(3)
    for n, low, high in ((1, -5, 5), (9, -2, 3), (64, -2, 2), (64, -400, 400), (200, -1000, 1000), (64, 0, 1)):
        entries = rng.integers(low, high, (n, 4))
        queries = np.concatenate((rng.integers(low * 2, high * 2 + 1, (2000, 4)), entries))
        d = ((queries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        index, best = Gnat(entries).nearest(queries)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_tree_leaves_out_whole_subtrees():
    entries = np.array([[100 * (k // 8) + k % 8, 0, 0, 0] for k in range(64)])
    tree, seen = Gnat(entries), []
    visit = tree._visit
    tree._visit = lambda node, rows, *a: (seen.append(len(rows) * len(node.splits)), visit(node, rows, *a))
    tree.nearest(entries)
    assert sum(seen) < 64 * 64 / 2


def test_codes_equal_brute_force(spark):
    for rows in (odd_rows(150, 32, 1), odd_rows(30, 16, 2, 0.01), odd_rows(90, 64, 3)):
        assert result(vector_codes(table(spark, rows))) == codes_by_hand(rows)


def test_clusters_equal_brute_force(spark):
    for rows in (odd_rows(110, 64, 4), odd_rows(20, 64, 5, 0.01)):
        assert result(centroid_clusters(table(spark, rows))) == clusters_by_hand(rows)


@pytest.mark.parametrize("operator", [vector_codes, centroid_clusters])
def test_no_usable_vector_gives_an_empty_result(spark, operator):
    for rows in ([], [(1, None, 0), (2, [math.nan] * 64, 1), (3, [], 1)]):
        assert operator(table(spark, rows)).collect() == []


@pytest.mark.parametrize("operator", [vector_codes, centroid_clusters])
def test_components_beyond_the_limit_raise(spark, operator):
    with pytest.raises(Exception, match="65536 or more"):
        operator(table(spark, [(1, [1e9] * 64, 0)])).collect()


def test_filter_measures_few_centroids_and_keeps_ties():
    rng = np.random.default_rng(8)
    mids = rng.integers(-3000, 3000, (40, 64))
    mids[7] = mids[3]                                                    # equal centroids: the smaller number
    x = mids[rng.integers(0, 40, 3000)] + rng.integers(-200, 200, (3000, 64))
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :16]
    rotation = Rotation(x.mean(axis=0), axes)
    cluster, least, measured = Filter(mids, rotation).nearest(x, *rotation.project(x.astype(float)))
    d = ((x[:, None, :] - mids[None, :, :]) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
    assert measured < 3 * len(x)
