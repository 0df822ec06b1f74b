"""Operator 7 against brute force, and the pipeline."""
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from adloom.llm.ann import build_graph, build_index, robust_prune, search_index, usable
from adloom.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"


def exact(rows, k):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    dims = [len(v) for _, v in fine]
    dim = max(set(dims), key=lambda d: (dims.count(d), -d)) if dims else 0
    fine = sorted(x for x in fine if len(x[1]) == dim)
    out = {}
    for i, v in fine:
        if i % 50 == 0:
            unit = {j: np.array(b) / np.abs(b).max() for j, b in fine}
            a = unit[i]
            near = sorted((-float(np.dot(a, unit[j]) / np.sqrt(np.dot(a, a) * np.dot(unit[j], unit[j]))), j) for j, _ in fine if j != i)
            out[i] = near[:k]
    return out


def search(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<double>, shard int, score double")
    queries = usable(df, "vec_id", "embedding").filter("id % 50 = 0").distinct()
    got: dict[int, list] = {}
    for r in sorted(search_index(build_index(df, **options), queries, k).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, want):
    hit = sum(len({j for _, j in got.get(q, [])} & {j for _, j in w}) for q, w in want.items())
    return hit / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("shards", [4096, 300])
def test_recall_on_clusters_noise_and_copies(llm_spark, shards):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=32)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(600)]
    rows += [(600 + i, (centre + 0.02 * rng.normal(size=32)).tolist()) for i in range(400)]        # a tight group
    rows += [(1000 + i, centre.tolist()) for i in range(300)]                                      # exact copies
    want = exact(rows, 5)
    got = search(llm_spark, rows, shard_rows=shards)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.95
    copies = next(q for q in want if q >= 1000)
    assert [j for _, j in got[copies]] == [j for j in range(1000, 1007) if j != copies][:5]        # ties: smaller ids


def test_ties_of_different_vectors_go_to_the_smaller_id(llm_spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=16)
    rows = [(i, (v * 2.0 ** p).tolist()) for i, p in enumerate(rng.permutation(np.arange(-50, 50)))]   # 100 multiples: equal cosines
    rows += [(1000 + i, rng.normal(size=16).tolist()) for i in range(400)]
    got = search(llm_spark, rows)
    assert [j for _, j in got[0]] == [1, 2, 3, 4, 5] and [j for _, j in got[50]] == [0, 1, 2, 3, 4]


def test_odd_vectors_take_no_part(llm_spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (50, [float("inf"), 1.0]),
            (6, [1.0, 2.0, 3.0]), (100, [0.0, 1e-200]), (7, [-1.0, 0.0]), (0, [1.0, 0.0]), (None, [1.0, 1.0])]
    got, want = search(llm_spark, rows), exact(rows, 5)
    assert {q: [j for _, j in v] for q, v in got.items()}[0] == [1, 100, 7]
    assert set(got) == {0, 100} == set(want)
    assert search(llm_spark, rows[2:4]) == {}


def test_pruning_drops_covered_candidates():
    unit = np.array([[1, 0], [0.999, 0.045], [0.995, 0.1], [0, 1]], np.float32)
    kept = robust_prune(unit, np.array([0]), np.array([[1, 2, 3, -1]]), 3, 1.0)[0].tolist()
    assert kept[0] == 1 and 2 not in kept
    edges, entry_node = build_graph(unit, 2, 4, 1.0, 1)
    assert edges.shape[0] == 5 and 0 <= entry_node < 4


def test_pipeline_stages_keep_columns_and_decide(llm_spark, make_docs, tmp_path):
    docs = llm_spark.read.parquet(f"{SF001}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(llm_spark, before, SF001)
        if name != "byte_bpe":
            assert after.columns == before.columns
            after.write.parquet(f"{tmp_path}/{name}")
            after = llm_spark.read.parquet(f"{tmp_path}/{name}")
            assert after.filter("n_chars <> length(text)").count() == 0
        if name in ("toxicity", "jaccard_join"):
            assert after.join(before, "doc_id", "left_anti").count() == 0 and after.count() < before.count()
        if name == "secret_scan":
            assert after.count() == before.count() and after.filter("text rlike 'token = \"[0-9a-f]{24}'").count() == 0
        before = after
    assert before.count() > 0 and "n_tokens" in before.columns


def test_near_duplicates_of_rows_without_or_with_equal_ids(llm_spark, make_docs):
    t = "one two three four five six seven eight"
    docs = make_docs([t, t, t, None, "", "another text of quite a few words", "another text of quite a few words"], ids=[5, 5, None, 9, None, None, None])
    rows = corpus_pipeline.jaccard_join(llm_spark, docs, "").collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in rows if r.doc_id is not None or r.text) == [
        (-1, "another text of quite a few words"), (-1, t), (5, t), (9, "")]


def test_near_duplicates_are_decided_by_id_and_text(llm_spark, make_docs):
    words = [f"word{i}" for i in range(60)]
    a, b, c = (" ".join(words[k:k + 20]) for k in (0, 20, 40))
    near = [a + " tail", a + " end", c + " tail"]
    # id 7: a copy of id 3, and two unrelated texts; without id: two near copies of a, and one class of its own
    texts, ids = [a, near[0], b, c, near[0], near[1], "no " + b[::-1], "no " + b[::-1] + " x"], [3, 7, 7, 7, None, None, None, None]
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(llm_spark, make_docs(texts, ids=ids), "").collect()]
    with_id = sorted(r for r in rows if r[0] is not None)
    assert with_id == sorted([(3, a), (7, b), (7, c)])
    without = [t for i, t in rows if i is None]
    assert len(without) == 2 and sum(t in near for t in without) == 1
    assert near[2] not in without


def test_all_queries_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(QUERIES) <= set(names)


@pytest.mark.parametrize("texts", [[], [None, None, None]])
def test_stages_take_empty_and_null_tables(make_docs, texts):
    docs = make_docs(texts) if texts else make_docs(["x"]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(docs.sparkSession, docs, SF001)
        if name != "byte_bpe":
            assert out.columns == docs.columns
            if name in ("toxicity", "jaccard_join", "secret_scan"):
                assert out.count() == len(texts), name
        else:
            assert [r["n_tokens"] for r in out.collect()] == [0] * len(texts)


def test_a_run_leaves_only_its_result(llm_spark):
    import os

    from adloom.session import checkpoint_dir
    root = checkpoint_dir(llm_spark).removeprefix("file:") + "/adloom-tables"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    out = corpus_pipeline.run(llm_spark, SF001)
    assert out.count() > 0 and len(set(os.listdir(root)) - before) == 1


def test_rejected_rows_are_told_by_id_and_text(make_docs, monkeypatch):
    from adloom.llm.toxicity import ToxicityModel
    monkeypatch.setattr(corpus_pipeline, "train_toxicity", lambda *_: ToxicityModel(-1.0, {"bad": 9.0}))
    docs = make_docs(["bad one", "fine", "fine", None, "bad one", None], ids=[1, 1, 2, None, None, 5])
    out = corpus_pipeline.toxicity(docs.sparkSession, docs, SF001)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == [("1", "fine"), ("2", "fine"), ("5", "None"), ("None", "None")]
