"""What tasks keep of each query's best, against sorting everything."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brevia.operators import best, chunking, lexical


@pytest.mark.parametrize("seed", range(6))
def test_best_keeps_what_counts(seed):
    rnd = np.random.default_rng(seed)
    scores = rnd.choice([0.1, 0.2, 0.2 + 4e-10, 0.3, 0.5], (4, 3000)) if seed % 2 else np.round(rnd.random((4, 3000)), 3)
    units = rnd.permutation(3000)
    found = best.Best(4, 50)
    for k in range(0, 3000, 170):
        found.add(units[k : k + 170], scores[:, k : k + 170])
    got: dict = {q: [] for q in range(4)}
    for b in found.batches(pa.array(range(4)), pa.int64()):
        for q, u, s in zip(*(c.to_pylist() for c in b.columns)):
            got[q].append((-round(s, 9), u))
    for q in range(4):
        assert sorted(got[q])[:50] == sorted((-round(s, 9), int(u)) for s, u in zip(scores[q].tolist(), units.tolist()))[:50]
        assert len(got[q]) < 1000


def test_equal_strings_keep_the_lowest():
    found = best.Best(1, 2)
    for k in range(9, 0, -1):
        found.add(best.ids(pa.array([f"u{k}", f"ü{k}"])), np.ones((1, 2)))
    (b,) = found.batches(pa.array(["q"]), pa.string())
    assert {"u1", "u2"} <= set(b.column("unit").to_pylist())


@pytest.mark.parametrize("block", [256, 3])
def test_ranked_is_the_top_of_bm25(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "POSTINGS", 7)
    texts = [("u%02d" % k, " ".join("abc"[(k * j) % 3] * 2 + str(j % (k + 2)) for j in range(k % 13)) or None) for k in range(60)]
    f = lexical.field(spark.createDataFrame(texts, "unit string, text string").repartition(3), "unit", "text", keep=True)
    queries = spark.createDataFrame([(q, f"aa{q} bb1 bb{q % 3} zz") for q in range(10)] + [(10, "zz"), (11, "")], "qid int, query string")
    terms = lexical.query_terms(queries)
    some = lexical.ranked(f, terms, 5).select("qid", "unit", F.round("score", 8).alias("s"), "rank").collect()
    every = lexical.top(lexical.bm25(f, terms).where("score > 0"), 5).select("qid", "unit", F.round("score", 8).alias("s"), "rank").collect()
    assert sorted(some) == sorted(every) and len(some) > 30
    assert lexical.ranked(f, terms.where("qid = 11"), 5).count() == 0


def test_tasks_take_few_texts_at_once():
    texts = ["a b " * 40_000, "", "b"] + ["a c"] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([len(t.split()) for t in texts], pa.int32()), pa.array([" ".join(t.split()) for t in texts])], names=["unit", "len", "words"])
    whole = pa.Table.from_batches([batch] * 8).combine_chunks().to_batches()[0]
    parts = list(lexical._slices(whole))
    assert sum(p.num_rows for p in parts) == whole.num_rows and max(sum(p.column("len").to_pylist()) for p in parts) <= lexical.TOKENS
    row, term, tf = lexical._postings(batch, pa.array(["b", "c"]))
    assert list(zip(row.tolist(), term.tolist(), tf.tolist())) == [(0, 0, 40_000), (2, 0, 1)] + [(k, 1, 1) for k in range(3, 303)]


def test_passages_leave_in_small_batches():
    texts = ["x" * 20_000 + str(k) for k in range(400)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(401)), pa.array(["T"] * 401), pa.array(texts)], names=["doc", "title", "body"])
    out = list(chunking.cut(iter([batch, batch])))
    assert max(b.nbytes for b in out) < 2 * chunking.CHARS
    got = [(r["doc"], r["ord"], r["text"]) for b in out for r in b.to_pylist()]
    assert got == 2 * [(k, n, p) for k, t in enumerate(texts) for n, p in enumerate(chunking.passages("T", t or ""))]


@pytest.mark.parametrize("common", [1, 3, 99])
def test_common_and_rare_terms_give_the_same_scores(monkeypatch, common):
    monkeypatch.setattr(lexical, "COMMON", common)
    rnd = random.Random(6)
    asked = [(f"t{t}", q, rnd.random()) for q in range(9) for t in range(12) if rnd.random() < (0.9 if t < 3 else 0.2)]
    w = lexical._Weights(pa.table({"term": [a[0] for a in asked], "qid": [a[1] for a in asked], "w": [a[2] for a in asked]}))
    row, term, value = (np.array(x) for x in zip(*[(r, t, rnd.random()) for r in range(5) for t in range(len(w.vocabulary)) if rnd.random() < 0.5]))
    expected = np.zeros((len(w.qids), 5))
    for t, q, x in asked:
        at = term == w.vocabulary.to_pylist().index(t)
        np.add.at(expected[w.qids.to_pylist().index(q)], row[at], x * value[at])
    assert np.allclose(w.scores(row, term, value, 5), expected, atol=1e-12)
