"""Queries over whole inputs against brute force, on rows where what lies late or far counts."""

import random
import re

from pyspark.sql import functions as F

from brevia.functions import text as T
from brevia.operators import dense
from brevia.plans import bindings, catalogue

LONG = ["x " * 400 + "The codes: FR 0083, that is late; thentic", "word " * 30_000 + "de AB-12", "the " * 5 + "of" * 300, "", "12", None]


def documents(spark, path, texts):
    spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_marks_of_whole_texts(spark, tmp_path):
    rows = {r.doc_id: r.n_match for r in catalogue.QUERIES["match_terms"](spark, documents(spark, tmp_path, LONG)).collect()}
    hit = lambda w: w.lower() in ("the", "that", "de") or w.lower().startswith("thent")
    assert [rows[k] for k in range(5)] == [sum(map(hit, re.findall(r"\w+", t))) for t in LONG[:5]] == [3, 1, 5, 0, 0]


def test_codes_of_whole_texts(spark, tmp_path):
    rows = {r.doc_id: r.code for r in catalogue.QUERIES["find_code"](spark, documents(spark, tmp_path, LONG)).collect()}
    assert [rows[k] for k in range(6)] == ["FR-0000", "AB-0012", None, None, "FR-0012", "FR-0005"]
    late = spark.createDataFrame([(k, t) for k, t in enumerate(LONG)], "k int, t string").select("k", T.find_code(F.col("t")).alias("code")).collect()
    assert [r.code for r in sorted(late)] == ["FR-0083", "AB-0012", None, None, "FR-0012", None]


def test_marks_join_like_one_by_one(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["the", "a", "thentics", " ", ", ", "b1"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", T.marks(F.col("t"), F.array(F.lit("the"), F.lit("thent"))).alias("m")).collect()
    for r in got:
        expected = []
        for run in re.findall(r"\w+|\W+", texts[r.k]):
            match = run == "the" or run.startswith("thent")
            if expected and not match and not expected[-1][1]:
                expected[-1] = (expected[-1][0] + run, False)
            else:
                expected.append((run, match))
        assert [tuple(x) for x in r.m] == expected


def test_every_twentieth_vector_is_asked(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    vectors = [[rnd.uniform(-1, 1) for _ in range(3)] for _ in range(230)]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    expected = {}
    for q in range(0, 230, 20):
        scored = sorted((-round(sum(x * y for x, y in zip(vectors[q], v)), 9), k) for k, v in enumerate(vectors))
        expected |= {(q, rank): k for rank, (_, k) in enumerate(scored[:200])}
    for block in (dense.BLOCK_BYTES, 5 * 3 * 8):
        monkeypatch.setattr(dense, "BLOCK_BYTES", block)
        rows = catalogue.QUERIES["dense_topk"](spark, str(tmp_path)).collect()
        assert len(rows) == 12 * 200 and {(r.qid, r["rank"]): r.unit for r in rows} == expected


def test_queries_are_whole_texts(spark, sf):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {r.qid: r.query for r in bindings.queries(spark, sf).collect()}
    assert got == {k: f"fr {k % 400:04d} {t}" if k % 3 == 0 else t for k, t in texts.items()}
    assert min(map(len, texts.values())) > 40


def test_late_query_terms_count(spark, tmp_path):
    late = "a b c d e f g h i j k l m n o p q r s t u v w x y z quince"
    documents(spark, tmp_path, ["nothing", "one quince here"])
    spark.createDataFrame([(1, late)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r.doc_id for r in catalogue.QUERIES["bm25_topk"](spark, str(tmp_path)).collect()] == [1]
    assert [(r.doc, r.coverage) for r in catalogue.QUERIES["title_coverage"](spark, str(tmp_path)).collect()] == [(1, 1.0)]


def test_passages_of_long_documents(spark, sf):
    c = bindings.passage_corpus(spark, sf)
    per = {r.doc: r.n for r in c.chunks.groupBy("doc").agg(F.count("*").alias("n")).collect()}
    assert max(per.values()) > 4 and max(r.n for r in c.chunks.select(F.char_length("text").alias("n")).collect()) <= 900 + 81
    found = c.vectors.select("unit", "doc", "chunk").collect()
    assert len(found) == spark.read.parquet(f"{sf}/embeddings.parquet").where(F.floor(F.col("vec_id") / 5).isin(list(per))).count()
    assert all(r.doc == r.unit // 5 == r.chunk // bindings.ROOM and r.chunk % bindings.ROOM == min(r.unit % 5, per[r.doc] - 1) for r in found)
    rows = catalogue.QUERIES["passages_top3"](spark, sf).collect()
    assert {r.n for r in rows} >= {2, 3} and max(r.n for r in rows) == 3
    spark.catalog.clearCache()
