"""Hybrid search on small corpora with known scores."""

import pytest
from pyspark.sql import functions as F

from brevia.operators import fusion

# A small corpus whose scores are known.
DOCS = [(0, "FR-0083.tr", "FR-0083", "tr", "Danışman Değişikliği Formu"), (1, "FR-0336.tr", "FR-0336", "tr", "Staj Belgesi"), (2, "FR-0083.en", "FR-0083", "en", "Advisor Change Form")]
CHUNKS = [(0, 0, 0, "Danışman Değişikliği Formu tez danışmanı", [1.0, 0.0, 0.0]), (1, 1, 0, "Staj Belgesi zorunlu staj işletme", [0.0, 1.0, 0.0]), (2, 2, 0, "Advisor Change Form thesis", [0.0, 0.0, 1.0])]


def corpus(spark, docs=DOCS, chunks=CHUNKS):
    return fusion.corpus(
        spark.createDataFrame(docs, "doc long, id string, code string, lang string, title string"),
        spark.createDataFrame(chunks, "chunk long, doc long, ord int, text string, vec array<float>"),
    )


def run(spark, query, vec=None, sort="relevance", c=None):
    asked = spark.createDataFrame([(1, query, vec)], "qid int, query string, vec array<float>")
    return fusion.search(c or corpus(spark), asked, sort).orderBy("position").collect()


def scores(rows):
    return [(r.doc, round(r.score, 6), r.why) for r in rows]


def test_lexical_only(spark):
    assert scores(run(spark, "staj")) == [(1, 0.216393, "match")]


def test_dense_only_and_both(spark):
    assert scores(run(spark, "qqqq wwww", [0.0, 1.0, 0.0])) == [(1, 0.016393, "match"), (0, 0.016129, "match"), (2, 0.015873, "match")]
    assert scores(run(spark, "staj", [0.0, 1.0, 0.0])) == [(1, 0.232787, "match"), (0, 0.016129, "match"), (2, 0.015873, "match")]


def test_code_wins_and_bare_code_stops(spark):
    rows = run(spark, "FR-0083 staj belgesi")
    assert [(r.doc, r.why) for r in rows] == [(0, "code"), (2, "code"), (1, "match")]
    assert rows[0].score == float("inf") and rows[0].passages == [] and all(r.snippet for r in rows)
    for q in ("FR-0083", "fr 83", "0083"):
        assert [r.doc for r in run(spark, q, [0.0, 1.0, 0.0])] == [0, 2]


def test_suffixes_and_coverage(spark):
    assert 0 in [r.doc for r in run(spark, "danışmanlık")]
    assert scores(run(spark, "danışmanımı değiştirmek istiyorum")) == [(0, 0.216393, "match")]


def test_title_order_keeps_code_first(spark):
    assert [r.doc for r in run(spark, "FR-0336 danışman staj", sort="title")][0] == 1
    with pytest.raises(ValueError):
        run(spark, "staj", sort="size")


def test_many_passages_do_not_buy_rank(spark):
    docs = [*DOCS, (3, "FR-0744.tr", "FR-0744", "tr", "Sektör Stajı Protokolü"), (4, "FR-0751.tr", "FR-0751", "tr", "Zorunlu Staj Stajyeri Bilgi Formu")]
    zero = [0.0, 0.0, 0.0]
    chunks = [(*c[:4], zero) for c in CHUNKS] + [(3 + k, 3, k, "Sektör Stajı Protokolü zorunlu staj hükümleri madde", zero) for k in range(12)] + [(15, 4, 0, "Zorunlu Staj Stajyeri Bilgi Formu", zero)]
    assert scores(run(spark, "zorunlu staj", c=corpus(spark, docs, chunks))) == [(4, 0.216129, "match"), (1, 0.038616, "match"), (3, 0.015873, "match")]


def test_blank_query_and_empty_corpus(spark):
    assert run(spark, "   ") == []
    assert run(spark, "staj", c=corpus(spark, [], [])) == []


def test_resolve(spark):
    docs = corpus(spark).docs
    asked = spark.createDataFrame([("FR-0083",), ("FR-0083.en",), ("FR-9999",)], "needle string")
    assert {r.needle: r.doc for r in fusion.resolve(docs, asked).collect()} == {"FR-0083": 0, "FR-0083.en": 2}
