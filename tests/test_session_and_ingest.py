"""Session log, saved set, streaming twin, ingest."""

import unicodedata

from pyspark.sql import functions as F

from brevia.operators import ingest, session
from brevia.streaming import session_stream as S

SCHEMA = "session string, at long, who string, action string, arg string"


def commands(spark, rows):
    return spark.createDataFrame([("s", k, *r) for k, r in enumerate(rows)], SCHEMA)


def test_log_is_bounded_and_skips_what_changes_nothing(spark):
    c = commands(spark, [(None, "search", f"q{k}") for k in range(65)] + [(None, "search", " "), (None, "save", "a"), (None, "save", "a")])
    log = session.activity(c).orderBy("seq").collect()
    assert len(log) == 40 and log[-1].action == "save" and log[-1].seq == 66


def test_signals_and_saved(spark):
    c = commands(spark, [(None, "open", "x"), ("a1", "open", "x"), (None, "save", "x"), (None, "save", "y"), ("a1", "unsave", "x")])
    assert [r.signal for r in session.signals(c).orderBy("at").collect()] == ["doc.opened", "saved.changed", "saved.changed"]
    assert [(r.id, r.pos) for r in session.saved_set(c).collect()] == [("y", 1)]


def test_only_what_takes_effect(spark):
    rows = [(None, "save", "d1"), (None, "open", "d1"), (None, "save", "d1"), (None, "unsave", "d2"), (None, "sort", "title"), ("a1", "search", " staj "), (None, "sort", "code"), (None, "search", "  "), (None, "sort", "title"), (None, "unsave", "d1"), (None, "unsave", "d1"), (None, "save", "d1")]
    c = commands(spark, rows)
    log = [(r.seq, r.who, r.action, r.detail) for r in session.activity(c).orderBy("seq").collect()]
    assert log == [(1, None, "save", "d1"), (2, None, "open", "d1"), (3, None, "sort", "title"), (4, "a1", "search", "staj"), (5, None, "search", "staj"), (6, None, "sort", "code"), (7, None, "sort", "title"), (8, None, "unsave", "d1"), (9, None, "save", "d1")]
    assert [(r.at, r.signal) for r in session.signals(c).orderBy("at").collect()] == [(0, "saved.changed"), (1, "doc.opened"), (9, "saved.changed"), (11, "saved.changed")]
    assert [(r.id, r.pos) for r in session.saved_set(c).collect()] == [("d1", 1)]
    state, expected = S.empty(), []
    for who, action, arg in rows:
        expected += [x for x in S.reduce(state, who, action, arg)]
    assert [(seq, who, a, d) for seq, kind, who, a, d in expected if kind == "activity"] == log
    assert [x[3:] for x in expected if x[1] == "error"] == [("unsave", "d2 is not in the saved list"), ("unsave", "d1 is not in the saved list")]


def test_resolved(spark):
    docs = spark.createDataFrame([(0, "FR-0083.tr", "FR-0083", "tr"), (1, "FR-0083.en", "FR-0083", "en")], "doc long, id string, code string, lang string")
    c = commands(spark, [(None, "open", "fr 83"), (None, "save", "FR-0083.en"), (None, "open", "FR-9999"), (None, "search", "FR-9999"), (None, "save", None)])
    got = session.resolved(c, docs)
    assert [(r.action, r.arg) for r in got.orderBy("at").collect()] == [("open", "FR-0083.tr"), ("save", "FR-0083.en"), ("search", "FR-9999")]
    saved = session.saved_docs(session.saved_set(got).unionByName(spark.createDataFrame([("s", "gone", 2)], "session string, id string, pos int")), docs)
    assert [(r.id, r.doc, r.pos) for r in saved.collect()] == [("FR-0083.en", 1, 1)]


def test_reducer():
    state = S.empty()
    S.reduce(state, "a1", "begin", " FR-0083 ")
    assert state["searching"] and state["query"] == "FR-0083" and state["searched_by"] == "a1"
    assert S.reduce(state, None, "search", "FR-0083", "d") and state["open"] == "d" and not state["searching"]
    assert S.reduce(state, None, "save", "d")[-1][3] == "saved.changed" and S.reduce(state, None, "save", "d") == []
    assert S.reduce(state, "a1", "unsave", "z")[0][1] == "error"
    assert [(r[0], r[3]) for r in S.reduce(state, "a1", "sort", "title")] == [(3, "search"), (4, "sort")]
    assert S.reduce(state, None, "attach", None) == [] and state["open"] is None and state["saved"] == ["d"]


def test_stream_equals_reducer(spark, tmp_path):
    rows = [("s", k, "a1" if k % 3 else None, ("search", "open", "save", "unsave", "sort")[k % 5], f"d{k % 4}", "d9" if k == 25 else None) for k in range(30)]
    kind = "session string, seq long, who string, action string, arg string, hit string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    q = S.session_stream(stream).writeStream.format("memory").queryName("session_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    state, expected = S.empty(), []
    for _, _, who, action, arg, hit in rows:
        expected += S.reduce(state, who, action, arg, hit)
    got = [(r.seq, r.kind, r.who, r.action, r.detail) for r in spark.table("session_rows").collect()]
    assert got == expected
    log = [r[0] for r in got if r[1] == "activity"]
    assert log == sorted(set(log)) and len(log) > 30


def test_listing(spark):
    html = '<a href="/fileman/kalite/Formlar/FR-0001%20Ad%20R2.docx"><b>FR-0001</b>&nbsp;Ad</a><a href=\'/fileman/x.pdf\'>no</a><A class="k" HREF = "https://h/fileman/a+b%20c%.PDF">\n x </A>'
    links = ingest.parse_listing(spark.createDataFrame([(1, html)], "page_id long, html string"))
    rows = ingest.listing_columns(links, "https://h.example").orderBy("pos").collect()
    assert [(r.name, r.ext, r.lang, r.code, r.rev, r.title, r.label) for r in rows] == [("FR-0001 Ad R2.docx", "docx", "tr", "FR-0001", 2, "Ad", "FR-0001 Ad"), ("a+b c%.PDF", "pdf", None, None, 0, "a+b c%", "x")]
    assert [r.url for r in rows] == ["https://h.example/fileman/kalite/Formlar/FR-0001 Ad R2.docx", "https://h/fileman/a+b c%.PDF"]


def test_revisions(spark):
    rows = spark.createDataFrame([(0, "A-1", "n0", "tr", 1, "doc"), (1, "A-1", "n1", "tr", 2, "pdf"), (2, "A-1", "n2", "tr", 2, "docx"), (3, "A-1", "n3", "en", 0, "pdf"), (4, None, "n4", "tr", 0, "pdf")], "pos int, code string, name string, lang string, rev int, ext string")
    got = {r.pos: r.superseded for r in ingest.best_revision(rows).collect()}
    assert got == {0: "superseded by R2 (n2)", 1: "duplicate of n2", 2: None, 3: None, 4: None}


def test_clean_text(spark):
    (row,) = spark.createDataFrame([("a\xa0 b\r\n\n \n c é ",)], "t string").select(ingest.clean_text(F.col("t"))).collect()
    assert row[0] == "a b\nc \xe9"


def test_composed_without_python(spark):
    texts = ["é", "각", "क़", "Å ﬁ", "ạ̇", "\U0001d15e", "", None]
    out = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", ingest.composed(F.col("t")).alias("c"))
    assert [r.c for r in out.orderBy("k").collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
