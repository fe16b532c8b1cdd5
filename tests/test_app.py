"""Verbs of a session, and what callers see."""

import pytest

from brevia import app
from brevia.operators import fusion

DOCS = [(0, "AB-0001.tr", "AB-0001", "tr", "Araç İzin Belgesi", "gövde"), (1, "AB-0002.tr", "AB-0002", "tr", "Kütüphane Kartı", ""), (2, "AB-0001.en", "AB-0001", "en", "Vehicle Permit", None)]
KIND = "doc long, id string, code string, lang string, title string, text string"


@pytest.fixture(scope="module")
def session(spark):
    docs = spark.createDataFrame(DOCS, KIND)
    chunks = spark.createDataFrame([(d, d, 0, t) for d, _, _, _, t, _ in DOCS], "chunk long, doc long, ord int, text string")
    return app.Session(spark, fusion.corpus(docs, chunks))


def test_verbs(session):
    found = session.search(" kütüphane ")
    assert [(r.id, r.why, r.title_only, r.saved) for r in found] == [("AB-0002.tr", "match", True, False)]
    assert session.search("AB-0002", who="a1", limit=5)[0].score == 1.0 and session.state["open"] == "AB-0002.tr" and session.state["searched_by"] == "a1"
    assert session.open("ab 01")[1][1:] == ("signal", None, "doc.opened", "AB-0001.tr") and session.state["open"] == "AB-0001.tr"
    assert session.save("AB-0001.en") and session.save("AB-0002") and session.save("AB-0002") == []
    assert [r.id for r in session.saved()] == ["AB-0001.en", "AB-0002.tr"]
    with pytest.raises(LookupError, match="not in the saved list"):
        session.unsave("AB-0001.tr")
    session.unsave("AB-0001.en", who="a1")
    with pytest.raises(LookupError, match="no form matches"):
        session.open("ZZ-1234")
    with pytest.raises(ValueError):
        session.sort("size")
    assert [r.id for r in session.sort("kod")] == ["AB-0002.tr"] and session.get("AB-0001") == "gövde"
    status = session.status()
    assert status["title"] == "“AB-0002” — 1 sonuç" and [x[2] for x in status["log"]] == ["search", "search", "open", "save", "save", "unsave", "search", "sort"]
    assert session.search("  ") == [] and session.status()["title"] == ""


def test_page_size():
    assert app.page_size(["a", "-n", "5", "b"]) == (["a", "b"], 5)
    assert app.page_size(["a", "-n", "x"], 7) == (["a", "-n", "x"], 7) and app.page_size(["-n"], 7) == (["-n"], 7)


def test_provision(spark):
    ready, absent = ("ready", None), ("absent", None)
    assert app.provision_summary(ready, ready) == "ready" and app.provision_summary(absent, ready).startswith("not provisioned")
    assert app.provision_summary(("failed", "a"), ("failed", "b")) == "provisioning failed: b"
    assert app.provision_summary(("downloading", 3), ("downloading", 4)) == "downloading the model — 3%"
    expected = spark.createDataFrame([("a", 10), ("b", 4)], "name string, size long")
    for size, there in ((5, True), (4, False)):
        assert app.model_present(spark.createDataFrame([("a", size), ("b", 2)], "name string, size long"), expected) is there
    assert app.model_present(spark.createDataFrame([("a", 10)], "name string, size long"), expected) is False
