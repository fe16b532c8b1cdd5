"""Verbs of one interactive session over a corpus, and the rows that callers see (O-31 to O-33, O-37, O-39, O-61, verbs of 2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.functions import text as T
from brevia.operators import fusion
from brevia.sources import index_store
from brevia.streaming import session_stream

FIELDS = ("id", "code", "rev", "lang", "title", "name", "ext", "url")


def rows(docs: DataFrame, hits: DataFrame | None = None, saved: DataFrame | None = None) -> DataFrame:
    """Documents as callers see them: FIELDS that docs has, title_only, saved, score, why, snippet and passages.

    hits: rows of fusion.search(), whose qid and position stay; without them every document is
    shown with null score, why and snippet and no passages. saved(id): the saved list. A code hit
    scores 1.0; a document whose text is empty is title_only.
    """
    known = [F.col(c) for c in FIELDS if c in docs.columns]
    has_text = F.coalesce(F.char_length("text"), F.lit(0)) > 0 if "text" in docs.columns else F.lit(True)
    out = docs.select("doc", *known, (~has_text).alias("title_only"))
    if saved is None:
        out = out.withColumn("saved", F.lit(False))
    else:
        out = out.join(saved.select("id", F.lit(True).alias("saved")).distinct(), "id", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))
    if hits is None:
        return out.select("*", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("why"), F.lit(None).cast("string").alias("snippet"), F.array().cast("array<string>").alias("passages"))
    score = F.when(F.col("why") == "code", 1.0).otherwise(F.col("score")).alias("score")
    return out.join(hits.select("qid", "position", "doc", score, "why", "snippet", F.coalesce("passages", F.array().cast("array<string>")).alias("passages")), "doc")


def provision_summary(model: tuple[str, object], index: tuple[str, object]) -> str:
    """One sentence on two stages, each ("ready", None), ("failed", reason), ("downloading", percent) or ("absent", None)."""
    if model[0] == index[0] == "ready":
        return "ready"
    for stage in (index, model):
        if stage[0] == "failed":
            return f"provisioning failed: {stage[1]}"
    for name, stage in (("model", model), ("index", index)):
        if stage[0] == "downloading":
            return f"downloading the {name} — {stage[1]}%"
    return "not provisioned yet"


def model_present(files: DataFrame, expected: DataFrame) -> bool:
    """Whether every expected(name, size) is among files(name, size) with at least half its size."""
    found = expected.join(files.select("name", F.col("size").alias("there")), "name", "left")
    return bool(found.select(F.bool_and(F.coalesce(F.col("there") >= F.col("size") / 2, F.lit(False)))).first()[0])


def page_size(words: list[str], default: int = fusion.PAGE) -> tuple[list[str], int]:
    """(query words, limit): the first `-n` or `--number` before a whole number is taken out of the words."""
    for k, word in enumerate(words[:-1]):
        if word in ("-n", "--number"):
            return (words[:k] + words[k + 2 :], int(words[k + 1])) if words[k + 1].isdecimal() else (words, default)
    return words, default


class Session:
    """search, sort, open, get, save, unsave, saved and status on one corpus; `who` is None for the human.

    docs needs the columns of fusion.Corpus.docs; embed(query) gives a vector or None.
    """

    def __init__(self, spark: SparkSession, corpus: fusion.Corpus, embed=lambda query: None, page: int = fusion.PAGE):
        self.spark, self.corpus, self.embed, self.page = spark, corpus, embed, page
        self.state, self.hits = session_stream.empty(), None

    def search(self, query: str, who: str | None = None, limit: int | None = None) -> list:
        session_stream.reduce(self.state, who, "begin", query)
        self.page = limit or self.page
        self._find()
        found = [] if self.hits is None else self.hits.collect()
        alone = found[0].doc if len(found) == 1 and found[0].why == "code" else None
        session_stream.reduce(self.state, who, "search", query, None if alone is None else self._id(alone))
        return self.results()

    def sort(self, name: str, who: str | None = None) -> list:
        order = self.spark.range(1).select(T.sort_name(F.lit(name)).alias("s")).first().s
        if order is None:
            raise ValueError("sort by relevance, code or title")
        session_stream.reduce(self.state, who, "sort", order)
        self._find()
        return self.results()

    def open(self, needle: str, who: str | None = None) -> list:
        return session_stream.reduce(self.state, who, "open", self._resolved(needle))

    def save(self, needle: str, who: str | None = None) -> list:
        return session_stream.reduce(self.state, who, "save", self._resolved(needle))

    def unsave(self, needle: str, who: str | None = None) -> list:
        out = session_stream.reduce(self.state, who, "unsave", self._resolved(needle))
        if out[0][1] == "error":
            raise LookupError(out[0][4])
        return out

    def get(self, needle: str) -> str:
        return index_store.form_text(self.corpus.docs, self._resolved(needle))

    def results(self) -> list:
        return [] if self.hits is None else rows(self.corpus.docs, self.hits, self._saved()).orderBy("position").collect()

    def saved(self) -> list:
        """Saved documents in the order of saving; ids that the corpus lacks are left out."""
        place = {x: k for k, x in enumerate(self.state["saved"])}
        found = rows(self.corpus.docs, None, self._saved()).where("saved").collect()  # the session's own list
        return sorted(found, key=lambda r: place[r.id])

    def status(self) -> dict:
        """State and log; every list is there, empty if need be."""
        title = f"“{self.state['query']}” — {len(self.results())} sonuç" if self.state["query"] else ""
        return self.state | {"title": title, "terms": self._terms(self.state["query"])}

    def _find(self) -> None:
        query = self.state["query"]
        if not query:
            self.hits = None
            return
        vec = self.embed(query)
        asked = self.spark.createDataFrame([(0, query)] if vec is None else [(0, query, vec)], "qid int, query string" + ("" if vec is None else ", vec array<double>"))
        self.hits = fusion.search(self.corpus, asked, self.state["sort"], self.page)

    def _terms(self, query: str) -> list[str]:
        return list(self.spark.range(1).select(T.tokenize(F.lit(query)).alias("t")).first().t)

    def _saved(self) -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in self.state["saved"]], "id string")

    def _id(self, doc) -> str:
        return self.corpus.docs.where(F.col("doc") == doc).select("id").first().id

    def _resolved(self, needle: str) -> str:
        found = fusion.resolve(self.corpus.docs, self.spark.createDataFrame([(needle,)], "needle string")).first()
        if found is None:
            raise LookupError(f"no form matches `{needle}`; search for it")
        return self._id(found.doc)
