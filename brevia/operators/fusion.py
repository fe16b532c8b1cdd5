"""Hybrid search of a batch of queries: code hits, title coverage, BM25 and dense lists, fused by rank (O-34, O-40, O-44, O-45, O-55 to O-57, O-62, O-65, O-69 to O-76)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions import text as T
from brevia.tables import saved, sized

from . import dense, lexical

RRF, TITLE_WEIGHT = 60, 0.20
PASSAGES, PAGE = 3, 25
NO_CODE = "ZZ-9999"


@dataclass
class Corpus:
    """docs(doc, id, code, lang, title, ...), chunks(chunk, doc, ord, text[, vec]) and the statistics of both fields.

    vectors(unit, chunk, doc, vec), if given, are searched in place of the vec of chunks: a passage may have several.
    """

    docs: DataFrame
    chunks: DataFrame
    body: lexical.Field
    title: lexical.Field
    vectors: DataFrame | None = None


def corpus(docs: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None) -> Corpus:
    return Corpus(docs, chunks, lexical.field(chunks, "chunk", "text", keep=True), lexical.field(docs, "doc", "title", keep=True), vectors)


def with_codes(queries: DataFrame) -> DataFrame:
    """queries (qid, query[, vec]) with tokens and code; blank queries are left out."""
    return queries.where(T.trim(F.col("query")) != "").withColumn("tokens", T.tokenize(F.col("query"))).withColumn("code", T.find_code(F.col("query")))


def code_hits(docs: DataFrame, coded: DataFrame) -> DataFrame:
    """(qid, doc) of the documents that have a query's code, in any language."""
    return coded.where("code is not null").select("qid", "code").join(docs.select("doc", "code"), "code").select("qid", "doc")


def best_ranks(ranked: DataFrame) -> DataFrame:
    """(qid, doc, rank): a document counts with its best passage in a list."""
    return ranked.groupBy("qid", "doc").agg(F.min("rank").alias("rank"))


def contribution(rank="rank"):
    return 1.0 / (RRF + F.col(rank) + 1)


def fused(*parts: DataFrame) -> DataFrame:
    """(qid, doc, score): sum of the parts (qid, doc, score)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("qid", "doc").agg(F.sum("score").alias("score"))


def passage_lists(c: Corpus, terms: DataFrame, open_: DataFrame) -> DataFrame:
    """(qid, doc, unit, rank, list) of the passages in the BM25 list (1) and, where queries and passages have vectors, the dense list (2)."""
    where = c.chunks.select(F.col("chunk").alias("unit"), "doc")
    ranked = lexical.ranked(c.body, terms).join(where, "unit").select("qid", "doc", "unit", "rank", F.lit(1).alias("list"))
    if "vec" not in open_.columns:
        return ranked
    if c.vectors is not None:
        near = dense.dense_ranked(c.vectors.select("unit", "vec"), open_).join(c.vectors.select("unit", "chunk", "doc"), "unit")
        near = near.groupBy("qid", "doc", F.col("chunk").alias("unit")).agg(F.min("rank").alias("rank"))
    elif "vec" in c.chunks.columns:
        near = dense.dense_ranked(c.chunks.select(F.col("chunk").alias("unit"), "vec"), open_).join(where, "unit")
    else:
        return ranked
    return ranked.unionByName(near.select("qid", "doc", "unit", "rank", F.lit(2).alias("list")))


@dataclass
class Candidates:
    """hits(qid, doc) by code; titles(qid, doc) and ranked(qid, doc, unit, rank, list), the lists; scores(qid, doc, score), fused."""

    hits: DataFrame
    titles: DataFrame
    ranked: DataFrame
    scores: DataFrame


def candidates(c: Corpus, queries: DataFrame) -> Candidates:
    """What the lists find for each query that is not just the code of a document.

    Lists are written to the shared folder: they are short, and several parts of a page read them.
    """
    coded = with_codes(queries)
    hits = saved(code_hits(c.docs, coded))
    only = coded.join(hits.select("qid").distinct(), "qid", "left_semi").where(T.bare_code(F.col("tokens"), F.col("code"))).select("qid")
    open_ = coded.join(only, "qid", "left_anti")
    terms = saved(lexical.query_terms(open_))
    titles = saved(lexical.ranked(c.title, terms).select("qid", F.col("unit").alias("doc")))
    covered = lexical.coverage(c.title, terms, titles.withColumnRenamed("doc", "unit")).withColumnRenamed("unit", "doc")
    ranked = saved(passage_lists(c, terms, open_))
    by_list = ranked.groupBy("qid", "doc", "list").agg(F.min("rank").alias("rank")).select("qid", "doc", contribution().alias("score"))
    return Candidates(hits, titles, ranked, fused(covered.select("qid", "doc", (TITLE_WEIGHT * F.col("coverage") * F.col("coverage")).alias("score")), by_list))


def search(c: Corpus, queries: DataFrame, sort: str = "relevance", limit: int = PAGE) -> DataFrame:
    """(qid, position, doc, score, why, snippet, passages) of each query's page.

    Documents with the query's code come first, with infinite score and no passages; a query that
    is only its code gets nothing else. Others are ordered by fused score, then doc. code and title
    order sort all candidates before the page is cut. Without `vec` the dense list is left out.
    """
    if sort not in ("relevance", "code", "title"):
        raise ValueError(f"unknown sort order {sort!r}")
    lists = candidates(c, queries)
    hits, titles, ranked, scores = lists.hits, lists.titles, lists.ranked, lists.scores
    rest = scores.join(hits, ["qid", "doc"], "left_anti")
    every = hits.select("qid", "doc", F.lit(float("inf")).alias("score"), F.lit("code").alias("why")).unionByName(rest.withColumn("why", F.lit("match")))

    named = every.join(c.docs.select("doc", "code", "title"), "doc")
    first = [F.when(F.col("why") == "code", 0).otherwise(1)]
    relevance = [F.desc(F.round("score", 9)), "doc"]
    if sort == "code":
        first += [F.coalesce("code", F.lit(NO_CODE))]
    elif sort == "title":
        first += [T.tokenize(F.col("title"))]
    page = named.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(*first, *relevance))).where(F.col("position") <= limit)
    page = saved(page.select("qid", "position", "doc", "score", "why"))

    shown = top_passages(ranked, titles, c.chunks, page.where("why = 'match'").select("qid", "doc"))
    heads = c.chunks.join(sized(page.select("doc").distinct()), "doc", "left_semi").groupBy("doc").agg(F.min_by("text", "chunk").alias("head"))
    empty = F.array().cast("array<string>")
    out = page.join(shown, ["qid", "doc"], "left").join(heads, "doc", "left").join(c.docs.select("doc", "title"), "doc")
    return out.select("qid", "position", "doc", "score", "why", F.coalesce(F.get("passages", F.lit(0)), "head", "title").alias("snippet"), F.coalesce("passages", empty).alias("passages"))


def top_passages(ranked: DataFrame, titles: DataFrame, chunks: DataFrame, wanted: DataFrame, most: int = PASSAGES) -> DataFrame:
    """(qid, doc, passages): best passages of each wanted document by the sum of their list contributions.

    A title candidate's first passage takes part with 0; ties go to titles, then body ranks, then dense ranks.
    """
    heads = chunks.groupBy("doc").agg(F.min("chunk").alias("unit"))
    seeds = titles.join(heads, "doc").select("qid", "doc", "unit", F.lit(0.0).alias("part"), F.lit(0).alias("list"), F.lit(0).alias("rank"))
    parts = ranked.select("qid", "doc", "unit", contribution().alias("part"), "list", "rank").unionByName(seeds).join(wanted, ["qid", "doc"], "left_semi")
    summed = parts.groupBy("qid", "doc", "unit").agg(F.sum("part").alias("part"), F.min(F.struct("list", "rank")).alias("seq"))
    order = Window.partitionBy("qid", "doc").orderBy(F.desc(F.round("part", 9)), "seq")
    best = saved(summed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most))
    texts = sized(best).join(chunks.select(F.col("chunk").alias("unit"), "text"), "unit")
    return texts.groupBy("qid", "doc").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]).alias("passages"))


def resolve(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, doc): the document of that id, else of the needle's code, Turkish first, then the first (O-49)."""
    wanted = needles.select("needle", T.trim(F.col("needle")).alias("id"), T.find_code(F.col("needle")).alias("code")).distinct()
    ids = docs.groupBy("id").agg(F.min("doc").alias("exact"))
    place = F.struct(F.when(F.col("lang") == "tr", 0).otherwise(1).alias("b"), "doc")
    codes = sized(docs.groupBy("code").agg(F.min(place).alias("first")))  # one row a code: copies of a code never meet the needles
    found = wanted.join(ids, "id", "left").join(codes, "code", "left").select("needle", F.coalesce("exact", "first.doc").alias("doc"))
    return found.where("doc is not null")
