"""The driver's tables seen as documents, passages, queries and commands of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.operators import chunking, fusion
from brevia.tables import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as forms: the first line is the title, codes repeat every 400 documents."""
    d = F.col("doc_id")
    code = F.concat(F.lit("FR-"), F.lpad((d % 400).cast("string"), 4, "0"))
    return table(spark, sf_dir, "documents").select(
        d.alias("doc"),
        F.concat(code, F.lit("."), F.col("lang"), F.lit("."), d.cast("string")).alias("id"),
        code.alias("code"),
        F.floor(d / 400).cast("int").alias("rev"),
        F.when(d % 3 == 0, "tr").otherwise("en").alias("lang"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.element_at(F.array(*map(F.lit, ("docx", "xlsx", "pdf", "doc", "zip"))), (d % 5 + 1).cast("int")).alias("ext"),
        F.col("text"),
    )


#: Numbers kept for the passages of a document.
ROOM = 64


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk, doc, ord, text): the documents' titled windows; chunk is doc * ROOM + ord."""
    return chunking.chunk(docs(spark, sf_dir)).select((F.col("doc") * ROOM + F.col("ord")).alias("chunk"), "doc", "ord", "text")


def vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """(unit, chunk, doc, vec): five vectors a document, one for each of its first passages; what is over goes to its last."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit"), F.floor(F.col("vec_id") / 5).alias("doc"), F.col("embedding").alias("vec"))
    last = chunks.groupBy("doc").agg(F.max("ord").alias("last"))
    return own.join(last, "doc").select("unit", (F.col("doc") * ROOM + F.least(F.col("unit") % 5, F.col("last"))).alias("chunk"), "doc", "vec")


def passage_corpus(spark: SparkSession, sf_dir: str) -> fusion.Corpus:
    """The documents as passages, which are written once: several lists read them."""
    chunks = saved(passages(spark, sf_dir))
    return fusion.corpus(docs(spark, sf_dir), chunks, vectors(spark, sf_dir, chunks))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query, vec): each benchmark text, every third led by a code, and a vector."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("q"))
    code = F.concat(F.lit("fr "), F.lpad((F.col("qid") % 400).cast("string"), 4, "0"), F.lit(" "))
    text = F.when(F.col("qid") % 3 == 0, F.concat(code, F.col("q"))).otherwise(F.col("q"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    return items.select("qid", text.alias("query")).join(vecs, "qid", "left")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, at, who, action, arg) from events: users whose number is a multiple of five are people."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in (("view", "open"), ("signup", "save"), ("click", "search"), ("error", "unsave"), ("purchase", "sort")) for x in pair]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("session"),
        F.col("event_id").alias("at"),
        F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("who"),
        kind.alias("action"),
        F.get_json_object("props", "$.k").alias("arg"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as listing rows: names with codes and revisions in several spellings."""
    d = F.col("doc_id")
    number = F.lpad((d % 400).cast("string"), 4, "0")
    ext = F.element_at(F.array(*map(F.lit, ("docx", "xlsx", "pdf", "doc", "zip"))), (d % 5 + 1).cast("int"))
    word = F.regexp_extract("text", "([A-Za-z]{3,})", 1)
    name = F.when(d % 2 == 0, F.concat(F.lit("FR-"), number, F.lit(" "), word, F.lit(" R"), (d % 4).cast("string"), F.lit("."), ext)).otherwise(F.concat(F.lit("FR-"), number, F.lit("_"), word, F.lit("_R2."), ext))
    folder = F.when(d % 7 == 0, "/haber/").when(d % 3 == 0, "/kalite/Formlar-%C4%B0ngilizce/").otherwise("/kalite/Formlar/")
    return table(spark, sf_dir, "documents").select(d.alias("pos"), F.concat(F.lit("/fileman"), folder, F.replace(name, F.lit(" "), F.lit("%20"))).alias("href"), F.concat(F.lit("FR "), number, F.lit(" "), word).alias("label"), "text")
