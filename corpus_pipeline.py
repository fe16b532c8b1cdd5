"""Corpus pipeline: quality, boilerplate lines, near-duplicates, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia.llm import decontaminate, line_dedup, near_dedup, quality_classifier, sentencepiece_codec
from brevia.llm.common import fresh, ready_checkpoints, remove, table
from brevia.llm.queries import LINE_LEAST, LINE_RATIO, learning_labels, model_path

#: Score below which the classifier rejects a document.
QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score under QUALITY.

    A null or empty text has the score of the bias alone. Rows that share an id are judged by
    their own texts. Columns stay as they are, one named `score` too; an empty table stays empty.
    """
    (name,) = fresh(docs, "score")
    weights = quality_classifier.fit(docs, learning_labels(spark, sf_dir))
    return quality_classifier.score(docs, weights, score_col=name).where(F.col(name) >= QUALITY).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that are boilerplate of a document's source; n_chars follows the text.

    Every row stays, and a text may become empty. A null text stays null, and its n_chars is
    null then; null sources are one site. Other columns stay as they are.
    """
    out = line_dedup.drop_boilerplate(docs, "source", "text", LINE_RATIO, LINE_LEAST, counts=None)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates: five-word shingles, similarity 0.8.

    Null, empty and wordless texts and rows with a null id are near to nothing and stay. Rows that
    share an id are one document: they stay or go together. Other columns stay as they are.
    """
    (gone,) = fresh(docs, "_gone")
    found = near_dedup.dedup(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col("doc_id") == F.col(gone), "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents out that hold a benchmark passage, edits included.

    Null and empty texts hold none. Rows that share an id, null included, go together.
    Columns stay as they are.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): token ids and the text decoded from them, a row for each of docs.

    A null text counts as empty: begin and end ids alone. Null and repeated ids stay as rows.
    """
    return sentencepiece_codec.round_trip(docs, model_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: Two stages learn or sketch, which SQL cannot express; a test holds stages 2 to 5 against plain Python, given the classifier's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages are tables in the shared checkpoint folder; each goes once the next is written."""
    ready_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
