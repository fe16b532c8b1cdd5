"""Operator: quality classifier, a logistic regression over hashed word n-grams.

Tokens are runs of letters and digits, or of punctuation. Their uni- and bigrams are
hashed into a weight table; a text's value of a feature is its count over the square
root of all counts, so a score is a sparse dot product. Training follows the
regularised leader, one labelled text after another, in one task over a sample of at
most `most` labelled rows; scoring reads every text once on the map side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: Weights; labelled rows that training reads at most; learning rate, smoothing, L1 and L2 of the leader.
BITS, MOST = 18, 8000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1.0


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, index) of every n-gram of a column's texts, and the n-grams of each text."""
    w = words.words(column, words.SHAPES)
    pairs = words.ngrams(w.hash, 2)
    same = w.doc[1:] == w.doc[:-1]
    doc = np.concatenate([w.doc, w.doc[1:][same]])
    index = np.concatenate([w.hash, pairs[same]]) >> np.uint64(64 - bits)
    return doc, index.astype(np.int64), np.bincount(doc, minlength=len(column))


def learn(rows, bits: int = BITS) -> np.ndarray:
    """Weights, the bias last, from an iterator of (indices, counts, label)."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for index, count, label in rows:
        i = np.append(index, bias)
        x = np.append(count / np.sqrt(max(count.sum(), 1)), 1.0)
        w = weights(i)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
        z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
        n[i] += g * g
    return weights(np.arange(bias + 1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST, bits: int = BITS) -> np.ndarray:
    """Weights learnt from at most `most` labelled rows, those whose hashed ids come first.

    Rows with a null label, and labels without a document, are not used; repeated labels
    of a document count as often as they occur. No labelled row gives zero weights.
    """
    some = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("y is not null and id is not null").orderBy(F.xxhash64("id"), "id", "y").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")  # at most `most` rows

    def counted(batches):
        for batch in batches:
            ids, ys, texts = batch.column("id"), batch.column("y").to_pylist(), batch.column("text")
            for start, size in words.chunks(texts):
                doc, index, _ = features(texts.slice(start, size), bits)
                key, count = np.unique(doc << bits | index, return_counts=True)
                cut = np.searchsorted(key, np.arange(size + 1) << bits)
                idx, cnt = (key & ((1 << bits) - 1)).astype(np.int32), count.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, size), pa.array(ys[start : start + size], pa.float64())] + [pa.array([a[cut[k] : cut[k + 1]].tobytes() for k in range(size)], pa.binary()) for a in (idx, cnt)],
                    names=["id", "y", "index", "count"],
                )

    def trained(batches):
        def each():
            for batch in batches:
                for y, i, c in zip(batch.column("y").to_pylist(), batch.column("index").to_pylist(), batch.column("count").to_pylist()):
                    yield np.frombuffer(i, np.int32), np.frombuffer(c, np.int32), y

        w = learn(each(), bits)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([w[at].tobytes()], pa.binary())], names=["at", "w"])

    kind = dict(docs.dtypes)[id_col]
    sparse = rows.mapInArrow(counted, f"id {kind}, y double, index binary, count binary")
    # one task on purpose: the sample is bounded and the leader learns in order
    found = sparse.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "y").mapInArrow(trained, "at binary, w binary").collect()
    w = np.zeros((1 << bits) + 1)
    for row in found:  # one row, or none without labels
        w[np.frombuffer(row.at, np.int32)] = np.frombuffer(row.w)
    return w


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score of 0 to 1 for every row; a null or empty text gets the bias alone.

    All columns, ids and repeats stay as they are; an existing column of that name is replaced.
    """
    docs = docs.drop(score_col)
    bits = int(np.log2(len(weights) - 1))
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # (1 << bits) + 1 numbers
    at = docs.columns.index(text_col)

    def work(batches):
        w = shared.value.astype(np.float64)
        for batch in batches:
            texts = batch.column(at)
            for start, size in words.chunks(texts):
                doc, index, n = features(texts.slice(start, size), bits)
                dot = np.bincount(doc, w[index], minlength=size) / np.sqrt(np.maximum(n, 1)) + w[-1]
                out = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, size).columns, pa.array(out)], names=[*batch.schema.names, score_col])

    from pyspark.sql import types as T

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
