"""Dense vectors: cosine ranking, masked mean, embedders (O-43, O-58, O-78 to O-80)."""

from __future__ import annotations

import hashlib
import math
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import best
from .lexical import CANDIDATES, top


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


#: Bytes of the query vectors that are broadcast together, 8 a number.
BLOCK_BYTES = 1 << 19
#: Vectors of which a task multiplies so many at once with the block.
ROWS = 4096


def dense_ranked(vectors: DataFrame, queries: DataFrame, most: int = CANDIDATES, block_bytes: int | None = None) -> DataFrame:
    """(qid, unit, score, rank) from vectors (unit, vec) and queries (qid, vec); null query vectors rank nothing.

    Every vector meets every query of the stated set; negative scores stay. Queries go to the
    tasks in blocks of about `block_bytes` (BLOCK_BYTES), each task multiplies its vectors with a block and
    keeps, of each query, those that can be among the best `most`, so a query's rows that are
    shuffled are bounded by the tasks. A vector of another length counts over the shorter one.
    """
    stated = queries.where("vec is not null").select("qid", F.col("vec").cast("array<double>").alias("vec"))
    size = stated.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    dim = max(size.dim or 0, 1)
    blocks = max(1, -(-size.n * dim * 8 // (block_bytes or BLOCK_BYTES)))
    kinds = f"qid {dict(queries.dtypes)['qid']}, unit {dict(vectors.dtypes)['unit']}, score double"
    units = vectors.where("vec is not null").select("unit", F.col("vec").cast("array<double>").alias("vec"))
    out = None
    for k in range(blocks):
        block = stated.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k) if blocks > 1 else stated
        rows = block.toArrow()  # about block_bytes
        shared = queries.sparkSession.sparkContext.broadcast((rows["qid"].combine_chunks(), _matrix(rows["vec"].combine_chunks(), dim)))
        part = units.mapInArrow(_nearest(shared, most, dim), kinds)
        out = part if out is None else out.unionByName(part)
    return top(out, most)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of `dim` numbers, cut or filled up with zeros; a null is 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not column.null_count and len(column):
        flat = column.flatten()
        if not flat.null_count and (pc.list_value_length(column).to_numpy() == dim).all():
            return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    for k, v in enumerate(column):
        if v.is_valid and len(v):
            x = np.asarray(v.values.fill_null(0.0))[:dim]
            out[k, : len(x)] = x
    return out


def _nearest(shared, most: int, dim: int):
    def work(batches):
        qids, asked = shared.value
        found, kind = best.Best(len(qids), most), None
        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found.add(best.ids(part.column(0)), asked @ _matrix(part.column(1), dim).T)
        yield from found.batches(qids, kind)

    return work


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, the count at least 1e-9; null for no tokens."""
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    zero = F.transform(F.get(hidden, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda x: x.cast("double") * m)), zero, lambda s, h: F.zip_with(s, h, lambda x, y: x + y))
    return F.transform(total, lambda x: x / count)


def normalized(vec: Column) -> Column:
    """vec over its length, which is at least 1e-12."""
    return F.transform(vec, lambda x: x / F.greatest(F.sqrt(dot(vec, vec)), F.lit(1e-12)))


def checked(vectors: DataFrame, dim: int) -> DataFrame:
    """vectors, failing on one that has not `dim` numbers (O-80)."""
    return vectors.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.lit(f"a vector has not {dim} numbers")).cast("array<float>")))


class Embedder(Protocol):
    """Encodes texts; `model` names the weights, and an index refuses vectors of another model."""

    model: str
    dim: int

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Deterministic stand-in for tests: signed word hashes, unit length."""

    def __init__(self, dim: int = 64):
        self.model, self.dim = f"hashing-{dim}", dim

    def encode(self, texts):
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            size = max(math.sqrt(sum(x * x for x in v)), 1e-12)
            out.append([x / size for x in v])
        return out


def embed(rows: DataFrame, embedder: Embedder, id_col: str, text_col: str, prefix: str = "passage: ", batch: int = 16) -> DataFrame:
    """(id, vec): prefixed texts encoded `batch` at a time on the executors."""

    def work(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = embedder.encode([prefix + (t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "vec"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, vec array<float>").withColumnRenamed("id", id_col)
