"""Operator: SentencePiece encoding and decoding of a text column (see piece_bpe)."""

from __future__ import annotations

from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_bpe

#: Characters or ids of the rows that are handled at once; a longer row is handled alone.
CHUNK = 1 << 21


def _mapped(df: DataFrame, model_path: str, id_col: str, in_col: str, make, names: list[tuple[str, str]]) -> DataFrame:
    """make(model, column) gives the columns `names` (name, SQL type) of the rows of a column."""
    with open(model_path, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size is fixed

    def work(batches):
        model = piece_bpe.load(blob.value)
        try:
            for batch in batches:
                for start, size in _chunks(batch.column(1)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, size), *make(model, batch.column(1).slice(start, size))], names=["id", *(n for n, _ in names)])
        finally:
            model.release()

    ddl = f"id long, {', '.join(f'{n} {sql}' for n, sql in names)}"
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(in_col).alias("in")).mapInArrow(work, ddl).withColumnRenamed("id", id_col)


def _chunks(column: pa.Array):
    if pa.types.is_list(column.type):
        column = pc.list_value_length(column)
        sizes = pc.fill_null(column, 0).to_pylist()
    else:
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at, total = 0, 0
    for k, size in enumerate(sizes):
        if k > at and total + size > CHUNK:
            yield at, k - at
            at, total = k, 0
        total += size
    if sizes:
        yield at, len(sizes) - at


def _texts(column: pa.Array):
    return (t.as_py() or "" for t in column)


def _lengths(packed: list[bytes]) -> np.ndarray:
    return np.array([len(p) for p in packed], np.int64) // 4


def _lists(packed: list[bytes]) -> pa.Array:
    """Packed ids as a column of arrays, without a Python number for each."""
    offsets = np.concatenate([[0], np.cumsum(_lengths(packed))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _decoded(model, packed: bytes) -> bytes:
    return model.decode(array("I", packed))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", add_bos: bool = True, add_eos: bool = True) -> DataFrame:
    """(id, n_tokens, ids): ids is an array of int, exactly as the library encodes, without sampling.

    One output row per input row, so repeated rows and null ids stay; ids are read as
    long, and one that is no number fails in ANSI mode. A null text counts as empty: only
    the begin and end ids. An empty table gives no rows. Texts of any length are encoded
    whole; other columns are not read.
    """

    def make(model, column):
        packed = [model.encode(t, add_bos, add_eos) for t in _texts(column)]
        return pa.array(_lengths(packed)), _lists(packed)

    return _mapped(df, model_path, id_col, text_col, make, [("n_tokens", "long"), ("ids", "array<int>")])


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from an array of ids; null ids give an empty text, and bytes that are no UTF-8 give U+FFFD."""

    def make(model, column):
        return (pa.array([model.decode(ids.as_py() or ()).decode("utf-8", "replace") for ids in column], pa.string()),)

    return _mapped(df, model_path, id_col, ids_col, make, [("text", "string")])


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, text): encode() then decode() of the ids in one pass over the texts."""

    def make(model, column):
        packed = [model.encode(t) for t in _texts(column)]
        return pa.array(_lengths(packed)), _lists(packed), pa.array([_decoded(model, p).decode("utf-8", "replace") for p in packed], pa.string())

    return _mapped(df, model_path, id_col, text_col, make, [("n_tokens", "long"), ("ids", "array<int>"), ("text", "string")])


def digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): round_trip() with digests in place of the ids and the text."""

    def make(model, column):
        rows = []
        for t in _texts(column):
            packed = model.encode(t)
            rows.append((len(packed) // 4, sha256(packed).hexdigest(), sha256(_decoded(model, packed)).hexdigest()))
        counts, ids, back = zip(*rows)
        return pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())

    return _mapped(df, model_path, id_col, text_col, make, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
