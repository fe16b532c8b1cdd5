"""Operator: token counts by a two-tier lookup on the map side.

First tier: the lengths of the corpus's frequent pre-tokens, counted over all texts by
bounded summaries on the map side and broadcast as one packed table. Second tier: a
bounded cache of the worker's task; what it misses is encoded by the library, many
pre-tokens at once. Pre-tokens themselves are never shuffled.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_bpe, words

#: Entries that a partition's summary and the broadcast table hold at most; about 1 MB broadcast.
SUMMARY, TABLE = 4096, 32768
#: Pre-tokens that a task remembers at most, and the characters of the longest of them.
REMEMBERED, LONGEST = 150_000, 64
#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK = 1 << 20


def frequent(df: DataFrame, model_path: str, text_col: str = "text", summary: int = SUMMARY, most: int = TABLE) -> DataFrame:
    """(piece, n): the pre-tokens that partition summaries over all texts hold, most frequent first.

    A partition keeps its `summary` most frequent of a bounded counter, so what is
    shuffled is bounded by the number of partitions, not by the texts. It serves speed
    alone: what is not in it is looked up in the second tier.
    """
    with open(model_path, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        model, seen = piece_bpe.load(blob.value), Counter()
        for batch in batches:
            for t in batch.column(0):
                seen.update(x for x in model.split(t.as_py() or "") if len(x) <= LONGEST)
                if len(seen) > 16 * summary:
                    seen = Counter(dict(seen.most_common(8 * summary)))
        best = seen.most_common(summary)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])

    return df.select(text_col).mapInArrow(work, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(most)


def _lengths(sp, units: list[str]) -> list[int]:
    """Tokens of each pre-token, as part of a text: a newline in front keeps the library from adding a space."""
    mark, texts, less = piece_bpe.SPACE, [], []
    for u in units:
        inside = u[0] != mark
        texts.append("\n" + u if inside else u[1:])
        less.append(2 if inside else 0)
    # a space alone in front of nothing: the library encodes the empty text as nothing
    return [len(x) - n if t else 1 for x, n, t in zip(sp.encode(texts, num_threads=1), less, texts)]


def packed(rows: list[str], lengths: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    parts = [r.encode() for r in rows]
    return b"".join(parts), np.array([len(p) for p in parts], np.uint16), np.array(lengths, np.uint16)


def count_tokens(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, without begin or end ids.

    A null text counts as empty: 0 bytes and 0 tokens. One row comes out for each that
    goes in, with null ids and repeats; an empty table gives no rows. Texts are
    counted whole, at any length, and other columns are not read.
    """
    sc = df.sparkSession.sparkContext
    with open(model_path, "rb") as f:
        raw = f.read()
    top = [r.piece for r in frequent(df, model_path, text_col).collect()]  # TABLE rows at most
    lengths = _lengths(sentencepiece.SentencePieceProcessor(model_proto=raw), top) if top else []
    blob, shared = sc.broadcast(raw), sc.broadcast(packed(top, lengths))

    def work(batches):
        model = piece_bpe.load(blob.value)
        text, sizes, counts = shared.value
        first, at = {}, 0
        for size, n in zip(sizes.tolist(), counts.tolist()):
            first[text[at : at + size].decode()] = n
            at += size
        sp = sentencepiece.SentencePieceProcessor(model_proto=blob.value)
        seen: dict = {}  # the task's own, so that a worker gives it back
        tiers = _Tiers(first, seen)
        for batch in batches:
            for start, size in words.chunks(batch.column(1), CHUNK):
                part = batch.slice(start, size)
                texts = [t.as_py() or "" for t in part.column(1)]
                units = [model.split(t) for t in texts]
                missed = list(tiers.missing(units))
                if len(seen) + len(missed) > REMEMBERED:
                    seen.clear()
                    missed = list(tiers.missing(units))
                for k in range(0, len(missed), 20_000):
                    some = missed[k : k + 20_000]
                    seen.update(zip(some, _lengths(sp, some)))
                tokens = [sum(map(tiers.__getitem__, u)) for u in units]
                for u in [u for u in missed if len(u) > LONGEST]:  # rare, and they would fill the cache
                    del seen[u]
                n_bytes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    names=["id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


class _Tiers(dict):
    """The broadcast table; a key that it lacks comes from the worker's cache."""

    def __init__(self, first: dict, seen: dict):
        super().__init__(first)
        self.seen = seen

    def __missing__(self, unit: str) -> int:
        return self.seen[unit]

    def missing(self, units: list[list[str]]) -> set[str]:
        seen = self.seen
        return {u for doc in units for u in set(doc) if u not in self and u not in seen}
