"""Lexical statistics, BM25 and title coverage as joins and aggregates (O-41, O-42, O-50 to O-54, O-69)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions.text import let, tokenize
from brevia.tables import saved, sized

from . import best

K1, B = 1.2, 0.75
CANDIDATES = 200


@dataclass
class Field:
    """A text field, tokenised once: rows(unit, tokens); packed(unit, len, words) has the tokens as one string, with spaces."""

    rows: DataFrame
    packed: DataFrame

    @property
    def tf(self) -> DataFrame:
        """(unit, len, term, tf)."""
        # outer, since Spark would compute the array again to leave out units without tokens
        found = self.rows.select("unit", F.size("tokens").alias("len"), runs(F.col("tokens")).alias("terms"))
        return found.select("unit", "len", F.explode_outer("terms").alias("t")).where("t is not null").select("unit", "len", "t.term", "t.tf")

    @property
    def units(self) -> DataFrame:
        """(unit, term): each term of a unit once."""
        return self.rows.select("unit", F.explode_outer(F.array_distinct("tokens")).alias("term")).where("term is not null")

    @property
    def df(self) -> DataFrame:
        """(term, df): the units that have each term."""
        return self.units.groupBy("term").agg(F.count("*").alias("df"))

    @property
    def stats(self) -> DataFrame:
        """One row (n, avg_len), at least 1 each; units without tokens count."""
        return self.packed.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.greatest(F.coalesce(F.avg("len"), F.lit(1.0)), F.lit(1.0)).alias("avg_len"))


def runs(tokens: Column) -> Column:
    """(term, tf) of an array of tokens: sorted, each run of equals once. No shuffle, a unit's tokens are one row."""

    def counted(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf"))))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), counted)).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))


def field(units: DataFrame, unit_col: str, text_col: str, keep: bool = False) -> Field:
    """keep: the tokenised units are written to the shared folder, for a field that several jobs or lists read."""
    rows = units.select(F.col(unit_col).alias("unit"), tokenize(F.col(text_col)).alias("tokens"))
    packed = rows.select("unit", F.size("tokens").alias("len"), F.array_join("tokens", " ").alias("words"))
    if not keep:
        return Field(rows, packed)
    packed = saved(packed)
    return Field(packed.select("unit", F.when(F.col("len") > 0, F.split("words", " ")).otherwise(F.array().cast("array<string>")).alias("tokens")), packed)


def term_frequency(units: DataFrame, unit_col: str, text_col: str) -> DataFrame:
    """(unit, len, term, tf)."""
    return field(units, unit_col, text_col).tf


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, qtf): a term counts as often as the query has it."""
    return queries.select("qid", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


#: Terms that tasks count at once, tokens that a task looks up at once.
VOCABULARY, TOKENS = 1 << 17, 1 << 18


def _known(f: Field, terms: DataFrame) -> DataFrame:
    """(qid, term, qtf, df) of the terms that the field has. Terms go to the tasks in blocks of VOCABULARY; a task counts its own units."""
    wanted = saved(terms.select("term").distinct())
    blocks, df = max(1, -(-wanted.count() // VOCABULARY)), None
    for k in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k) if blocks > 1 else wanted
        shared = terms.sparkSession.sparkContext.broadcast(block.toArrow()["term"].combine_chunks())  # about VOCABULARY terms
        part = f.packed.select("len", "words").mapInArrow(_counted(shared), "term string, df long")
        df = part if df is None else df.unionByName(part)
    return terms.join(df.groupBy("term").agg(F.sum("df").alias("df")), "term")


def _slices(batch: pa.RecordBatch):
    """A batch of packed units in slices of about TOKENS tokens, or one unit."""
    ends = np.cumsum(batch.column("len").to_numpy(), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + TOKENS, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def _postings(part: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the vocabulary's terms in packed units, by row and term."""
    tokens = pc.split_pattern(part.column("words"), " ")
    term = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy()
    row = np.repeat(np.arange(part.num_rows), pc.list_value_length(tokens).to_numpy())
    known, words = term >= 0, max(len(vocabulary), 1)
    posting, tf = np.unique((row * words + term)[known], return_counts=True)
    return *np.divmod(posting, words), tf


def _counted(shared):
    def work(batches):
        vocabulary = shared.value
        df = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in _slices(batch):
                df += np.bincount(_postings(part, vocabulary)[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([vocabulary.take(pa.array(some)), pa.array(df[some])], names=["term", "df"])

    return work


def weighted(f: Field, terms: DataFrame) -> DataFrame:
    """(term, qid, w, avg_len): what a term's frequency in a unit counts for a query, for the terms that the field has."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return saved(_known(f, terms).join(F.broadcast(f.stats)).select("term", "qid", (F.col("qtf") * idf * (K1 + 1)).alias("w"), "avg_len"))  # stats: one row


def bm25(f: Field, terms: DataFrame) -> DataFrame:
    """(qid, unit, score) of every unit with a query term; for the best of them see ranked()."""
    weights = weighted(f, terms)
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    return f.tf.join(sized(weights), "term").groupBy("qid", "unit").agg(F.sum(F.col("w") * F.col("tf") / norm).alias("score"))


def top(scored: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The best `most` units of each query with their rank from 0; ties go to the lower unit.

    Scores are compared to nine places, since the order of a sum depends on the partitions.
    The limit is on row_number() itself, so that each task cuts its own rows before the shuffle.
    """
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "unit")
    cut = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return cut.withColumn("rank", F.col("rank") - 1)


#: Queries whose weights tasks have at once, postings and units that a task multiplies with them at once.
BLOCK, POSTINGS, UNITS = 256, 1 << 16, 1 << 10
#: Terms of so many of a block's queries are multiplied as a matrix, others one by one with their queries.
COMMON = 16


def ranked(f: Field, terms: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(qid, unit, score, rank) of the positive BM25 scores.

    Queries go to the tasks in blocks of BLOCK as weights by term; a task counts the asked terms of its own
    units, each a row with its tokens, scores them and keeps each query's best. No posting is shuffled.
    """
    weights = weighted(f, terms)
    kinds = f"qid {dict(terms.dtypes)['qid']}, unit {dict(f.packed.dtypes)['unit']}, score double"
    asked = weights.select("qid").distinct().count()
    blocks, out = max(1, -(-asked // BLOCK)), None
    for k in range(blocks):
        block = weights.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k) if blocks > 1 else weights
        shared = weights.sparkSession.sparkContext.broadcast(block.toArrow())  # the terms of about BLOCK queries
        part = f.packed.mapInArrow(_scored(shared, most), kinds)
        out = part if out is None else out.unionByName(part)
    return top(out, most)


class _Weights:
    """A block's weights (term, qid, w): a matrix for terms of COMMON queries or more, lists of (query, w) for the others."""

    def __init__(self, asked: pa.Table):
        self.vocabulary, self.qids = (pc.unique(asked[c]) for c in ("term", "qid"))
        term, query = (pc.index_in(asked[c], value_set=v).to_numpy() for c, v in (("term", self.vocabulary), ("qid", self.qids)))
        w = asked["w"].to_numpy()
        held = np.bincount(term, minlength=len(self.vocabulary))
        common = np.flatnonzero(held >= COMMON)
        self.column = np.full(len(held), -1)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), len(self.qids)))
        dense = self.column[term] >= 0
        self.matrix[self.column[term[dense]], query[dense]] = w[dense]
        order = np.argsort(term, kind="stable")
        self.begin, self.held, self.query, self.w = np.cumsum(held) - held, held, query[order], w[order]

    def scores(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """A row a query, a column a unit, from postings (row, term) that count as value."""
        at = self.column[term]
        common = at >= 0
        units = np.zeros((rows, len(self.matrix)))
        units[row[common], at[common]] = value[common]
        out = units @ self.matrix
        row, term, value = row[~common], term[~common], value[~common]
        n = self.held[term]
        k = np.repeat(self.begin[term] - np.cumsum(n) + n, n) + np.arange(n.sum())  # each posting with each query of its term
        out += np.bincount(np.repeat(row, n) * out.shape[1] + self.query[k], np.repeat(value, n) * self.w[k], out.size).reshape(out.shape)
        return out.T


def _scored(shared, most: int):
    def work(batches):
        asked = shared.value
        weights = _Weights(asked)
        mean = asked["avg_len"][0].as_py() if len(asked) else 1.0
        found, kind = best.Best(len(weights.qids), most), None
        for batch in batches:
            kind = batch.column("unit").type
            for part in _slices(batch):
                units, size = best.ids(part.column("unit")), part.column("len").to_numpy()
                row, term, tf = _postings(part, weights.vocabulary)
                value = tf / (tf + K1 * (1 - B + B * size[row] / mean))
                some, begin = np.unique(row, return_index=True)
                first = 0
                while first < len(some):  # whole units, or one
                    last = max(min(int(np.searchsorted(begin, begin[first] + POSTINGS)), first + UNITS, len(some)), first + 1)
                    a, b = begin[first], begin[last] if last < len(some) else len(row)
                    scores = weights.scores(np.searchsorted(some[first:last], row[a:b]), term[a:b], value[a:b], last - first)
                    found.add(units[some[first:last]], scores, scores > 0)
                    first = last
        yield from found.batches(weights.qids, kind)

    return work


def coverage(f: Field, terms: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(qid, unit, coverage): share of the query's distinct terms known to the field that the unit has; of the pairs (qid, unit) of wanted, if given."""
    known = saved(_known(f, terms).select("qid", "term"))
    reachable = known.groupBy("qid").agg(F.count("*").alias("reachable"), F.collect_list("term").alias("asked"))
    if wanted is None:
        matched = f.units.join(sized(known), "term").groupBy("qid", "unit").agg(F.count("*").alias("matched")).join(reachable, "qid")
    else:
        pairs = f.rows.join(sized(wanted.select("qid", "unit")), "unit").join(sized(reachable), "qid")
        matched = pairs.select("qid", "unit", "reachable", F.size(F.array_intersect("asked", "tokens")).alias("matched")).where("matched > 0")
    return matched.select("qid", "unit", (F.col("matched") / F.col("reachable")).alias("coverage"))
