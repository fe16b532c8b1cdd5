"""Operator: removal of repeated word windows by FM-indexes, one per shard.

Every window of `window` words has a minimizer, the least hash among its runs of GRAM
words. Neighbouring windows with one minimizer make a segment, which is sent to the shard
of its minimizer's hash: equal windows meet in one shard, whatever documents hold them,
and no shard has to see all documents. Of equal segments in a batch only the earliest is
sent; the others are repeats already. A shard leaves out segments whose minimizer occurs
nowhere else, builds a compressed FM-index over the words of the rest, streams the segments' words
through it for their matching statistics, and reports each window that reaches the threshold
and whose interval holds an earlier place.
The reported word ranges return to their documents by id.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .fm_index import FMIndex

WINDOW, GRAM = 20, 5
#: Bytes of text whose segments are packed together, and shards for each shuffle partition.
PACK, SHARDS = 8 << 20, 2
#: Bytes of input for which there is a shard at least, where Spark knows the input's size, and the shards at most.
SHARD_BYTES, MOST_SHARDS = 8 << 20, 100_000
#: Windows whose matching statistics are found at once.
STREAMED = 1 << 18
#: Words of one FM-index; minimizers of a larger shard are dealt over several.
INDEX_WORDS = 1_500_000

#: Kinds of a segment's numbers: minimizer, id, place, words, whether it holds its minimizer twice.
_NUMBERS = (np.uint64, np.int64, np.int32, np.uint16, np.uint8)

_RANGES = "id long, ranges binary"


def least_of_runs(values: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours."""
    out, width = values, 1
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def segments(w: words.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, minimizer) of the maximal runs of windows with one minimizer, in order."""
    if len(w.hash) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = least_of_runs(words.ngrams(w.hash, GRAM), window - GRAM + 1)
    start = np.flatnonzero(w.doc[: len(least)] == w.doc[window - 1 :])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (m[1:] != m[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    # a minimizer may stay for long in text that repeats itself: segments of at most 2 * window windows
    counts = np.diff(np.append(first, len(start)))
    pieces = -(-counts // (2 * window))
    inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = start[np.repeat(first, pieces)] + inner * 2 * window
    size = np.minimum(np.repeat(counts, pieces) - inner * 2 * window, 2 * window)
    return begin, size + window - 1, np.repeat(m[first], pieces)


def _holds_twice(grams: np.ndarray, begin: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Segments that hold their minimizer more than once, and so may repeat a window of their own."""
    n = size - GRAM + 1
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.add.reduceat(grams[at] == np.repeat(least, n), np.cumsum(n) - n, dtype=np.int64) > 1


def _group_ranges(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row per id: its word ranges as pairs of 32-bit numbers."""
    order = np.lexsort((start, ids))
    ids, pairs = ids[order], np.stack([start, end], 1)[order].astype(np.int32)
    cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[cut], pa.int64()), pa.array([pairs[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())], pa.binary())], names=["id", "ranges"])


def _pack(shards: int, window: int):
    """Documents to rows (shard, segments), and rows (-1, ranges) of repeats within a batch."""

    def work(batches):
        names, out = ["shard", "id", "payload"], []
        pending, size = [], 0
        for batch in batches:
            for start, n in words.chunks(batch.column(1), PACK):
                part = batch.slice(start, n)
                pending.append(part)
                size += part.column(1).nbytes
                if size >= PACK:
                    out, pending, size = pending, [], 0
                    yield from packed(out, names)
        if pending:
            yield from packed(pending, names)

    def packed(parts, names):
        found = []
        for part in parts:
            for at, n in words.chunks(part.column(1)):
                w = words.words(part.column(1).slice(at, n))
                begin, size, least = segments(w, window)
                if not len(begin):
                    continue
                raw, lo, hi = w.data.tobytes(), w.start[begin], w.end[begin + size - 1]
                ids = part.column(0).slice(at, n).to_numpy(zero_copy_only=False)[w.doc[begin]]
                place = begin - w.first[:-1][w.doc[begin]]
                content = _content(w.hash, begin, size)
                twice = _holds_twice(words.ngrams(w.hash, GRAM), begin, size, least)
                found.append((least, ids, place, size, content, twice, [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())]))
        if not found:
            return
        least, ids, place, size, content, twice = (np.concatenate([f[k] for f in found]) for k in range(6))
        texts = [t for f in found for t in f[6]]
        order = np.lexsort((place, ids, content, least))
        first = np.ones(len(order), bool)
        first[1:] = (content[order[1:]] != content[order[:-1]]) | (least[order[1:]] != least[order[:-1]]) | (size[order[1:]] != size[order[:-1]])
        # a row that is repeated under its id has the place of the first: like in _index, that is no repeat
        head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        again = order[~first & ((ids[order] != ids[head]) | (place[order] != place[head]))]
        order = order[first]
        if len(again):
            ranges = _group_ranges(ids[again], place[again], place[again] + size[again])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ranges), -1), pa.int32()), *ranges.columns], names=names)
        shard = (least[order] >> np.uint64(20)).astype(np.int64) % shards
        order = order[np.argsort(shard, kind="stable")]
        shard = (least[order] >> np.uint64(20)).astype(np.int64) % shards
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        squeeze = zstandard.ZstdCompressor(level=3)
        rows = []
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(order)).tolist()):
            own = order[a:b]
            numbers = zip(_NUMBERS, (least[own], ids[own], place[own], size[own], twice[own]))
            head = len(own).to_bytes(8, "little") + b"".join(x.astype(kind).tobytes() for kind, x in numbers)
            rows.append(squeeze.compress(head + b"\n".join([_flat(texts[k]) for k in own.tolist()])))
        yield pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int32()), pa.nulls(len(cut), pa.int64()), pa.array(rows, pa.binary())], names=names)

    return work


def _flat(text: bytes) -> bytes:
    return b" ".join(text.split())


def _content(hashed: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment's words."""
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    place = at - np.repeat(begin, size)
    return words.mix(np.add.reduceat(words.mix(hashed[at] + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.cumsum(size) - size))


def _unpack(payloads: list[bytes]):
    parts, texts = [], []
    for p in payloads:
        raw = zstandard.ZstdDecompressor().decompress(p)
        n, at, row = int.from_bytes(raw[:8], "little"), 8, []
        for kind in _NUMBERS:
            row.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        parts.append(row)
        texts += raw[at:].split(b"\n")
    least, ids, place, size, twice = (np.concatenate(x) for x in zip(*parts))
    return least, ids, place.astype(np.int64), size.astype(np.int64), twice > 0, texts


def _shared(least: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Segments whose minimizer another segment has, or that hold it twice."""
    _, at, n = np.unique(least, return_inverse=True, return_counts=True)
    return np.flatnonzero((n[at] > 1) | twice)


def repeats(least, ids, place, size, texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window of it) of every window whose words also start earlier, by (id, place)."""
    order = np.lexsort((place, ids))
    w = words.words(pa.array([texts[k] for k in order.tolist()], pa.large_binary()).cast(pa.large_string()))
    _, symbol = np.unique(w.hash, return_inverse=True)
    symbol, lengths = symbol.astype(np.int32) + 1, np.diff(w.first)
    index = FMIndex(symbol, lengths, int(symbol.max()) + 1)
    count = lengths - window + 1
    seg = np.repeat(np.arange(len(order)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    ends = w.first[:-1][seg] + inner + window
    alive, low = [], []
    for k in range(0, len(ends), STREAMED):  # the segments' words go by as a stream
        part = slice(k, k + STREAMED)
        length, lows, _ = index.matching(symbol, ends[part], inner[part] + window, window)
        above = np.flatnonzero(length >= window)
        alive.append(above + k)
        low.append(lows[above])
    alive, low = np.concatenate(alive), np.concatenate(low)
    # the places of an interval share its low end: one is the earliest by document and word
    o_id, o_place = ids[order], place[order]
    key = low
    by = np.lexsort((o_place[seg[alive]] + inner[alive], o_id[seg[alive]], key))
    k, i, p = key[by], o_id[seg[alive]][by], (o_place[seg[alive]] + inner[alive])[by]
    group = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(group, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
    later = (i != i[head]) | (p != p[head])
    hit = alive[by[later]]
    return order[seg[hit]], inner[hit]


def _index(window: int):
    """Rows of a shard, in order of shards, to rows (id, ranges)."""

    def shard_rows(batches):
        now, held = None, []
        for batch in batches:
            for shard, i, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if shard < 0:
                    yield None, (i, payload.as_py())
                    continue
                if shard != now and held:
                    yield now, held
                    held = []
                now = shard
                held.append(payload.as_py())
        if held:
            yield now, held

    def work(batches):
        early: list = []
        for shard, rows in shard_rows(batches):
            if shard is None:
                early.append(rows)
                if len(early) >= 5000:
                    yield _rows(early)
                    early = []
                continue
            least, ids, place, size, twice, texts = _unpack(rows)
            shared = _shared(least, twice)
            # of equal segments the earliest stays; the others are repeats from end to end
            first, again = {}, []
            for x in shared[np.lexsort((place[shared], ids[shared]))].tolist():
                earlier = first.setdefault(texts[x], x)
                if earlier != x and (ids[earlier], place[earlier]) != (ids[x], place[x]):
                    again.append(x)
            if again:
                yield _group_ranges(ids[again], place[again], place[again] + size[again])
            shared = np.array(sorted(first.values()), np.int64)
            shared = shared[_shared(least[shared], twice[shared])]
            if not len(shared):
                continue
            parts = -(-int(size[shared].sum()) // INDEX_WORDS)
            deal = (words.mix(least[shared] + np.uint64(5)) % np.uint64(parts)).astype(np.int64)
            for k in range(parts):
                own = shared[deal == k]
                if not len(own):
                    continue
                seg, inner = repeats(least[own], ids[own], place[own], size[own], [texts[x] for x in own.tolist()], window)
                if len(seg):
                    yield _group_ranges(ids[own][seg], place[own][seg] + inner, place[own][seg] + inner + window)
        if early:
            yield _rows(early)

    return work


def _rows(pairs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.binary())], names=["id", "ranges"])


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, ranges): word ranges [start, end) of windows that also start earlier, packed 32-bit pairs, several rows per id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:  # else Spark does not know it
        partitions = max(partitions, min(size // SHARD_BYTES, MOST_SHARDS) // SHARDS)
    packs = rows.mapInArrow(_pack(partitions * SHARDS, window), "shard int, id long, payload binary")
    # repeats found on the way are spread by document
    key = F.when(F.col("shard") >= 0, F.col("shard").cast("long")).otherwise(F.col("id"))
    dealt = packs.repartition(partitions, key).sortWithinPartitions("shard")
    return dealt.mapInArrow(_index(window), _RANGES)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """(id, n_words, n_removed, text) for every row; with digest kept_sha256 in place of the text.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if a window of `window` words covers it whose
    words also start earlier: in a row of smaller id, or earlier in the same row. What is kept
    is joined by one space. Windows are judged on the input alone. A null text has no words;
    texts shorter than a window stay whole. Rows with a null id have no order: they stay whole
    and make nothing a repeat. Rows that share an id share what is found for it, and a place of
    one is no repeat of the same place of another: a row given twice is kept twice. An empty
    table gives no rows. Only these two columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = find_repeats(docs, id_col, text_col, window).groupBy("id").agg(F.collect_list("ranges").alias("ranges"))
    wide = rows.join(found, "id", "left").select("id", "text", "ranges")
    last = ("kept_sha256", "string") if digest else ("text", "string")

    def work(batches):
        for batch in batches:
            for at, size in words.chunks(batch.column(1), words.CHUNK):
                part = batch.slice(at, size)
                n_words, n_gone, kept = [], [], []
                for text, ranges in zip(part.column(1), part.column(2)):
                    ws = (text.as_py() or "").encode().split()
                    n_words.append(len(ws))
                    if ranges.is_valid:
                        pairs = np.frombuffer(b"".join(ranges.as_py()), np.int32).reshape(-1, 2)
                        edge = np.zeros(len(ws) + 1, np.int64)
                        np.add.at(edge, np.minimum(pairs[:, 0], len(ws)), 1)
                        np.add.at(edge, np.minimum(pairs[:, 1], len(ws)), -1)
                        stay = np.cumsum(edge)[:-1] == 0
                        n_gone.append(int(len(ws) - stay.sum()))
                        ws = [x for x, y in zip(ws, stay.tolist()) if y]
                    else:
                        n_gone.append(0)
                    joined = b" ".join(ws)
                    kept.append(sha256(joined).hexdigest() if digest else joined.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", last[0]])

    return wide.mapInArrow(work, f"id long, n_words long, n_removed long, {last[0]} {last[1]}").withColumnRenamed("id", id_col)
