"""Operator: benchmark decontamination by the q-gram lemma.

A passage of m characters that occurs in a text with at most k edits shares at least
m - q + 1 - k*q of its q-grams with it, on diagonals that differ by at most k. Shared
q-grams are counted per text and passage in overlapping diagonal bands; bands that reach
the bound are aligned within the band, and an alignment within the budget is a finding.
Passages are a stated set: they are broadcast in blocks of at most BLOCK_CHARS characters,
and each block scans all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import fresh

Q = 8
#: Edits allowed per character of a passage.
RATE = 0.1
BLOCK_CHARS = 2_000_000
#: Places in a block of passages above which a q-gram is not looked up; one that is left out lowers what its passages ask for.
COMMON = 64
#: Pairs of a text's and a passage's q-gram that are counted at once, and diagonals that are aligned at once.
PIECE, WIDE = 1_000_000, 1 << 15

_SEED = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def codes(text: str) -> np.ndarray:
    """Code points, A-Z lower-cased and ASCII white space as spaces, so that places stay the same."""
    out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    out[(out >= 9) & (out <= 13)] = 32
    out[(out >= 65) & (out <= 90)] += 32
    return out


def qgrams(c: np.ndarray, q: int = Q) -> np.ndarray:
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(c) - q + 1, np.uint64)
    for k in range(q):
        h *= _SEED
        h += c[k : len(c) - q + 1 + k]
    return words.mix(h)


def budget(size: np.ndarray, rate: float = RATE) -> np.ndarray:
    """Edits allowed in passages of so many characters: rate of them, rounded down, whatever their length."""
    if not 0 <= rate < 1:
        raise ValueError("the rate of edits must be from 0 to below 1")
    return (size * rate + 1e-9).astype(np.int64)


class Passages:
    """Budgets of the passages, and indexes of their q-grams, one for each q that is in use.

    q is Q, or less for a short passage: the largest for which the lemma still asks for a shared q-gram.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.ids = [i for i, _ in items]
        self.codes = [codes(t) for _, t in items]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = budget(self.size, rate)
        q = np.minimum(Q, self.size // (self.budget + 1))
        self.least = self.size - q + 1 - self.budget * q
        self.shift = np.ceil(np.log2(self.budget + 2)).astype(np.int64)  # a band is two steps of 2**shift > budget
        self.grams = [_Grams(self, int(n), np.flatnonzero(q == n)) for n in np.unique(q[q > 0])]

    def align(self, c: np.ndarray, k: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best place of passage k in c on diagonals low to high, or None over the budget."""
        most = int(self.budget[k])
        found = _banded(self.codes[k], c, low, high, most)
        if found is None:
            return None
        edits, end = found
        m = len(self.codes[k])
        back = _banded(self.codes[k][::-1], c[:end][::-1][: m + most], -most, most, most, anchored=True)
        return edits, end - (back[1] if back else m), end


class _Grams:
    """Where the q-grams of some passages occur in them.

    A q-gram with more than COMMON places is left out, and a passage asks for as many fewer
    shared q-grams as it has of them. A passage of which too little is left is `hard`: the
    places of a text that hold any of its q-grams are counted in windows of its length.
    """

    def __init__(self, passages: Passages, q: int, own: np.ndarray):
        self.q, self.passages = q, passages
        grams = [qgrams(passages.codes[k], q) for k in own]
        gram = np.concatenate(grams)
        item = np.repeat(own, [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams])
        order = np.argsort(gram, kind="stable")
        gram, item, place = gram[order], item[order], place[order]
        self.gram, count = np.unique(gram, return_counts=True)
        common = np.repeat(count > COMMON, count)
        self.least = passages.least - np.bincount(item[common], minlength=len(passages.least))
        hard = self.least < 1
        self.hard = [(int(k), np.unique(np.searchsorted(self.gram, gram[item == k]))) for k in own[hard[own]]]
        used = ~common & ~hard[item]
        self.item, self.place = item[used], place[used]
        self.count = np.bincount(np.searchsorted(self.gram, gram[used]), minlength=len(self.gram))
        self.first = np.cumsum(self.count) - self.count
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.gram >> np.uint64(64 - _FILTER_BITS)] = True

    def regions(self, c: np.ndarray, text: np.ndarray, begin: np.ndarray):
        """(text, passage, lowest, highest diagonal from the text's begin) where the passage may be.

        c: code points of many texts, each begins at `begin`; text: the text of each code point.
        """
        if len(c) < self.q:
            return
        h = qgrams(c, self.q)
        at = np.flatnonzero(self.filter[h >> np.uint64(64 - _FILTER_BITS)])
        at = at[text[at] == text[at + self.q - 1]]
        k = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        true = self.gram[k] == h[at]
        at, k = at[true], k[true]
        yield from self._bands(at[self.count[k] > 0], k[self.count[k] > 0], text, begin)
        for item, own in self.hard:
            yield from self._windows(at[np.isin(k, own)], item, text, begin)

    def _bands(self, at, k, text, begin):
        """Bands that hold enough q-grams, counted over pieces of bounded size that share what a band may span."""
        n, p = self.count[k], self.passages
        if not len(at):
            return
        reach = int(p.size[self.item].max() + 2 * (2 << int(p.shift[self.item].max())))
        total, start = np.cumsum(n), 0
        while start < len(at):
            end = max(int(np.searchsorted(total, (total[start - 1] if start else 0) + PIECE)), start + 1)
            stop = int(np.searchsorted(at, at[end - 1] + reach, side="right"))  # a band that begins in the piece ends here
            yield from self._counted(at[start:stop], k[start:stop], text, begin)
            start = end

    def _counted(self, at, k, text, begin):
        p, n = self.passages, self.count[k]
        at = np.repeat(at, n)
        post = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(len(at))
        item, doc = self.item[post], text[at]
        # a diagonal may begin before its text: by at most the passage and the budget
        diagonal = at - begin[doc] - self.place[post] + (1 << 24)
        step = diagonal >> p.shift[item]
        keys = np.concatenate([(doc << 46) | (item << 30) | s for s in (step, step - 1)])
        least = np.concatenate([self.least[item]] * 2)
        slot = (words.mix(keys.view(np.uint64)) >> np.uint64(44)).astype(np.int64)  # cheap counts first: never too low
        near = np.bincount(slot, minlength=1 << 20)[slot] >= least
        keys, place = keys[near], np.concatenate([self.place[post]] * 2)[near]
        order = np.lexsort((place, keys))
        keys, place = keys[order], place[order]
        new = np.ones(len(keys), bool)  # a q-gram of the passage counts once, however often the band holds it
        new[1:] = (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])
        keys, found = np.unique(keys[new], return_counts=True)
        doc, item = keys >> 46, (keys >> 30) & 0xFFFF
        good = found >= self.least[item]
        low = ((keys & ((1 << 30) - 1)) << p.shift[item]) - (1 << 24)
        high = low + 2 * (1 << p.shift[item]) - 1
        yield from zip(*(x[good].tolist() for x in (doc, item, low, high)))

    def _windows(self, at, item, text, begin):
        """Diagonals of the windows of the passage's length in which enough places hold one of its q-grams."""
        m, k, least = (int(x[item]) for x in (self.passages.size, self.passages.budget, self.passages.least))
        if len(at) < least:
            return
        last = at[least - 1 :]
        first = at[: len(last)]
        good = (last - first <= m + k - self.q) & (text[first] == text[last])
        low, high, doc = last[good] - (m + k - self.q), first[good] + self.q, text[first[good]]
        low, high = low - begin[doc] - k, high - begin[doc] + k  # of a passage that begins between them
        if len(low):
            new = np.ones(len(low), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > high[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(low)) - 1
            yield from zip(doc[head].tolist(), [item] * len(head), low[head].tolist(), high[tail].tolist())


def _banded(p: np.ndarray, c: np.ndarray, low: int, high: int, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """(edits, end in c) of p's best alignment with a part of c on diagonals low to high; anchored: the part begins at 0."""
    width = high - low + 1
    diagonals = np.arange(low, high + 1)
    padded = np.full(len(c) + 2 * width + len(p) + abs(low) + abs(high) + 2, 0xFFFFFFFF, np.uint32)
    base = abs(low) + 1
    padded[base : base + len(c)] = c
    big = most + 1
    row = np.where((diagonals >= 0) & (diagonals <= len(c)), np.minimum(diagonals, big) if anchored else 0, big)
    ramp = np.arange(width)
    for i in range(len(p)):
        j = diagonals + i  # column before this step
        new = row + (padded[base + i + low : base + i + low + width] != p[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((j + 1 >= 0) & (j + 1 <= len(c)), new, big)
        new = np.minimum.accumulate(new - ramp) + ramp
        row = np.minimum(new, big)
        if i & 7 == 7 and row.min() > most:
            return None
    at = int(row.argmin())
    if row[at] > most:
        return None
    return int(row[at]), int(diagonals[at]) + len(p)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """(id, item, edits, start, length): each passage that a text holds, at its best place, one row per id, text and item.

    A text holds a passage of m characters if some part of it differs by at most rate * m
    edits, rounded down, whatever m is: passages too short for that rate at Q characters a
    q-gram are looked up by shorter ones. Of several places the one of fewest edits counts,
    then the first. start and length count code points; ids are read as long. Null and
    empty passages are never found; a null or empty text holds nothing; an empty table
    gives no rows; rows with null or repeated ids are searched like others; other columns
    are not read. Long and repetitive texts are searched whole in bounded memory.
    Comparison ignores the case of A-Z and the kind of ASCII white space.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null and t != '' and i is not null").orderBy("i", "t")
    blocks: list[list[tuple[int, str]]] = [[]]
    total = 0
    for r in items.toLocalIterator():  # the stated passages, not the corpus
        if blocks[-1] and (total + len(r.t) > BLOCK_CHARS or len(blocks[-1]) >= 60_000):
            blocks.append([])
            total = 0
        blocks[-1].append((r.i, r.t))
        total += len(r.t)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks:
        part = rows.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(block), rate), "id long, item_id long, edits long, start long, length long")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_col)


def _searcher(shared, rate: float):
    def work(batches):
        passages = Passages(shared.value, rate)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, size in words.chunks(texts, words.CHUNK // 4):
                found = _search(passages, [t or "" for t in texts.slice(start, size).to_pylist()])
                if found:
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([ids.slice(start, size).take(pa.array(columns[0])), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["id", "item_id", "edits", "start", "length"])

    return work


def _search(passages: Passages, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, edits, start, length) of all findings in a chunk of texts."""
    parts = [codes(t) for t in texts]
    size = np.array([len(c) for c in parts])
    begin = np.cumsum(size) - size
    best: dict = {}
    c, text = np.concatenate(parts), np.repeat(np.arange(len(parts)), size)
    for grams in passages.grams:
        for doc, item, low, high in grams.regions(c, text, begin):
            own = parts[doc]
            m, k = len(passages.codes[item]), int(passages.budget[item])
            low, high = max(low, -k), min(high, len(own) - m + k)
            for at in range(low, high + 1, WIDE):  # neighbours share what an alignment may drift
                if best.get((doc, item), (1,))[0] == 0:
                    break
                to = min(at + WIDE - 1 + 2 * k, high)
                a, b = max(0, at - k), min(len(own), to + m + k)
                if found := passages.align(own[a:b], item, at - a, to - a):
                    edits, s, e = found
                    best[doc, item] = min(best.get((doc, item), (edits, a + s, e - s)), (edits, a + s, e - s))
    return [(doc, passages.ids[item], *b) for (doc, item), b in sorted(best.items())]


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """docs without the rows whose id has a text in which a passage is found; all columns stay as they are.

    A null or empty text holds nothing and stays. Rows that share an id, null included, go
    together. An empty table, or no passages, takes nothing away.
    """
    (bad,) = fresh(docs, "_bad")
    found = find(docs, benchmark, id_col, text_col, rate=rate).select(F.col(id_col).alias(bad)).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(bad)), "left_anti")
