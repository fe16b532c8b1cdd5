"""Operator: near-duplicate components by SetSketch registers.

Each text's set of word shingles is sketched: every shingle hashes to a Poisson process
over REGISTERS registers, a register keeps its first arrival, exponentially spaced and
truncated to 16 bits. Registers of equal sets are equal, a union's is the maximum, and
those of two sets agree about as often as their Jaccard similarity says. Bands of
registers give buckets. Texts with equal sets are one class before that.

In each bucket everything is compared with two leaders, so a bucket makes two pairs a
member however many it has. Pairs that pass the size bound and the likelihood estimate
are verified on full sets, and verified links give components. Where a bucket still holds
several components, other leaders follow, one a round, while that settles much. What even
they leave apart is joined across components by the rarest shingles of full sets: two
similar sets share one of them early, so no pair that shares a bucket and is similar goes
untested, while near copies whose own edits hold them below the threshold do not meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import saved

REGISTERS, ROWS = 256, 5
#: A pair at 0.8 shares none of the 51 bands once in 10**8 cases.
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Standard deviations below the threshold at which the estimate gives a pair up.
SLACK = 6.0
#: Further leaders of a bucket that holds several components, while a round settles this share of what was apart.
ROUNDS, WORTH = 4, 0.1
#: Ids that are broadcast to the texts at most; more are joined by a shuffle. 8 bytes each.
BROADCAST_IDS = 200_000
#: Rows of ids that a partition of the component rounds holds at least, where there are as many.
ID_ROWS = 200_000
#: Counters by which shingles are ordered; any order gives the same pairs, a finer one looks at fewer.
SLOTS = 1 << 17


def shingle_sets(column: pa.Array, n: int, lower: bool) -> list[np.ndarray]:
    """Sorted distinct hashes of every text's n-word shingles; of its whole word sequence if shorter; none without words."""
    w = words.words(column, lower=lower)
    grams = words.ngrams(w.hash, n)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else words.ngrams(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of each set, one row a set; an empty set's are 0."""
    size = np.array([len(s) for s in sets])
    registers = np.full((len(sets), REGISTERS), np.inf)
    reach = (math.log(REGISTERS) + 4.0) / np.maximum(size, 1)
    todo = np.flatnonzero(size)
    while len(todo):
        h = np.concatenate([sets[k] for k in todo])
        doc = np.repeat(todo, size[todo])
        time, step = np.zeros(len(h)), 0
        while len(h):
            step += 1
            point = words.mix(h + np.uint64((step * 0x9E3779B97F4A7C15) % 2**64))
            time = time - np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / REGISTERS
            near = time <= reach[doc]
            h, doc, time = h[near], doc[near], time[near]
            np.minimum.at(registers.reshape(-1), doc * REGISTERS + (point[near] & np.uint64(REGISTERS - 1)).astype(np.int64), time)
        todo = todo[np.isinf(registers[todo]).any(axis=1)]  # a register that got nothing: look further
        registers[todo] = np.inf
        reach[todo] *= 2
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(registers / RATE) / math.log(BASE))
    return np.clip(np.where(np.isinf(registers), 0, level), 0, TOP).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """64-bit key of each band of each row."""
    parts = registers[:, : BANDS * ROWS].astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(words.numbers(BANDS, 29), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = words.mix(key ^ parts[:, :, k]) + np.uint64(0x9E3779B97F4A7C15)
    return key & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)


def likeliest(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of highest likelihood given set sizes and registers of both sides."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less

    def p(x):  # probability that one register is above the other
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def fit(j):
        above, below = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            return sum(np.where(k > 0, k * np.log(np.maximum(q, 1e-300)), 0.0) for k, q in ((more, above), (less, below), (same, 1 - above - below)))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        up = fit(x) < fit(y)
        low, high = np.where(up, x, low), np.where(up, high, y)
    return (low + high) / 2


def _table(batches, names):
    for b in batches:
        if b.num_rows:
            yield [b.column(n) for n in names]


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _signatures(docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """(id, n_shingles, f1, f2, sketch): fingerprint of the set in two longs."""

    def work(batches):
        for ids, texts in _table(batches, ["id", "text"]):
            for start, size in words.chunks(texts):
                sets = shingle_sets(texts.slice(start, size), n, lower)
                marks = np.array([[np.add.reduce(words.mix(s)), np.bitwise_xor.reduce(words.mix(s + np.uint64(77)))] if len(s) else [0, 0] for s in sets], np.uint64).view(np.int64)
                found = sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, size), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([r.tobytes() if len(s) else None for s, r in zip(sets, found)], pa.binary())],
                    names=["id", "n_shingles", "f1", "f2", "sketch"],
                )

    return docs.mapInArrow(work, "id long, n_shingles long, f1 long, f2 long, sketch binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, id) of every band of every class; a key's last six bits are its band."""

    def work(batches):
        for ids, sketch in _table(batches, ["id", "sketch"]):
            keys = band_keys(_stack(sketch)).view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids.to_numpy(), BANDS))], names=["key", "id"])

    return classes.select("id", "sketch").mapInArrow(work, "key long, id long")


def _sized(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _slots(sets: list[np.ndarray]) -> np.ndarray:
    return (words.mix(np.concatenate(sets)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _commonness(texts: DataFrame, n: int, lower: bool) -> np.ndarray:
    """How many sets' shingles fall into each of SLOTS slots; whatever the input, SLOTS numbers come to the driver."""

    def work(batches):
        total = np.zeros(SLOTS, np.int64)
        for (column,) in _table(batches, ["text"]):
            for start, size in words.chunks(column):
                total += np.bincount(_slots(shingle_sets(column.slice(start, size), n, lower)), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "c"])

    found = texts.select("text").mapInArrow(work, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["c"].to_numpy()
    return out


def _prefixes(texts: DataFrame, common: np.ndarray, n: int, lower: bool, percent: int) -> DataFrame:
    """(shingle, id, component, n, rest) of each set's rarest shingles; rest counts those from it on.

    All sets are put into one order, rare shingles first. The first shingle that two similar
    sets share has their whole intersection from it on, so no later one need be looked at.
    """

    def work(batches):
        for ids, parts, column in _table(batches, ["id", "component", "text"]):
            for start, size in words.chunks(column):
                sets = shingle_sets(column.slice(start, size), n, lower)
                count = np.array([len(x) for x in sets])
                doc, flat = np.repeat(np.arange(size), count), np.concatenate(sets)
                order = np.lexsort((flat, common[_slots(sets)], doc))
                rest = np.repeat(np.cumsum(count), count) - np.arange(len(flat))
                first = 100 * rest >= percent * count[doc]
                doc, rest, flat = doc[first], rest[first], flat[order][first]
                rows = pa.array(doc + start)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), ids.take(rows), parts.take(rows), pa.array(count[doc]), pa.array(rest)], names=["shingle", "id", "component", "n", "rest"])

    return texts.select("id", "component", "text").mapInArrow(work, "shingle long, id long, component long, n long, rest long")


def _across(texts: DataFrame, n: int, lower: bool, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle early enough to be similar."""
    rows = saved(_prefixes(texts, _commonness(texts, n, lower), n, lower, percent))
    mixed = rows.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("shingle")
    rows = saved(rows.join(mixed, "shingle", "left_semi"))
    left, right = (rows.select("shingle", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "n", "rest"))) for x in "ab")
    left = left.where((100 + percent) * F.col("rest_a") >= 2 * percent * F.col("n_a"))  # the smaller set of a pair
    met = left.join(right.withColumnRenamed("shingle", "k"), (F.col("shingle") == F.col("k")) & (F.col("component_a") != F.col("component_b")) & (F.struct("n_a", "id_a") < F.struct("n_b", "id_b")) & ((100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))))
    return met.select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b")).distinct()


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the set sizes allow and whose estimated similarity is near the threshold or above."""
    j = percent / 100
    least = j - SLACK * math.sqrt(j * (1 - j) / REGISTERS)
    sides = [classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"]
    wide = pairs.join(sides[0], "a").join(sides[1], "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def work(batches):
        for a, b, n_a, n_b, s_a, s_b in _table(batches, ["a", "b", "n_a", "n_b", "s_a", "s_b"]):
            good = likeliest(n_a.to_numpy(), n_b.to_numpy(), _stack(s_a), _stack(s_b)) >= least
            yield pa.RecordBatch.from_arrays([pa.array(a.to_numpy()[good]), pa.array(b.to_numpy()[good])], names=["a", "b"])

    return wide.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, lower: bool, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    named = _sized(saved(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))

    def sets_of(batches):
        for ids, texts in _table(batches, ["id", "text"]):
            for start, size in words.chunks(texts):
                yield pa.RecordBatch.from_arrays([ids.slice(start, size), pa.array([s.tobytes() for s in shingle_sets(texts.slice(start, size), n, lower)], pa.binary())], names=["id", "shingles"])

    sets = saved(docs.join(named, "id", "left_semi").mapInArrow(sets_of, "id long, shingles binary"))
    wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b")), "b")

    def work(batches):
        for a, b, s_a, s_b in _table(batches, ["a", "b", "s_a", "s_b"]):
            good = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(s_a, s_b)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a.to_numpy()[good]), pa.array(b.to_numpy()[good])], names=["a", "b"])

    return wide.select("a", "b", "s_a", "s_b").mapInArrow(work, "a long, b long").distinct()


def _few(table: DataFrame) -> DataFrame:
    """A saved table of ids in no more partitions than its rows need, so that small rounds make few shuffle files."""
    return table.coalesce(table.count() // ID_ROWS + 1)


def _forest(links: DataFrame) -> DataFrame:
    """(id, component) of links (a, b) with b < a and one link an a: the root that a's chain of links ends in."""
    labels = _few(saved(links.select(F.col("a").alias("id"), F.col("b").alias("component"))))
    while True:
        over = labels.select(F.col("id").alias("component"), F.col("component").alias("j"))
        new = _few(saved(labels.join(over, "component", "left").select("id", F.coalesce("j", "component").alias("component"), F.col("j").isNotNull().alias("moved"))))
        labels = new.select("id", "component")
        if new.where("moved").isEmpty():
            return labels


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that links (a, b) reach, for every id in a link.

    Labels pass along links and jump to their label's label until none changes.
    """
    both = _few(saved(links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()))
    labels = saved(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("component")))
    labels = _few(labels)
    while True:
        far = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("c")), "other").groupBy("id").agg(F.min("c").alias("c"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("j"))
        new = _few(saved(labels.join(far, "id").join(jump, "component").select("id", F.least("component", "c", "j").alias("component"), (F.least("c", "j") < F.col("component")).alias("moved"))))
        labels = new.select("id", "component")
        if new.where("moved").isEmpty():
            return labels


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (id, component of a lower id) with the components joined that links (a, b) connect.

    Links are taken between components, each pair once, so that rounds handle what is new in them alone.
    """
    of = [found.select(F.col("id").alias(x), F.col("component").alias(y)) for x, y in ("ax", "by")]
    ends = links.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a != b").distinct()
    ends = saved(ends)
    if ends.isEmpty():
        return found
    moved = components(ends).where("id != component")
    over = moved.select(F.col("id").alias("component"), F.col("component").alias("c"))
    return _few(saved(found.join(over, "component", "left").select("id", F.coalesce("c", "component").alias("component")).union(moved)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased with `lower`. Rows are linked when
    100 * intersection >= percent * union of their sets of distinct shingles; component_id
    is the smallest id reachable, kept says it is the row's own. A null, empty or wordless
    text has an empty set and is linked with nothing. A row with a null id is kept alone,
    its component null. Rows that share an id are one node; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = saved(_signatures(rows, shingle, lower))
    full = base.where("n_shingles > 0 and id is not null")
    classes = full.groupBy("f1", "f2").agg(F.min(F.struct("id", "n_shingles", "sketch")).alias("c")).select("f1", "f2", "c.*")
    classes = saved(classes)
    buckets = _buckets(classes)
    leads = buckets.groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = saved(buckets.join(leads, "key"))
    # one pair a class: with the lowest of all that share a bucket with it
    pairs = met.groupBy("id").agg(F.min("low").alias("b")).where("b < id").select(F.col("id").alias("a"), "b")
    texts = rows.where("id is not null")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return saved(_verified(saved(_likely(pairs, classes, percent)), texts, shingle, lower, percent))

    def still_apart(met: DataFrame, found: DataFrame) -> DataFrame:
        """(key, id, component) of the buckets that hold several components."""
        now = met.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        mixed = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
        return saved(now.join(mixed, "key"))

    found = _forest(confirmed(pairs))
    apart = still_apart(met, found)
    for k in range(ROUNDS):
        # a leader of the bucket's largest component, another in every bucket, for what is not in it
        sides = apart.groupBy("key", "component").agg(F.min_by("id", F.xxhash64("id", "key", F.lit(k))).alias("lead"), F.count("*").alias("c"))
        leads = sides.groupBy("key").agg(F.max_by("lead", "c").alias("lead"), F.max_by("component", "c").alias("its"))
        led = apart.join(leads, "key").where("component != its").groupBy("id", "its").agg(F.min("lead").alias("lead"))
        pairs = led.select(F.greatest("id", "lead").alias("a"), F.least("id", "lead").alias("b")).distinct()
        more = confirmed(pairs)
        if more.isEmpty():
            break
        found = _merged(found, more)
        before, apart = apart.count(), still_apart(apart, found)
        if apart.count() > (1 - WORTH) * before:
            break
    own = saved(apart.select("id", "component").distinct())
    found = _merged(found, confirmed(_across(texts.join(_sized(own), "id"), shingle, lower, percent)))
    same = full.join(classes.select("f1", "f2", F.col("id").alias("first")), ["f1", "f2"]).where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    # ids of a class follow its first; an id with several texts joins their classes
    split = base.groupBy("id").agg(F.countDistinct("f1", "f2").alias("k")).where("k > 1 and id is not null")
    if not split.isEmpty():
        found = _merged(found, same)
    member = same.join(found.select(F.col("id").alias("b"), "component"), "b", "left").groupBy("a").agg(F.min(F.coalesce("component", "b")).alias("component"))
    every = found.union(member.select(F.col("a").alias("id"), "component")).groupBy("id").agg(F.min("component").alias("component_id"))
    out = base.select("id", "n_shingles").join(every, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
