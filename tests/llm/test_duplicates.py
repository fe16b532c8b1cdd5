"""Near-duplicates, repeated windows and boilerplate lines against brute force."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brevia.llm import line_dedup, near_dedup, substring_dedup
from brevia.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def texts(n=220, seed=1):
    rnd = random.Random(seed)
    vocabulary = [rnd.choice("abcdefgh") * rnd.randint(1, 3) + str(rnd.randint(0, 400)) for _ in range(500)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([1, 5, 25, 60, 150]))] for _ in range(40)]
    out = []
    for _ in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, max(1, len(w) // 12))):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        if rnd.random() < 0.3:
            w += rnd.choice(base)[:30]
        if rnd.random() < 0.2:
            w *= 2
        out.append(rnd.choice([" ", "\n", " \t"]).join(w))
    return [*out, None, "", " \n ", "x", "X", "x y", out[0], out[0], "\x85a b", "p q " * 300]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "x", k % 3) for k, t in enumerate(rows)], "doc_id long, text string, id string, key int").repartition(5)


def shingles(t, n, lower=True):
    w = WORD.findall((t or "").translate(LOWER) if lower else t or "")
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent=80):
    sets = [shingles(t, n) for t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b in range(len(rows)):
        for a in range(b):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(k) for k in range(len(rows))], [len(s) for s in sets]


@pytest.mark.parametrize("n", [2, 5])
def test_components(spark, n):
    rows = texts()
    expected, sizes = brute_components(rows, n)
    got = {r.doc_id: r for r in near_dedup.dedup(frame(spark, rows), shingle=n).collect()}
    assert [got[k].component_id for k in range(len(rows))] == expected
    assert [got[k].n_shingles for k in range(len(rows))] == sizes
    assert all(got[k].kept == (expected[k] == k) for k in got)


def test_near_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "d e f"), (3, "d e f"), (9, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.dedup(df, shingle=2).collect())
    assert got == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False)]
    assert near_dedup.dedup(df.where(F.lit(False))).count() == 0


def test_sketch_estimates():
    rnd = np.random.default_rng(2)
    base = rnd.integers(0, 2**63, 2000).astype(np.uint64)
    for share in (0.3, 0.6, 0.8, 0.95):
        common = int(2000 * share)
        a, b = np.unique(base[:2000]), np.unique(np.concatenate([base[:common], rnd.integers(0, 2**63, 2000 - common).astype(np.uint64)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = near_dedup.sketches([a, b])
        est = near_dedup.likeliest(np.array([len(a)]), np.array([len(b)]), s[:1], s[1:])[0]
        assert abs(est - j) < 5 * (j * (1 - j) / near_dedup.REGISTERS) ** 0.5 + 0.01
        union = near_dedup.sketches([np.union1d(a, b)])
        assert (union == np.maximum(s[:1], s[1:])).mean() > 0.999  # registers merge


def brute_windows(rows, window):
    seen, out = set(), []
    for t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [8, 20])
def test_windows(spark, window):
    rows = texts(150, 3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, rows), window=window, digest=True).collect()}
    assert [got[k] for k in range(len(rows))] == brute_windows(rows, window)


def test_windows_edges(spark):
    long = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, long), (2, long), (4, long), (6, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(-1, 30, 0), (2, 30, 0), (4, 30, 30), (6, 0, 0)]
    assert substring_dedup.remove_repeats(df.where(F.lit(False))).count() == 0


def test_matching_statistics():
    rnd = np.random.default_rng(4)
    lengths = rnd.integers(6, 20, 40)
    text = rnd.integers(1, 5, lengths.sum()).astype(np.int32)
    index = FMIndex(text, lengths, 5)
    segs = np.split(text, np.cumsum(lengths)[:-1])
    first = np.cumsum(lengths) - lengths
    for most in (4, 9):
        counts = Counter(tuple(s[k : k + n]) for s in segs for n in range(1, most + 1) for k in range(len(s) - n + 1))
        ends = np.concatenate([first[s] + np.arange(1, lengths[s] + 1) for s in range(40)])
        room = np.concatenate([np.arange(1, lengths[s] + 1) for s in range(40)])
        length, low, high = index.matching(text, ends, room, most)
        for e, r, n, a, b in zip(ends.tolist(), room.tolist(), length.tolist(), low.tolist(), high.tolist()):
            best = max((k for k in range(1, min(r, most) + 1) if counts[tuple(text[e - k : e])] > 1), default=0)
            assert n == best and b - a == (counts[tuple(text[e - n : e])] if n else 0)


def test_windows_of_odd_texts(spark):
    """A very long text, one that repeats itself, empty and wordless texts, clashing columns, an unknown input size."""
    own = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, own), (2, "a " * 20_000), (3, ""), (4, " \n"), (5, own[: own.index("w500 ")]), (6, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "ranges", "shard", "payload")})
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == {1: (40_000, 0), 2: (20_000, 19_999), 3: (0, 0), 4: (0, 0), 5: (500, 500), 6: (1, 0)}


def test_lines(spark):
    rows = [(k, "h1" if k < 12 else None if k < 15 else "h2", "menu\n" + (" menu \n\n" if k % 2 else "") + f"own {k}\nshared" if k != 3 else None) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string").withColumn("n_lines", F.lit("old"))
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, ratio=0.5, least=3).collect()}
    counts, pages = defaultdict(Counter), Counter()
    for _, h, t in rows:
        pages[h] += 1
        counts[h].update({x.strip() for x in (t or "").split("\n") if x.strip()})
    for k, h, t in rows:
        if t is None:
            assert got[k].text is None and got[k].n_lines == got[k].n_dropped == 0
            continue
        keep = [x for x in t.split("\n") if not x.strip() or not (counts[h][x.strip()] >= 3 and counts[h][x.strip()] > 0.5 * pages[h])]
        assert got[k].text == "\n".join(keep) and got[k].n_dropped == len(t.split("\n")) - len(keep)
    assert line_dedup.drop_boilerplate(df.where(F.lit(False))).count() == 0
    by_join = pytest.MonkeyPatch()
    by_join.setattr(line_dedup, "BROADCAST_LINES", -1)
    assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df, ratio=0.5, least=3).collect()} == {k: r.text for k, r in got.items()}
    by_join.undo()


def test_word_arrays():
    from brevia.llm import words

    column = pa.array(["a b\n", None, "", "  x\x0bé ", "a b"])
    w = words.words(column)
    assert np.diff(w.first).tolist() == [2, 0, 0, 2, 2] and (w.hash[:2] == w.hash[4:]).all()
    assert [n for _, n in words.chunks(column, 4)] == [2, 1, 1, 1] or sum(n for _, n in words.chunks(column, 4)) == 5


@pytest.mark.parametrize("partitions", [1, 2])
def test_repeated_rows_keep_their_words(spark, partitions):
    own, other = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, own), (7, own), (2, other + " " + other)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows + rows, partitions), "doc_id long, text string")
    assert df.rdd.getNumPartitions() == partitions
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(2, 60, 30)] * 2 + [(5, 60, 0)] * 2 + [(7, 60, 60)] * 2
