"""Operator: quality rules as a learnt decision list, in DataFrame functions only.

statistics() computes a text's numbers. learn() bins the labelled texts' ratios at
percentiles, counts them in one joint histogram of at most BINS**5 * 4 cells, and grows
rules on it by sequential covering: a conjunction of thresholds is grown condition by
condition for information gain on one fold, pruned on the other, kept if precise, and
what it covers is taken out before the next. The list becomes one Spark `when` chain.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

WINDOW = 8
BINS = 8
#: Rules and conditions of a rule at most; the share of bad texts that a kept rule needs; the texts it covers at least.
RULES, CONDITIONS, PRECISION, LEAST = 8, 3, 0.8, 5

#: Ratios that rules may test, from the columns of statistics().
RATIOS = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
}


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda that names an expression would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """Hash of the WINDOW words from each word on."""
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n >= WINDOW, let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Number of words covered by the windows whose hash another window has, the first included."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def shared(ps: Column) -> Column:
        marked = F.transform(ps, lambda p, k: F.when((F.get(ps, k - 1)["h"] == p["h"]) | (F.get(ps, k + 1)["h"] == p["h"]), p["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def total(at: Column) -> Column:
        new = F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    return let(let(pairs, shared), total)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper), longs, per row.

    A null or empty text has zeros. Rows with null or repeated ids stay; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"))
    rows = rows.withColumn("ws", F.filter(F.split("text", SPACE), lambda w: w != ""))
    rows = rows.withColumn("ls", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    rows = rows.withColumn("windows", _windows(F.col("ws")))
    rows = rows.select(
        id_col,
        F.size("ws").cast("long").alias("n_words"),
        F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("ls").cast("long").alias("n_lines"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return rows


@dataclass(frozen=True)
class Rule:
    """Conditions (ratio, '<' or '>=', threshold) that must all hold, and the label of texts that meet them."""

    conditions: tuple[tuple[str, str, float], ...]
    bad: bool = True

    def column(self) -> Column:
        met = F.lit(True)
        for name, sign, at in self.conditions:
            value = F.expr(RATIOS[name])
            met = met & (value < at if sign == "<" else value >= at)
        return met


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Rule]:
    """Rules from stats joined with labels (1: good); null labels are not used, no label gives no rule."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("y is not null")
    rows = stats.join(known, stats[id_col] == known["id"]).select(*(F.expr(e).cast("double").alias(n) for n, e in RATIOS.items()), "y", (F.abs(F.xxhash64("id")) % 3 == 0).alias("prune"))
    cuts = [k / BINS for k in range(1, BINS)]
    edges = rows.agg(*(F.percentile_approx(F.when(F.col("y") == 0, F.col(n)), cuts).alias(n) for n in RATIOS), *(F.percentile_approx(n, [0.5, 0.9, 0.99]).alias(f"{n}_all") for n in RATIOS)).first()
    at: dict[str, list[float]] = {}
    for n in RATIOS:
        found = sorted({*(edges[n] or ()), *(edges[f"{n}_all"] or ())})
        at[n] = found if len(found) < BINS else [found[(k + 1) * len(found) // BINS] for k in range(BINS - 1)]
    binned = rows.select(*(sum((F.col(n) >= e).cast("int") for e in at[n]).alias(n) if at[n] else F.lit(0).alias(n) for n in RATIOS), "y", "prune")
    cells = [(tuple(r[n] for n in RATIOS), r["y"] == 0, r["prune"], r["c"]) for r in binned.groupBy(*RATIOS, "y", "prune").agg(F.count("*").alias("c")).collect()]  # bounded by the bins
    return _cover(cells, at)


def _cover(cells, at: dict[str, list[float]]) -> list[Rule]:
    names = list(at)
    tests = [(k, sign, e) for k, n in enumerate(names) for e in range(1, len(at[n]) + 1) for sign in ("<", ">=")]

    def meets(bins, rule):
        return all(bins[k] < e if sign == "<" else bins[k] >= e for k, sign, e in rule)

    def counts(rule, prune):
        bad = good = 0
        for bins, is_bad, fold, c in cells:
            if fold == prune and meets(bins, rule):
                bad, good = bad + c * is_bad, good + c * (not is_bad)
        return bad, good

    rules = []
    while len(rules) < RULES:
        rule: list = []
        while len(rule) < CONDITIONS:
            inside = [x for x in cells if not x[2] and meets(x[0], rule)]
            sums: dict = defaultdict(lambda: [0, 0])
            for bins, is_bad, _, c in inside:
                for k, b in enumerate(bins):
                    sums[k, b][not is_bad] += c
            p0, n0 = sum(c for _, b, _, c in inside if b), sum(c for _, b, _, c in inside if not b)
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for k, sign, e in tests:
                p, n = (sum(v[side] for (kk, b), v in sums.items() if kk == k and (b < e if sign == "<" else b >= e)) for side in (0, 1))
                if p and (g := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > gain:
                    best, gain = (k, sign, e), g
            if best is None:
                break
            rule.append(best)
        if not rule:
            break

        def worth(r):  # reduced-error pruning: how much more bad than good it takes from the other fold
            bad, good = counts(r, True)
            return (bad - good) / (bad + good) if bad + good else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        bad, good = (sum(x) for x in zip(counts(rule, True), counts(rule, False)))
        if bad + good < LEAST or bad < PRECISION * (bad + good):
            break
        rules.append(Rule(tuple((names[k], sign, float(at[names[k]][e - 1])) for k, sign, e in rule)))
        cells = [x for x in cells if not meets(x[0], rule)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for texts to keep: the first rule that holds decides; none: keep."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(not rule.bad)) if out is None else out.when(rule.column(), F.lit(not rule.bad))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def rule_number(rules: list[Rule]) -> Column:
    """Number from 1 of the first rule that holds, or null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(), F.lit(k)).otherwise(out)
    return out
