"""Operator: line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate of a host when the share of the host's pages that hold it is above
a ratio. Lines are counted as 128-bit hashes, combined before the shuffle, so a host or
a line with a third of all rows is one row per task. A host has at most its mean number
of lines per page over the ratio of such lines. They return to the pages by a broadcast
while all of them together are at most BROADCAST_LINES, else by a join on the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, saved

#: 16 bytes each: about 3 MB broadcast.
BROADCAST_LINES = 200_000


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float, least: int) -> DataFrame:
    """(host, lines): hashes of the lines on more than `ratio` of the host's pages and on at least `least` of them."""
    rows = pages.select(F.col(host_col).alias("host"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("ls"))
    marks = F.array_distinct(F.transform(F.filter("ls", lambda x: _trimmed(x) != ""), lambda x: _mark(_trimmed(x))))
    # outer, since Spark would compute the lines again to leave out pages without any
    lines = rows.select("host", F.explode_outer(marks).alias("m")).where("m is not null")
    often = lines.groupBy("host", "m").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    totals = pages.groupBy(F.col(host_col).alias("h")).agg(F.count("*").alias("pages"))  # reads no text
    found = often.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("c") > F.lit(ratio) * F.col("pages"))
    return found.groupBy("host").agg(F.collect_list("m").alias("lines"))


def drop_boilerplate(pages: DataFrame, host_col: str = "host", text_col: str = "text", ratio: float = 0.1, least: int = 10, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """pages with boilerplate lines taken out of the text, and the two `counts` (long) of lines and of those dropped.

    Lines are split at newlines and compared without the ASCII white space around them; blank
    lines are neither counted nor dropped (the first count has the others). Every row stays, with
    all columns and ids as they are; a null text stays null, and a null host is a host of its own.
    Existing columns of the names in `counts` are replaced; counts=None adds and replaces none.
    Repeated rows count as pages of their own. An empty table gives no rows.
    """
    if counts:
        pages = pages.drop(*counts)
    host, known, kept_col = fresh(pages, "_host", "_lines", "_kept")
    found = saved(boilerplate(pages, host_col, text_col, ratio, least))
    size = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    of = found.select(F.col("host").alias(host), F.col("lines").alias(known))
    wide = pages.join(F.broadcast(of) if size <= BROADCAST_LINES else of, F.col(host_col).eqNullSafe(F.col(host)), "left")
    split = F.split(F.col(text_col), "\n")
    kept = F.filter(split, lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col(known), _mark(_trimmed(x))))
    wide = wide.withColumn(kept_col, F.when(F.col(known).isNull(), split).otherwise(kept))
    columns = [F.when(F.col(known).isNull(), F.col(c)).otherwise(F.array_join(kept_col, "\n")).alias(c) if c == text_col else F.col(c) for c in pages.columns]
    if counts:
        before = F.size(F.filter(split, lambda x: _trimmed(x) != ""))
        for name, n in zip(counts, (before, F.size(split) - F.size(kept_col))):
            columns.append(F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n).cast("long").alias(name))
    return wide.select(*columns)


#: Elements whose content is no text, and elements that stay within a line (fixed values).
UNSEEN = ("script", "style", "template", "noscript")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "cite", "code", "em", "font", "i", "kbd", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "u", "var", "wbr")
HIDDEN = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in UNSEEN)
WITHIN, TAG = rf"(?is)</?(?:{'|'.join(INLINE)})(?:\s[^>]*)?>", r"(?s)<[^>]*>"


def lines_of_html(html: Column) -> Column:
    """The text of a page: comments and unseen elements go, every tag but the inline ones ends a line."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, "\n"), WITHIN, ""), TAG, "\n")
