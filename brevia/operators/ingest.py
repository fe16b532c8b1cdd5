"""From listing pages to the forms worth keeping (O-05, O-06, O-21, O-36, O-48, O-60, O-63, O-64)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevia.functions import text as T

#: Path part of documents, path part of English ones, extensions kept, modern ones (fixed values).
DOCUMENTS, ENGLISH = "/kalite/", "Formlar-İngilizce"
KEPT = ("docx", "xlsx", "xlsm", "pdf", "doc", "xls")
MODERN = ("docx", "xlsx")


#: A link whose double-quoted target holds the word (fixed value).
LINK = r'(?is)<a\b[^>]*href\s*=\s*"([^"]*{word}[^"]*)"[^>]*>(.*?)</a>'


def parse_listing(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", word: str = "fileman") -> DataFrame:
    """(id, pos, href, label) of the double-quoted links whose target holds `word`, in page order."""
    pattern = F.lit(LINK.replace("{word}", word))
    links = F.arrays_zip(F.regexp_extract_all(F.col(html_col), pattern, F.lit(1)).alias("href"), F.regexp_extract_all(F.col(html_col), pattern, F.lit(2)).alias("label"))
    rows = pages.select(F.col(id_col), F.posexplode(links).alias("pos", "a"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("a.label"), r"<[^>]+>", " "), "&nbsp;", " "), "&amp;", "&")
    return rows.select(id_col, "pos", F.col("a.href").alias("href"), F.btrim(F.regexp_replace(plain, r"(?U)\s+", " ")).alias("label"))


def unquoted(text: Column) -> Column:
    """Percent escapes decoded as UTF-8; a plus and a percent sign that begins no escape stay."""
    return F.url_decode(F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def listing_columns(links: DataFrame, origin: str, documents: str = DOCUMENTS, english: str = ENGLISH) -> DataFrame:
    """links with path, url (both decoded), name, ext, lang, code, rev and title; origin is the site root of relative links."""
    out = links.withColumn("path", unquoted(F.col("href")))
    out = out.withColumn("url", F.when(F.startswith("path", F.lit("http")), F.col("path")).otherwise(F.concat(F.lit(origin), "path")))
    out = out.withColumn("name", F.substring_index("path", "/", -1))
    dot = F.instr("name", ".") > 0
    out = out.withColumn("ext", F.lower(F.substring_index("name", ".", -1))).withColumn("stem", F.when(dot, F.expr("substring(name, 1, char_length(name) - char_length(substring_index(name, '.', -1)) - 1)")).otherwise(""))
    out = out.withColumn("lang", F.when(F.contains("path", F.lit(documents)), F.when(F.contains("path", F.lit(english)), "en").otherwise("tr")))
    return out.select("*", T.ingest_code(F.col("stem"), F.col("label")).alias("code"), T.revision(F.col("stem")).alias("rev"), T.title_of(F.col("stem")).alias("title"))


def first_by_url(rows: DataFrame, pos_col: str = "pos") -> DataFrame:
    """The first row of each url."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(pos_col))).where("_n = 1").drop("_n")


def cull_reason(rows: DataFrame) -> DataFrame:
    """rows with cull_reason, null for those to keep; a code is not needed."""
    return rows.withColumn("cull_reason", F.when(F.col("lang").isNull(), "outside the document folder").when(~F.coalesce(F.col("ext").isin(*KEPT), F.lit(False)), F.concat(F.lit("unreadable format ."), F.coalesce("ext", F.lit("")))))


def best_revision(rows: DataFrame, pos_col: str = "pos") -> DataFrame:
    """rows with superseded: null for the best of each (code or name, lang), else why it is not.

    Best: highest revision, then a modern format, then first listed.
    """
    own = Window.partitionBy(F.coalesce("code", "name"), "lang").orderBy(F.desc("rev"), F.desc(F.col("ext").isin(*MODERN)), pos_col)
    best, name, n = F.first_value("rev").over(own), F.first_value("name").over(own), F.row_number().over(own)
    why = F.when(F.col("rev") < best, F.concat(F.lit("superseded by R"), best, F.lit(" ("), name, F.lit(")"))).otherwise(F.concat(F.lit("duplicate of "), name))
    return rows.withColumn("superseded", F.when(n > 1, why))


def stale(existing: DataFrame, written: DataFrame, limited: bool = False) -> DataFrame:
    """ids on disk that this run did not write; none when the run was limited."""
    gone = existing.select("id").join(written.select("id"), "id", "left_anti")
    return gone.where(F.lit(not limited))


def report(rows: DataFrame) -> DataFrame:
    """One row of counts: listed, kept, culled, documents, no_text."""
    return rows.agg(
        F.count("*").alias("listed"),
        F.count_if(F.col("cull_reason").isNull()).alias("kept"),
        F.count_if(F.col("cull_reason").isNotNull()).alias("culled"),
        F.count_if(F.col("cull_reason").isNull() & F.col("superseded").isNull()).alias("documents"),
        F.count_if(F.col("cull_reason").isNull() & F.col("superseded").isNull() & (F.coalesce(F.char_length("text"), F.lit(0)) == 0)).alias("no_text"),
    )


def report_rows(rows: DataFrame) -> DataFrame:
    """(list, url, name, reason) of the report's lists: culled, superseded, no_text, no_code."""
    kept = F.col("cull_reason").isNull() & F.col("superseded").isNull()
    lists = (
        ("culled", F.col("cull_reason").isNotNull(), F.col("cull_reason")),
        ("superseded", F.col("cull_reason").isNull() & F.col("superseded").isNotNull(), F.col("superseded")),
        ("no_text", kept & (F.coalesce(F.char_length("text"), F.lit(0)) == 0), F.lit(None).cast("string")),
        ("no_code", kept & F.col("code").isNull(), F.lit(None).cast("string")),
    )
    found = F.filter(F.array(*(F.when(when, F.struct(F.lit(name).alias("list"), reason.alias("reason"))) for name, when, reason in lists)), lambda x: x.isNotNull())
    return rows.select("url", "name", F.explode(found).alias("x")).select("x.list", "url", "name", "x.reason")


def composed(text):
    """Unicode normal form C: Spark has no function for it, but calls that of the ICU library that it brings."""
    return F.when(text.isNotNull(), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False)))


def clean_text(text):
    return T.tidy(composed(text))
