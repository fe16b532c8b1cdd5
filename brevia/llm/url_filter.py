"""Operator: URL filter by rules and by empirical-Bayes host reputation.

Labelled page outcomes (1: bad) are counted per host, registered domain and suffix.
Each level has a beta-binomial prior centred on the posterior mean of the level above,
the whole table's at the top, with a strength in pseudo-pages. A host whose posterior
mean plus z posterior deviations is above the limit is blocked unless a rule speaks.
Counts are combined before any shuffle, so a host with a third of the pages is one row
per task; verdicts return to the pages through a join that Spark can split when skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Second-level labels that act as part of a public suffix under a two-letter country label (fixed values).
SECOND_LEVEL = (
    "ac", "ad", "asn", "asso", "biz", "co", "com", "ed", "edu", "firm", "gen", "go", "gob", "gouv", "gov", "govt", "gub", "id", "ind", "info",
    "k12", "lg", "ltd", "me", "mil", "ne", "net", "nhs", "nic", "nom", "or", "org", "plc", "police", "pro", "res", "sch", "school", "web",
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two for a second-level label under a country's."""
    two = F.regexp_extract(host, rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1)
    return F.when(two != "", two).otherwise(F.substring_index(host, ".", -1))


def with_suffix(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts with domain and suffix: the longest of `suffixes` (suffix) that ends the host, else that of suffix_of().

    suffixes: public suffixes of whatever list the caller has, such as `co.uk`; null for none.
    domain: the suffix and the label before it, or the host itself when it has no more labels.
    """
    if suffixes is None:
        out = hosts.withColumn("suffix", suffix_of(F.col("host")))
    else:
        labels = F.split("host", r"\.")
        ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
        listed = hosts.select("host", F.explode(ends).alias("suffix")).join(suffixes.select("suffix").distinct(), "suffix", "left_semi")
        best = listed.groupBy("host").agg(F.max_by("suffix", F.length("suffix")).alias("listed"))
        out = hosts.join(best, "host", "left").withColumn("suffix", F.coalesce("listed", suffix_of(F.col("host")))).drop("listed")
    return out.withColumn("domain", F.call_function("substring_index", F.col("host"), F.lit("."), -(F.size(F.split("suffix", r"\.")) + 1)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest rule whose host is the host or a parent and whose path starts the path.

    rules: (action, "host/path"). Ties in length go to the alphabetically first.
    """
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def reputation(outcomes: DataFrame, strength: float = 10.0, z: float = 1.0, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, mean, bound) from outcomes (host, bad 0/1; null bad, and null or empty host: not counted).

    bound is the lower posterior bound of the bad rate: mean minus z posterior deviations.
    An empty table gives no rows.
    """
    seen = outcomes.select("host", F.col("bad").cast("long").alias("bad")).where("host != '' and bad is not null")
    hosts = seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = with_suffix(hosts, suffixes)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    whole = suffixes.agg(((F.sum("sb") + 0.5) / (F.sum("sn") + 1.0)).alias("base"))
    k = F.lit(float(strength))
    suffixes = suffixes.join(F.broadcast(whole)).select("suffix", ((F.col("sb") + k * F.col("base")) / (F.col("sn") + k)).alias("sm"))  # whole: one row
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("db") + k * F.col("sm")) / (F.col("dn") + k)).alias("dm"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    a, b = F.col("bad") + k * F.col("dm"), F.col("n") - F.col("bad") + k * (1 - F.col("dm"))
    mean = a / (a + b)
    return hosts.select("host", "n", "bad", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], limit: float, id_col: str = "page_id", url_col: str = "url", strength: float = 10.0, z: float = 1.0, suffixes: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, bound) for every page.

    A null url, or one without `://`, has an empty host and path; such pages are of no site,
    so they have no reputation and are allowed unless a rule speaks. The verdict is the
    longest fitting rule's, else `block` when the host's lower posterior bound of the bad
    rate is above the limit, else `allow`; hosts without outcomes are allowed (bound null).
    Repeated and null ids stay as rows; an empty table gives no rows; other columns are not read.
    """
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    rows = rows.select(id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    known = reputation(outcomes, strength, z, suffixes).select("host", "bound")
    blocked = F.coalesce(F.col("bound") > F.lit(limit), F.lit(False))
    verdict = F.coalesce(action, F.when(blocked, "block").otherwise("allow"))
    return rows.join(known, "host", "left").select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.round("bound", 6).alias("bound"))
