"""Registered queries of the llm operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, line_dedup, near_dedup, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, token_counts, url_filter
from .common import one_line, saved, table

MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = chat_format.read_back(chat_format.from_contexts(chat_format.expand(turns)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("replies", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        F.col("n_examples").cast("long").alias("n_examples"),
    )


OP1_SQL = r"""
with extra as (select * from (values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')) v(conv_id, turn, role, text)),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select * from extra)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(25 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::bigint - count(*) as formatted_chars,
  count(*) filter (where role = 'assistant') as n_examples
from t group by conv_id
"""

#: (action, host/path) of the page filter.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
URL_LIMIT, URL_STRENGTH, URL_Z = 0.3, 10.0, 1.0


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels row with a page's id as doc_id labels the page, bad when of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    outcomes = pages.join(labels, "page_id").select(url_filter.host_of(F.col("url")).alias("host"), "bad")
    return url_filter.judge(pages, outcomes, URL_RULES, URL_LIMIT, strength=URL_STRENGTH, z=URL_Z)


OP3_SQL = r"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
h as (select host, count(*) as n, sum(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from p join labels l on l.doc_id = p.page_id where host <> '' group by host),
h2 as (select *, case when regexp_matches(host, '(^|[.])(SECOND)[.][a-z]{2}$') then array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') else string_split(host, '.')[-1] end as suffix from h),
h3 as (select *, array_to_string(list_slice(string_split(host, '.'), -(len(string_split(suffix, '.')) + 1), -1), '.') as domain from h2),
d as (select domain, suffix, sum(n) as dn, sum(bad) as db from h3 group by domain, suffix),
s as (select suffix, sum(dn) as sn, sum(db) as sb from d group by suffix),
w as (select (sum(sb) + 0.5) / (sum(sn) + 1.0) as base from s),
sm as (select suffix, (sb + 10.0 * base) / (sn + 10.0) as sm from s, w),
dm as (select d.domain, d.suffix, (db + 10.0 * sm) / (dn + 10.0) as dm from d join sm using (suffix)),
ab as (select host, bad + 10.0 * dm as a, n - bad + 10.0 * (1 - dm) as b from h3 join dm using (domain, suffix)),
r as (select host, (a / (a + b) - 1.0 * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)))::double as bound from ab),
u(action, domain, start, rule) as (values ('allow', 'com', '/', 'com/'), ('block', 'example.com', '/en/', 'example.com/en/'), ('allow', 'www.example.com', '/en/', 'www.example.com/en/'), ('block', 'net', '/es/', 'net/es/'), ('block', 'net', '/fr/', 'net/fr/')),
m as (select page_id, max_by(rule, length(rule)) as rule, max_by(action, length(rule)) as action from p join u on (host = domain or ends_with(host, '.' || domain)) and starts_with(path, start) group by page_id)
select p.page_id, p.host, p.path, m.rule, coalesce(m.action, case when r.bound > 0.3 then 'block' else 'allow' end) as verdict, round(r.bound, 6) as bound
from p left join r using (host) left join m using (page_id)
""".replace("SECOND", "|".join(url_filter.SECOND_LEVEL))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), model_path())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model_path())


def learning_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that learning may read: those that are not held out."""
    return table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_classifier.fit(docs, learning_labels(spark, sf_dir))
    scored = quality_classifier.score(docs, weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20, digest=True)


OP4_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
x as (select doc_id, i, md5(array_to_string(ws[i : i + 19], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w)),
f as (select doc_id, i, row_number() over (partition by h order by doc_id, i) as n from x),
g as (select distinct doc_id, i + k as j from (select doc_id, i, unnest(range(0, 20)) as k from f where n > 1)),
t as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from w),
k as (select t.doc_id, count(*) as n_kept, string_agg(word, ' ' order by t.j) as kept from t anti join g on t.doc_id = g.doc_id and t.j = g.j group by t.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n_kept, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k on w.doc_id = k.doc_id
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Share of a host's pages above which a line is boilerplate, and the pages that must hold it at least.
PAGE_RATIO, PAGE_LEAST = 0.1, 3


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the hosts of the pages' urls; lines are those of the pages' visible text."""
    pages = table(spark, sf_dir, "pages").select("page_id", url_filter.host_of(F.col("url")).alias("host"), line_dedup.lines_of_html(F.col("html")).alias("text"))
    out = line_dedup.drop_boilerplate(pages, "host", "text", PAGE_RATIO, PAGE_LEAST)
    return out.select("page_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


LINES_SQL = r"""
with s as (SITES),
l as (select id, site, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''))) as line from s),
n as (select site, count(*) as pages from s group by site),
c as (select site, line, count(*) as c from l group by site, line),
b as (select site, list(line) as bad from c join n using (site) where c >= LEAST_PAGES and c > RATIO * pages group by site),
k as (select id, ls, list_filter(ls, lambda x: not list_contains(coalesce(bad, []), trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) or trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '') as kept from s left join b using (site))
select id as ID, coalesce(len(list_filter(ls, lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')), 0) as n_lines,
  coalesce(len(ls) - len(kept), 0) as n_dropped, sha256(array_to_string(kept, chr(10))) as kept_sha256 from k
"""


def _lines_sql(sites: str, id_col: str, ratio: float, least: int) -> str:
    return LINES_SQL.replace("SITES", sites).replace("LEAST_PAGES", str(least)).replace("RATIO", str(ratio)).replace("id as ID", f"id as {id_col}")


OP7_SQL = _lines_sql(
    "select page_id as id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as site, "
    f"string_split(regexp_replace(regexp_replace(regexp_replace(html, '{line_dedup.HIDDEN}', chr(10), 'g'), '{line_dedup.WITHIN}', '', 'g'), '{line_dedup.TAG}', chr(10), 'g'), chr(10)) as ls from pages",
    "page_id",
    PAGE_RATIO,
    PAGE_LEAST,
)

#: The same of documents by source. Between ordinary lines (on at most 4.8 % of a source's documents of sf0.1) and boilerplate (8.6 % at least); sites of three pages can lose lines.
LINE_RATIO, LINE_LEAST = 0.06, 3


def op7_line_dedup_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the documents' sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs, "source", "text", LINE_RATIO, LINE_LEAST)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SOURCES_SQL = _lines_sql("select doc_id as id, source as site, string_split(text, chr(10)) as ls from documents", "doc_id", LINE_RATIO, LINE_LEAST)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)


OP9_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sets as (select doc_id, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from w),
s as (select doc_id, len(sh) as n, unnest(sh) as x from sets),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c from s a join s b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
e as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
e2 as (select a, b from e union all select b, a from e),
r as (select doc_id, doc_id as root from w union select r.doc_id, e2.b from r join e2 on r.root = e2.a)
select doc_id, len(sh)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join (select doc_id, min(root) as component_id from r group by doc_id) using (doc_id)
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(quality_rules.statistics(table(spark, sf_dir, "documents")))  # a few numbers per document
    rules = quality_rules.learn(stats, learning_labels(spark, sf_dir))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & quality_rules.verdict(rules)).alias("kept"), quality_rules.rule_number(rules).alias("rule"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_url_filter": op3_url_filter,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op7_line_dedup_sources": op7_line_dedup_sources,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES: dict[str, str] = {
    name: one_line(sql)
    for name, sql in {
        "op1_chat_format": OP1_SQL,
        "op3_url_filter": OP3_SQL,
        "op4_substring_dedup": OP4_SQL,
        "op7_line_dedup": OP7_SQL,
        "op7_line_dedup_sources": OP7_SOURCES_SQL,
        "op9_near_dedup": OP9_SQL,
    }.items()
}
