"""Registered retrieval queries, each with its DuckDB equivalent."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevia import app, tables
from brevia.functions import text as T
from brevia.operators import chunking, dense, fusion, ingest, lexical, session
from brevia.plans import bindings as on
from brevia.sources import index_store

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = re.sub(r"[ \t\n]+", " ", sql.replace("\n", " ")).strip()
        return f

    return put


def joined(name: str, sep: str = "|"):
    return F.array_join(F.col(name), sep).alias(name)


# SQL of shared parts. DuckDB's patterns have \p{L} where the engine has \p{IsAlphabetic}.
def FOLD(t):
    return f"lower(translate({t}, 'IİΣ', 'ıiσ'))"


def WORDS(t):
    return rf"list_filter(string_split_regex({FOLD(t)}, '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 2 or regexp_matches(w, '^\p{{N}}'))"


def TOKENS(t):
    return f"flatten(list_transform({WORDS(t)}, lambda w: case when length(w) > 5 then [w, left(w, 5)] else [w] end))"


WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(133) || chr(160)"


def CODE(t):
    up = f"upper(translate({t}, 'ı', 'I'))"
    pattern = r"'(?:^|[^\p{L}\p{N}])([A-Z]{2})[-_ ]*([0-9]{2,4})(?:[^0-9]|$)'"
    return (
        f"case when regexp_extract({up}, {pattern}, 1) <> '' then regexp_extract({up}, {pattern}, 1) || '-' || lpad(regexp_extract({up}, {pattern}, 2), 4, '0') "
        f"when regexp_matches(trim({t}, {WHITE}), '^[0-9]{{2,4}}$') then 'FR-' || lpad(trim({t}, {WHITE}), 4, '0') end"
    )


def BODY(p):
    return f"trim(case when instr({p}, chr(10)) > 0 then substr({p}, instr({p}, chr(10)) + 1) else {p} end, {WHITE})"


def PERCENT(t, keep):
    return rf"array_to_string(list_transform(string_split({t}, ''), lambda c: case when regexp_matches(c, '^[{keep}]$') then c else regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') end), '')"


DOCS = """docs as (select doc_id as doc, 'FR-' || lpad((doc_id % 400)::varchar, 4, '0') || '.' || lang || '.' || doc_id as id, 'FR-' || lpad((doc_id % 400)::varchar, 4, '0') as code, (doc_id // 400)::int as rev,
  case when doc_id % 3 = 0 then 'tr' else 'en' end as lang, left(split_part(text, chr(10), 1), 80) as title, ['docx', 'xlsx', 'pdf', 'doc', 'zip'][doc_id % 5 + 1] as ext, text from documents)"""

#: Whole benchmark texts as queries, every third led by a code.
ASKED = f"""asked as (select item_id as qid, case when item_id % 3 = 0 then 'fr ' || lpad((item_id % 400)::varchar, 4, '0') || ' ' || coalesce(text, '') else coalesce(text, '') end as query from benchmark),
  coded as (select *, {TOKENS('query')} as tokens, {CODE('query')} as code from asked)"""


def FIELD(name, source, unit, text):
    return f"""{name}_u as (select {unit} as unit, {TOKENS(text)} as tokens from {source}),
  {name}_tf as (select unit, len(tokens) as len, term, count(*) as tf from (select unit, tokens, unnest(tokens) as term from {name}_u) group by unit, len(tokens), term),
  {name}_df as (select term, count(*) as df from {name}_tf group by term),
  {name}_st as (select greatest(count(*), 1) as n, greatest(coalesce(avg(len(tokens)), 1.0), 1.0) as avg_len from {name}_u)"""


def RANKED(name):
    return f"""{name}_s as (select qid, unit, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) as score from {name}_tf join terms using (term) join {name}_df using (term), {name}_st group by qid, unit),
  {name}_r as (select qid, unit, score, row_number() over (partition by qid order by round(score, 9) desc, unit) - 1 as rank from {name}_s where score > 0 qualify rank < 200)"""


def TERMS(source):
    return f"terms as (select qid, term, count(*) as qtf from (select qid, unnest(tokens) as term from {source}) group by qid, term)"


COVER = """cover as (select m.qid, m.unit, m.c / r.c as coverage from (select qid, unit, count(*) as c from title_tf join terms using (term) group by qid, unit) m
  join (select qid, count(*) as c from terms join title_df using (term) group by qid) r using (qid))"""

SHOWN = "select qid, position, doc, case when why = 'code' then 1.0 else round(score, 6) end as score, why from page"


def shown(hits: DataFrame) -> DataFrame:
    """Page rows with the score that callers see: 1.0 for a code hit."""
    return hits.select("qid", "position", "doc", F.when(F.col("why") == "code", 1.0).otherwise(F.round("score", 6)).alias("score"), "why")


# --- text functions ---


@query(f"select doc_id, array_to_string({TOKENS('text')}, '|') as tokens from documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.tokenize(F.col("text")), "|").alias("tokens"))


@query(f"select distinct word, case when length(word) > 5 then left(word, 5) end as stem from (select unnest({WORDS('text')}) as word from documents)")
def stem(spark, sf_dir):
    return on.table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct().select("word", T.stem(F.col("word")).alias("stem"))


#: Codes in several spellings, or none, before the whole text.
SPELLED = "case doc_id % 5 when 0 then 'form FR-' || lpad((doc_id % 400)::varchar, 4, '0') || ' nerede ' when 1 then 'fr ' || (doc_id % 400) || ' ' when 2 then 'FR_' || (doc_id % 400) || ' ' when 3 then 'projefr-' || doc_id || ' ' else '' end || coalesce(text, '')"


@query(f"select doc_id, {CODE('q')} as code from (select doc_id, {SPELLED} as q from documents)")
def find_code(spark, sf_dir):
    d = F.col("doc_id")
    n = (d % 400).cast("string")
    before = (
        F.when(d % 5 == 0, F.concat(F.lit("form FR-"), F.lpad(n, 4, "0"), F.lit(" nerede ")))
        .when(d % 5 == 1, F.concat(F.lit("fr "), n, F.lit(" ")))
        .when(d % 5 == 2, F.concat(F.lit("FR_"), n, F.lit(" ")))
        .when(d % 5 == 3, F.concat(F.lit("projefr-"), d.cast("string"), F.lit(" ")))
        .otherwise(F.lit(""))
    )
    return on.table(spark, sf_dir, "documents").select("doc_id", T.find_code(F.concat(before, F.coalesce("text", F.lit("")))).alias("code"))


@query(f"with {ASKED} select qid, code, len(list_filter(tokens, lambda t: not (upper(t) = left(code, 2) or coalesce(try_cast(t as int) = substr(code, 4)::int, false)))) = 0 as bare from coded where code is not null")
def bare_code(spark, sf_dir):
    coded = fusion.with_codes(on.queries(spark, sf_dir)).where("code is not null")
    return coded.select("qid", "code", T.bare_code(F.col("tokens"), F.col("code")).alias("bare"))


@query(rf"""select page_id, {PERCENT("url || ' ü/ş%20'", r"A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%")} as encoded from pages""")
def encode_url(spark, sf_dir):
    return on.table(spark, sf_dir, "pages").select("page_id", T.encode_url(F.concat("url", F.lit(" ü/ş%20"))).alias("encoded"))


@query(rf"""select page_id, case when page_id % 3 = 0 then url else '{T.VIEWER}' || {PERCENT("url", r"A-Za-z0-9\-_.!~*''()")} end as view_url, starts_with(url, 'https://') as opens from pages""")
def view_url(spark, sf_dir):
    ext = F.when(F.col("page_id") % 3 == 0, "PDF").otherwise("docx")
    return on.table(spark, sf_dir, "pages").select("page_id", T.view_url(F.col("url"), ext).alias("view_url"), T.opens(F.col("url")).alias("opens"))


@query(f"select doc_id, len(list_filter(regexp_extract_all(text, '([\\p{{L}}\\p{{N}}]+)', 1), lambda w: {FOLD('w')} in ('the', 'that', 'de') or starts_with({FOLD('w')}, 'thent'))) as n_match from documents")
def match_terms(spark, sf_dir):
    terms = F.array(F.lit("the"), F.lit("that"), F.lit("de"), F.lit("thent"))
    runs = F.filter(T.marks(F.col("text"), terms), lambda r: r["match"])
    return on.table(spark, sf_dir, "documents").select("doc_id", F.size(runs).alias("n_match"))


HIT = f"{FOLD('w')} in ('the', 'that', 'de') or starts_with({FOLD('w')}, 'thent')"


@query(
    rf"""with r as (select doc_id, regexp_extract_all(text, '([\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+)', 1) as rs from documents), m as (select doc_id, rs, list_transform(rs, lambda w: {HIT}) as hs from r),
    n as (select doc_id, rs, hs, array_to_string(list_transform(hs, lambda h: case when h then 'm' else '-' end), '') as shape from m)
    select doc_id, len(regexp_extract_all(shape, 'm|-+')) as n_runs, md5(array_to_string(list_transform(range(1, len(rs) + 1), lambda i: case when hs[i] then '[' || rs[i] || ']' else rs[i] end), '')) as marked from n"""
)
def mark_runs(spark, sf_dir):
    """Runs with what does not match joined, and the text with matches in brackets."""
    runs = T.marks(F.col("text"), F.array(F.lit("the"), F.lit("that"), F.lit("de"), F.lit("thent")))
    rows = on.table(spark, sf_dir, "documents").select("doc_id", runs.alias("rs"))
    marked = F.array_join(F.transform("rs", lambda r: F.when(r["match"], F.concat(F.lit("["), r["text"], F.lit("]"))).otherwise(r["text"])), "")
    return rows.select("doc_id", F.size("rs").cast("long").alias("n_runs"), F.md5(marked).alias("marked"))


@query(
    rf"""with p as (select doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {WHITE})), lambda b: b <> '' and len(list_filter(regexp_extract_all(b, '([\p{{L}}\p{{N}}]+)', 1), lambda w: {HIT})) > 0) as found from documents)
    select doc_id, array_to_string(case when len(found) > 0 then found[1:2] else [left({BODY('text')}, 200)] end, '|') as evidence from p"""
)
def evidence(spark, sf_dir):
    """Lines of a text as titled passages, the text as the snippet."""
    passages = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("T\n"), x))
    terms = F.array(F.lit("the"), F.lit("that"), F.lit("de"), F.lit("thent"))
    return on.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.evidence(passages, F.col("text"), terms), "|").alias("evidence"))


@query(f"select item_id, case when trim(coalesce(text, ''), {WHITE}) = '' or item_id % 10 = 0 then '' else '“' || text || '” — ' || item_id || ' sonuç' end as title from benchmark")
def results_title(spark, sf_dir):
    query_ = F.when(F.col("item_id") % 10 == 0, F.lit(" \t")).otherwise(F.coalesce("text", F.lit("")))
    return on.table(spark, sf_dir, "benchmark").select("item_id", T.results_title(query_, F.col("item_id")).alias("title"))


NAMES = ("relevance", " Relevans", "SCORE", "kod", "code", "form", "AD", "isim ", "title", "name", "size", "")


@query(f"select doc_id, case doc_id % {len(NAMES)} when 0 then 'relevance' when 1 then 'relevance' when 2 then 'relevance' when 3 then 'code' when 4 then 'code' when 5 then 'code' when 6 then 'title' when 7 then 'title' when 8 then 'title' when 9 then 'title' end as sort from documents")
def sort_names(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    return on.table(spark, sf_dir, "documents").select("doc_id", T.sort_name(name).alias("sort"))


@query(f"select doc_id, {BODY('text')} as body from documents")
def passage_body(spark, sf_dir):
    return on.table(spark, sf_dir, "documents").select("doc_id", T.passage_body(F.col("text")).alias("body"))


@query(
    rf"""with p as (select doc_id, string_split(replace(regexp_replace(translate(text, chr(160) || chr(13), ' ' || chr(10)), '[ \t]+', ' ', 'g'), '', ''), chr(10)) as ls from documents)
    select doc_id, array_to_string(list_filter(list_transform(ls, lambda x: trim(x, {WHITE})), lambda x: x <> ''), chr(10)) as clean from p"""
)
def clean_text(spark, sf_dir):
    return on.table(spark, sf_dir, "documents").select("doc_id", ingest.clean_text(F.col("text")).alias("clean"))


# --- lexical statistics and ranking ---

BODY_FIELD = FIELD("body", "documents", "doc_id", "text")


@query(f"with {BODY_FIELD} select unit as doc_id, term, len, tf from body_tf")
def term_frequency(spark, sf_dir):
    return lexical.term_frequency(on.table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("unit").alias("doc_id"), "term", "len", "tf")


@query(f"with {BODY_FIELD} select term, df from body_df")
def doc_frequency(spark, sf_dir):
    return lexical.field(on.table(spark, sf_dir, "documents"), "doc_id", "text").df


@query(f"with {BODY_FIELD} select n, round(avg_len, 6) as avg_len from body_st")
def field_stats(spark, sf_dir):
    return lexical.field(on.table(spark, sf_dir, "documents"), "doc_id", "text").stats.select("n", F.round("avg_len", 6).alias("avg_len"))


@query(f"with {ASKED}, {TERMS('coded')}, {BODY_FIELD}, {RANKED('body')} select qid, unit as doc_id, round(score, 6) as score, rank from body_r")
def bm25_topk(spark, sf_dir):
    """Every term of the benchmark texts is a query term."""
    f = lexical.field(on.table(spark, sf_dir, "documents"), "doc_id", "text", keep=True)
    out = lexical.ranked(f, lexical.query_terms(on.queries(spark, sf_dir)))
    return out.select("qid", F.col("unit").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query(f"with {DOCS}, {ASKED}, {TERMS('coded')}, {FIELD('title', 'docs', 'doc', 'title')}, {COVER} select qid, unit as doc, round(coverage, 6) as coverage from cover")
def title_coverage(spark, sf_dir):
    f = lexical.field(on.docs(spark, sf_dir), "doc", "title", keep=True)
    return lexical.coverage(f, lexical.query_terms(on.queries(spark, sf_dir))).select("qid", F.col("unit").alias("doc"), F.round("coverage", 6).alias("coverage"))


DENSE = """with d as (select q.vec_id as qid, v.vec_id as unit, list_dot_product(v.embedding::double[], q.embedding::double[]) as score from embeddings v, (select * from embeddings where vec_id % 20 = 0) q)
  select qid, unit, round(score, 6) as score, row_number() over (partition by qid order by round(score, 9) desc, unit) - 1 as rank from d qualify rank < 200"""


@query(DENSE)
def dense_topk(spark, sf_dir):
    """Every twentieth vector is a query, so the queries grow with the table."""
    vectors = on.table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    units = vectors.select(F.col("vec_id").alias("unit"), F.col("embedding").alias("vec"))
    return dense.dense_ranked(units, asked).select("qid", "unit", F.round("score", 6).alias("score"), "rank")


@query(
    """with e as (select vec_id, embedding, label from embeddings), m as (select label, unnest(range(1, 65)) as k, embedding from e)
    select label, round(sum(embedding[k]::double) / greatest(count(*), 1e-9), 6) as x, k::int as k from m group by label, k"""
)
def mask_mean_pool(spark, sf_dir):
    """Vectors of a label pooled as the tokens of one text."""
    grouped = on.table(spark, sf_dir, "embeddings").groupBy("label", (F.col("vec_id") % 8).alias("part")).agg(F.collect_list("embedding").alias("h"))
    pooled = grouped.select("label", F.size("h").alias("n"), dense.mean_pool(F.col("h"), F.transform("h", lambda x: F.lit(1.0))).alias("v"))
    return pooled.select("label", "n", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 6).alias("x")).select("label", "x", (F.col("k") + 1).cast("int").alias("k"))


@query("select vec_id, len(embedding)::int as dim, round(sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x / greatest(list_dot_product(embedding::double[], embedding::double[]), 1e-24)))), 6) as length from embeddings")
def unit_vectors(spark, sf_dir):
    """Vectors of the length that is asked, made unit vectors."""
    rows = dense.checked(on.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec")), 64)
    unit = rows.withColumn("u", dense.normalized(F.col("vec")))
    return unit.select("vec_id", F.size("vec").alias("dim"), F.round(F.sqrt(dense.dot(F.col("u"), F.col("u"))), 6).alias("length"))


# --- hybrid search ---


NEEDLES = "needles as (select case when doc_id % 2 = 0 then 'FR-' || lpad((doc_id % 450)::varchar, 4, '0') else 'FR-' || lpad((doc_id % 400)::varchar, 4, '0') || '.' || lang || '.' || doc_id end as needle from documents group by all)"


@query(
    f"""with {DOCS}, {NEEDLES}, f as (select needle, doc, 0 as a, 0 as b from needles join docs on id = needle union all select needle, doc, 1, case when lang = 'tr' then 0 else 1 end from needles join docs on docs.code = {CODE('needle')})
    select needle, doc from f qualify row_number() over (partition by needle order by a, b, doc) = 1"""
)
def resolve_doc(spark, sf_dir):
    d = F.col("doc_id")
    needle = F.when(d % 2 == 0, F.concat(F.lit("FR-"), F.lpad((d % 450).cast("string"), 4, "0"))).otherwise(F.concat(F.lit("FR-"), F.lpad((d % 400).cast("string"), 4, "0"), F.lit("."), F.col("lang"), F.lit("."), d.cast("string")))
    return fusion.resolve(on.docs(spark, sf_dir), on.table(spark, sf_dir, "documents").select(needle.alias("needle")).distinct())


# --- passages and index ---

CUT = f"""with recursive d as (select doc_id, trim(text, {WHITE}) as body from documents),
  cut as (select doc_id, body, 0 as s, case when length(body) <= 900 then length(body) when position(chr(10) in reverse(substr(body, 451, 450))) > 0 then 900 - position(chr(10) in reverse(substr(body, 451, 450))) else 900 end as e, 1 as ord from d where body <> ''
    union all select doc_id, body, s2, case when s2 + 900 >= length(body) then length(body) when position(chr(10) in reverse(substr(body, s2 + 451, 450))) > 0 then s2 + 900 - position(chr(10) in reverse(substr(body, s2 + 451, 450))) else s2 + 900 end, ord + 1
    from (select *, greatest(e - 150, s + 1) as s2 from cut where e < length(body) and ord + 1 < 40))"""
CUTS = f"""{CUT},
  chunks as (select doc_id as doc, 0 as ord, 'T' as text from documents union all select doc_id, ord, 'T' || chr(10) || trim(substr(body, s + 1, e - s), {WHITE}) from cut)"""


def titled(spark, sf_dir):
    return on.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lit("T").alias("title"), "text")


@query(f"{CUTS} select doc, ord, text from chunks")
def chunk_documents(spark, sf_dir):
    return chunking.chunk(titled(spark, sf_dir))


@query(f"{CUTS} select doc, count(*) as n, any_value(length(d.text)) as chars from chunks c join documents d on d.doc_id = c.doc group by doc")
def chunk_counts(spark, sf_dir):
    counts = chunking.chunk(titled(spark, sf_dir)).groupBy("doc").agg(F.count("*").alias("n"))
    return counts.join(titled(spark, sf_dir).select("doc", F.char_length("text").alias("chars")), "doc")


@query("select vec_id as chunk, vec_id // 5 as doc from embeddings where not exists (select 1 from documents where doc_id = vec_id // 5 and doc_id % 10 <> 3)")
def integrity_orphans(spark, sf_dir):
    chunks = on.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), F.floor(F.col("vec_id") / 5).alias("doc"))
    return index_store.orphans(on.docs(spark, sf_dir).where("doc % 10 <> 3"), chunks)


@query("select (select count(*) from documents) as documents, (select count(*) from embeddings) as chunks, '2024-01-01' as built, 'test' as source")
def corpus_stats(spark, sf_dir):
    n = on.table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"))
    return n.join(F.broadcast(on.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("chunks")))).select("documents", "chunks", F.lit("2024-01-01").alias("built"), F.lit("test").alias("source"))


@query(f"with {DOCS} select id, code, rev, lang, title, ext, md5(coalesce(text, '')) as text from docs")
def forms_round_trip(spark, sf_dir):
    """Forms written as JSON lines and read again."""
    forms = on.docs(spark, sf_dir).select("id", "code", "rev", "lang", "title", F.col("id").alias("name"), "ext", F.col("id").alias("url"), "text")
    folder = tables.named_folder(spark, "forms")
    index_store.write_forms(forms, folder)
    return index_store.read_forms(spark, folder, lines=True).select("id", "code", "rev", "lang", "title", "ext", F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@query("select vec_id // 5 as doc, count(*) as n, round(sum(embedding[1]::double), 6) as first from embeddings where vec_id // 5 in (select doc_id from documents) group by 1")
def index_round_trip(spark, sf_dir):
    """An index written, checked, moved into place and read again."""
    docs = on.docs(spark, sf_dir)
    chunks = on.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk"), F.floor(F.col("vec_id") / 5).alias("doc"), F.lit(0).alias("ord"), F.lit("").alias("text"), F.col("embedding").alias("vec"))
    folder = index_store.write_index(docs, chunks.join(docs.select("doc"), "doc", "left_semi"), tables.named_folder(spark, "index"), "m", 64, "2024-01-01", "test")
    _, back, _ = index_store.read_index(spark, folder, "m")
    return back.groupBy("doc").agg(F.count("*").alias("n"), F.round(F.sum(F.get("vec", F.lit(0)).cast("double")), 6).alias("first"))


# --- search over passages, with whole benchmark texts as queries ---

#: Everything of a search up to the fused scores of all candidates: a document counts with its best passage in a list; each vector belongs to a passage of document vec_id // 5.
SEARCH = f"""{CUT}, {DOCS}, {ASKED},
  chunks as materialized (select doc * 64 as chunk, doc, 0 as ord, coalesce(title, '') as text from docs union all select doc * 64 + ord, doc, ord, title || chr(10) || trim(substr(body, s + 1, e - s), {WHITE}) from cut join docs on doc = doc_id),
  hits as (select qid, doc from coded join docs using (code)),
  bare_q as (select qid from coded where qid in (select qid from hits) and len(list_filter(tokens, lambda t: not (upper(t) = left(code, 2) or coalesce(try_cast(t as int) = substr(code, 4)::int, false)))) = 0),
  open_q as (select * from coded where qid not in (select qid from bare_q)),
  {TERMS('open_q')}, {FIELD('title', 'docs', 'doc', 'title')}, {FIELD('body', 'chunks', 'chunk', 'text')}, {RANKED('title')}, {RANKED('body')}, {COVER},
  vecs as (select vec_id as unit, doc, doc * 64 + least(vec_id % 5, last) as chunk, embedding from embeddings join (select doc, max(ord) as last from chunks group by doc) on doc = vec_id // 5),
  dense_s as (select q.qid, v.unit, v.doc, v.chunk, list_dot_product(v.embedding::double[], e.embedding::double[]) as score from open_q q join embeddings e on e.vec_id = q.qid, vecs v),
  dense_r as (select *, row_number() over (partition by qid order by round(score, 9) desc, unit) - 1 as rank from dense_s qualify rank < 200),
  lists as materialized (select qid, doc, unit as chunk, rank, 1 as list from body_r join chunks on chunk = unit union all select qid, doc, chunk, min(rank), 2 from dense_r group by qid, doc, chunk),
  fused as (select qid, doc, sum(s) as score from (select c.qid, c.unit as doc, 0.2 * coverage * coverage as s from cover c join title_r r on r.qid = c.qid and r.unit = c.unit
    union all select qid, doc, 1 / (61.0::double + min(rank)) from lists group by qid, doc, list) group by qid, doc),
  every as (select qid, doc, 'infinity'::double as score, 'code' as why from hits union all select qid, doc, score, 'match' from fused f where not exists (select 1 from hits h where h.qid = f.qid and h.doc = f.doc))"""

#: The best three passages of each match of the page, and all pages with them.
PASSED = """parts as (select qid, doc, chunk, 1 / (61.0::double + rank) as part, list * 1000 + rank as seq from lists union all select qid, unit, unit * 64, 0, 0 from title_r),
  summed as (select qid, doc, chunk, sum(part) as part, min(seq) as seq from parts group by qid, doc, chunk),
  best as (select *, row_number() over (partition by qid, doc order by round(part, 9) desc, seq) as n from summed qualify n <= 3),
  passed as (select qid, doc, string_agg(text, chr(10) order by n) as passages, count(*) as n, max(text) filter (where n = 1) as snippet from best b join chunks using (doc, chunk) where (qid, doc) in (select (qid, doc) from page where why = 'match') group by qid, doc)"""


def PAGE(order):
    return f"{SEARCH}, page as (select qid, doc, score, why, row_number() over (partition by qid order by (why <> 'code')::int, {order} round(score, 9) desc, doc) as position from every join docs using (doc) qualify position <= 25)"


def found(spark, sf_dir, sort="relevance"):
    return fusion.search(on.passage_corpus(spark, sf_dir), on.queries(spark, sf_dir), sort=sort)


@query(f"{SEARCH} select qid, doc, round(score, 6) as score from fused")
def fusion_rrf(spark, sf_dir):
    scores = fusion.candidates(on.passage_corpus(spark, sf_dir), on.queries(spark, sf_dir)).scores
    return scores.select("qid", "doc", F.round("score", 6).alias("score"))


@query(f"{PAGE('')} {SHOWN}")
def hybrid_search(spark, sf_dir):
    return shown(found(spark, sf_dir))


@query(f"{PAGE('')} select qid, doc, position from page where why = 'code'")
def code_search_pinned(spark, sf_dir):
    return found(spark, sf_dir).where("why = 'code'").select("qid", "doc", "position")


@query(f"{PAGE('code,')} {SHOWN}")
def sort_by_code(spark, sf_dir):
    return shown(found(spark, sf_dir, "code"))


@query(f"{PAGE(TOKENS('title') + ',')} {SHOWN}")
def sort_by_title(spark, sf_dir):
    return shown(found(spark, sf_dir, "title"))


@query(f"{PAGE('')}, {PASSED} select page.qid, page.doc, coalesce(md5(passages), '') as passages, coalesce(n, 0) as n from page left join passed on passed.qid = page.qid and passed.doc = page.doc")
def passages_top3(spark, sf_dir):
    out = found(spark, sf_dir)
    text = F.when(F.size("passages") == 0, "").otherwise(F.md5(F.array_join("passages", "\n")))
    return out.select("qid", "doc", text.alias("passages"), F.size("passages").cast("long").alias("n"))


@query(f"{PAGE('')}, {PASSED} select page.qid, page.doc, md5(coalesce(snippet, title, '')) as snippet from page join docs using (doc) left join passed on passed.qid = page.qid and passed.doc = page.doc")
def first_chunk_snippet(spark, sf_dir):
    return found(spark, sf_dir).select("qid", "doc", F.md5("snippet").alias("snippet"))


@query(f"with {DOCS} select doc, id, code, rev, lang, title, ext, coalesce(text, '') = '' as title_only, doc % 7 = 0 as saved from docs")
def doc_rows(spark, sf_dir):
    docs = on.docs(spark, sf_dir)
    out = app.rows(docs, None, docs.where("doc % 7 = 0").select("id"))
    return out.select("doc", "id", "code", "rev", "lang", "title", "ext", "title_only", "saved")


@query(
    rf"""with {DOCS} select doc, trim(coalesce(case when doc % 2 = 0 then code end, left(regexp_replace(regexp_replace(coalesce(title, ''), '\.[^.]*$', ''), '[^A-Za-z0-9]+', '-', 'g'), 40)) || '.' || coalesce(lang, ''), '-.') as form_id from docs"""
)
def document_id(spark, sf_dir):
    code = F.when(F.col("doc") % 2 == 0, F.col("code"))
    return on.docs(spark, sf_dir).select("doc", T.document_id(code, F.coalesce("title", F.lit("")), F.col("lang")).alias("form_id"))


# --- ingest ---

LINK = r"(?is)<a\b[^>]*href\s*=\s*\"([^\"]*th[^\"]*)\"[^>]*>(.*?)</a>"


@query(
    rf"""with a as (select page_id, regexp_extract_all(html, '{LINK}', 1) as hs, regexp_extract_all(html, '{LINK}', 2) as ls from pages),
    r as (select page_id, unnest(range(0, len(hs))) as pos, hs, ls from a)
    select page_id, pos::int as pos, hs[pos + 1] as href, trim(regexp_replace(replace(replace(regexp_replace(ls[pos + 1], '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as label from r""".replace('\\"', '"')
)
def parse_listing(spark, sf_dir):
    return ingest.parse_listing(on.table(spark, sf_dir, "pages"), word="th")


ORIGIN = "https://forms.example.org"
NUMBER, EXT, WORD = "lpad((doc_id % 400)::varchar, 4, '0')", "['docx', 'xlsx', 'pdf', 'doc', 'zip'][doc_id % 5 + 1]", "regexp_extract(text, '([A-Za-z]{3,})', 1)"
LISTED = f"""with l0 as (select doc_id as pos, text, {NUMBER} as number, {EXT} as ext, {WORD} as word, case when doc_id % 7 = 0 then '/haber/' when doc_id % 3 = 0 then '/kalite/Formlar-İngilizce/' else '/kalite/Formlar/' end as folder from documents),
  l1 as (select *, case when pos % 2 = 0 then 'FR-' || number || ' ' || word || ' R' || (pos % 4) else 'FR-' || number || '_' || word || '_R2' end as stem from l0),
  l2 as (select pos, text, '{ORIGIN}' || '/fileman' || folder || stem || '.' || ext as url, stem || '.' || ext as name, ext, case when starts_with(folder, '/kalite/') then case when contains(folder, 'İngilizce') then 'en' else 'tr' end end as lang,
    'FR-' || number as code, case when pos % 2 = 0 then pos % 4 else 0 end::int as rev, case when pos % 2 = 0 then coalesce(nullif(word, ''), stem) else coalesce(nullif(word, ''), stem) end as title from l1),
  l3 as (select *, case when lang is null then 'outside the document folder' when ext not in ('docx', 'xlsx', 'xlsm', 'pdf', 'doc', 'xls') then 'unreadable format .' || ext end as cull_reason from l2),
  l4 as (select *, row_number() over own as n, first_value(rev) over own as best, first_value(name) over own as winner from l3 where cull_reason is null window own as (partition by code, lang order by rev desc, (ext in ('docx', 'xlsx')) desc, pos)),
  l5 as (select *, case when n > 1 then case when rev < best then 'superseded by R' || best || ' (' || winner || ')' else 'duplicate of ' || winner end end as superseded from l4)"""


def listed(spark, sf_dir):
    return ingest.cull_reason(ingest.listing_columns(on.listing(spark, sf_dir), ORIGIN))


@query(f"{LISTED} select pos, url, name, ext, lang, code, rev, title from l2")
def listing_columns(spark, sf_dir):
    return ingest.listing_columns(on.listing(spark, sf_dir), ORIGIN).select("pos", "url", "name", "ext", "lang", "code", "rev", "title")


@query(f"{LISTED} select pos, cull_reason from l3")
def cull_reasons(spark, sf_dir):
    return listed(spark, sf_dir).select("pos", "cull_reason")


@query(f"{LISTED} select pos, superseded from l5")
def best_revision(spark, sf_dir):
    return ingest.best_revision(listed(spark, sf_dir).where("cull_reason is null")).select("pos", "superseded")


@query("select min(page_id) as pos, url from (select page_id, regexp_replace(url, '[?#].*$', '') as u, split_part(regexp_replace(url, '^https?://', ''), '/', 1) as url from pages) group by url")
def dedupe_url(spark, sf_dir):
    host = F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1))
    return ingest.first_by_url(on.table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), host.alias("url")))


@query(f"with {DOCS} select id from docs where doc % 3 = 1")
def stale_forms(spark, sf_dir):
    docs = on.docs(spark, sf_dir)
    return ingest.stale(docs, docs.where("doc % 3 != 1"))


@query(f"{LISTED} select count(*) as listed, count(*) filter (where l3.cull_reason is null) as kept, count(*) filter (where l3.cull_reason is not null) as culled, count(*) filter (where l5.pos is not null and superseded is null) as documents, count(*) filter (where l5.pos is not null and superseded is null and l3.text = '') as no_text from l3 left join l5 using (pos)")
def ingest_report(spark, sf_dir):
    rows = listed(spark, sf_dir)
    kept = ingest.best_revision(rows.where("cull_reason is null"))
    return ingest.report(kept.unionByName(rows.where("cull_reason is not null").withColumn("superseded", F.lit(None).cast("string"))))


@query(
    f"""{LISTED}, r as (select l3.url, l3.name, l3.text, l3.cull_reason, l5.superseded from l3 left join l5 using (pos))
    select 'culled' as list, url, name, cull_reason as reason from r where cull_reason is not null union all select 'superseded', url, name, superseded from r where superseded is not null
    union all select 'no_text', url, name, null from r where cull_reason is null and superseded is null and coalesce(text, '') = ''"""
)
def ingest_report_rows(spark, sf_dir):
    rows = listed(spark, sf_dir)
    kept = ingest.best_revision(rows.where("cull_reason is null"))
    return ingest.report_rows(kept.unionByName(rows.where("cull_reason is not null").withColumn("superseded", F.lit(None).cast("string"))))


# --- session ---

COMMANDS = """commands as (select user_id % 20 as session, event_id as at_, case when user_id % 5 <> 0 then user_id end as who, case event_type when 'view' then 'open' when 'signup' then 'save' when 'click' then 'search' when 'error' then 'unsave' else 'sort' end as action, props->>'k' as arg from events)"""
#: Each command with what its session said last of the same id, and searched last.
STATE = f"""with {COMMANDS}, said as (select c.session, c.at_, max_by(p.action, p.at_) as last from commands c join commands p on p.session = c.session and p.arg = c.arg and p.at_ < c.at_ where c.action in ('save', 'unsave') and p.action in ('save', 'unsave') group by all),
  asked as (select c.session, c.at_, max_by(trim(p.arg), p.at_) as query from commands c join commands p on p.session = c.session and p.at_ < c.at_ and p.action = 'search' where c.action = 'sort' group by all),
  done as (select c.*, query from commands c left join said s on s.session = c.session and s.at_ = c.at_ left join asked a on a.session = c.session and a.at_ = c.at_
    where case action when 'save' then last is distinct from 'save' when 'unsave' then last is not distinct from 'save' when 'search' then trim(coalesce(arg, '')) <> '' else true end)"""
ACTIVITY = f"""{STATE}, e as (select session, at_, 0 as part, who, 'search' as action, query as detail from done where action = 'sort' and coalesce(query, '') <> '' union all select session, at_, 1, who, action, case when action = 'search' then trim(arg) else arg end from done),
  k as (select *, row_number() over (partition by session order by at_, part) as seq, count(*) over (partition by session) as n from e),
  log as (select session, seq, who, action, detail from k where seq > n - 40)"""


@query(f"{ACTIVITY} select session, seq, who, action, detail from log")
def activity_tail40(spark, sf_dir):
    return session.activity(on.commands(spark, sf_dir))


@query(f"{ACTIVITY} select session, seq, action, case when who is null then 'you' when who < 50 then 'agent ' || who else who::varchar end as actor from log")
def activity_named(spark, sf_dir):
    roster = on.table(spark, sf_dir, "events").where("user_id < 50").select(F.col("user_id").alias("who"), F.concat(F.lit("agent "), "user_id").alias("name")).distinct()
    return session.named(session.activity(on.commands(spark, sf_dir)), roster).select("session", "seq", "action", "actor")


@query(f"{STATE} select session, at_ as at, case when action = 'open' then 'doc.opened' else 'saved.changed' end as signal, arg as detail from done where who is null and action in ('open', 'save', 'unsave')")
def signals(spark, sf_dir):
    return session.signals(on.commands(spark, sf_dir))


SAVED = f"""{STATE}, s as (select session, arg as id, max_by(action, at_) as action, max(at_) as at_ from done where action in ('save', 'unsave') group by session, arg),
  kept as (select session, id, row_number() over (partition by session order by at_, id) as pos from s where action = 'save')"""


@query(f"{SAVED} select session, id, pos from kept")
def saved_set(spark, sf_dir):
    return session.saved_set(on.commands(spark, sf_dir))


@query(f"{SAVED}, {DOCS} select session, pos, id, doc, title from (select session, pos, 'FR-' || lpad(id, 4, '0') || '.en.' || id as id from kept) join docs using (id)")
def saved_docs(spark, sf_dir):
    """Saved numbers as ids; those of documents in another language are not in the corpus."""
    number = F.concat(F.lit("FR-"), F.lpad("id", 4, "0"), F.lit(".en."), F.col("id"))
    saved = session.saved_set(on.commands(spark, sf_dir)).select("session", "pos", number.alias("id"))
    return session.saved_docs(saved, on.docs(spark, sf_dir).select("id", "doc", "title"))


@query(
    """with k as (select user_id as session, ts as at_, props->>'k' as query from events),
    g as (select *, case when at_ >= lag(at_) over (partition by session order by at_) + interval 30 minute then 1 when lag(at_) over (partition by session order by at_) is null then 1 else 0 end as fresh from k),
    w as (select *, sum(fresh) over (partition by session order by at_) as n from g)
    select session, max(at_) + interval 30 minute as fired, max_by(query, at_) as query from w group by session, n"""
)
def debounced_queries(spark, sf_dir):
    keys = on.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").alias("at"), F.get_json_object("props", "$.k").alias("query"))
    return session.debounced(keys, "30 minutes")


@query(
    """with k as (select event_id // 50 as session, epoch_ms(event_id * 200 + event_id * 7919 % 97) as at_, case when event_id % 11 = 0 then 'enter' when event_id % 13 = 0 then 'escape' end as key, props->>'k' as query from events),
    n as (select *, (select min(q.at_) from k q where q.session = k.session and q.at_ > k.at_) as next from k)
    select session, case when key = 'enter' then at_ else at_ + interval 220 millisecond end as fired, case when key = 'escape' then '' else query end as query from n where key = 'enter' or next is null or next >= at_ + interval 220 millisecond"""
)
def debounced_keys(spark, sf_dir):
    """Key strokes about 220 ms apart, fifty a session, with Enter and Escape."""
    i = F.col("event_id")
    key = F.when(i % 11 == 0, "enter").when(i % 13 == 0, "escape")
    keys = on.table(spark, sf_dir, "events").select(F.floor(i / 50).alias("session"), F.timestamp_millis(i * 200 + i * 7919 % 97).alias("at"), F.get_json_object("props", "$.k").alias("query"), key.alias("key"))
    return session.debounced(keys)


@query(
    """with s as (select user_id as job, event_id as seq, floor(100 * (props->>'k')::double / 10 / 10.0)::bigint as percent from events), l as (select *, lag(percent) over (partition by job order by seq) as b from s)
    select job, seq, percent from l where b is null or b <> percent"""
)
def progress_changes(spark, sf_dir):
    steps = on.table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("double").alias("done"), F.lit(100.0).alias("size"))
    return session.progress_changes(steps).select("job", "seq", "percent")


@query(
    """with f as (select l_orderkey as job, l_linenumber * 1000000 + l_partkey * 100 + l_quantity::bigint as seq, sum(l_quantity::bigint)::bigint as size from lineitem group by all)
    select job, seq, size, floor(100 * coalesce(sum(size) over (partition by job order by seq rows between unbounded preceding and 1 preceding), 0) / greatest(sum(size) over (partition by job), 1))::bigint as percent from f"""
)
def weighted_progress(spark, sf_dir):
    files = on.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")).alias("seq"), F.col("l_quantity").cast("long").alias("size")).groupBy("job", "seq").agg(F.sum("size").alias("size"))
    return session.weighted_progress(files)
