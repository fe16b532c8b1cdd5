"""Plans that must stay as they are: scans, shuffles and limits of the retrieval operators."""

from pyspark.sql import functions as F

from brevia.operators import dense, fusion, lexical


def nodes(df):
    logical, physical = (str(p.toString()) for p in (df._jdf.queryExecution().optimizedPlan(), df._jdf.queryExecution().executedPlan()))
    return {"split": logical.count("split("), "scan": physical.count("FileScan"), "exchange": physical.count("Exchange "), "limit": physical.count("WindowGroupLimit")}


def test_a_field_is_one_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    f = lexical.field(docs, "doc_id", "text")
    assert nodes(f.tf) == {"split": 1, "scan": 1, "exchange": 0, "limit": 0}
    for df in (f.df, f.stats):
        assert nodes(df) == {"split": 1, "scan": 1, "exchange": 1, "limit": 0}
    assert "text" in f.tf._jdf.queryExecution().executedPlan().toString() and "lang" not in f.tf._jdf.queryExecution().executedPlan().toString()


def test_tasks_cut_their_own_lists(spark, sf):
    f = lexical.field(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text", keep=True)
    asked = spark.createDataFrame([(1, "the of and"), (2, "that")], "qid int, query string")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("unit"), F.col("embedding").alias("vec"))
    for df in (lexical.ranked(f, lexical.query_terms(asked)), dense.dense_ranked(vectors, vectors.where("unit % 20 = 0").withColumnRenamed("unit", "qid"))):
        assert nodes(df) == {"split": 0, "scan": 1, "exchange": 1, "limit": 2}


def test_copies_of_a_code_do_not_meet_the_needles(spark):
    docs = spark.range(2000).selectExpr("id as doc", "concat('FR-0001.', id) as id", "'FR-0001' as code", "if(id % 3 = 1, 'tr', 'en') as lang")
    found = fusion.resolve(docs, docs.selectExpr("concat('FR-0001 x', id) as needle").unionByName(docs.selectExpr("id as needle")))
    rows = found.collect()
    assert len(rows) == 4000 and all(r.doc == (1 if " " in r.needle else int(r.needle[8:])) for r in rows)
    assert joined_rows(found._jdf.queryExecution().executedPlan()) <= 2 * 4000


def test_coverage_of_wanted_pairs_meets_no_others(spark):
    f = lexical.field(spark.range(1000).selectExpr("id", "concat('the of w', id) as title"), "id", "title", keep=True)
    terms = lexical.query_terms(spark.range(50).selectExpr("id as qid", "concat('the of w', id, ' gone') as query"))
    found = lexical.coverage(f, terms, spark.range(50).selectExpr("id as qid", "id + id % 2 as unit"))
    assert {(r.qid, r.unit): round(r.coverage, 6) for r in found.collect()} == {(k, k + k % 2): 0.666667 if k % 2 else 1.0 for k in range(50)}
    assert joined_rows(found._jdf.queryExecution().executedPlan()) <= 3 * 50


def joined_rows(plan):
    """Rows that the joins of a plan that has run gave, together."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if "QueryStage" in name:
        return joined_rows(plan.plan())
    children = plan.children()
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return own + sum(joined_rows(children.apply(k)) for k in range(children.size()))
