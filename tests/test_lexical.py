"""BM25 in arrays against the plain joins, on rows that share an id or a length, empty ones and ones without an id."""

import random

import pytest
from pyspark.sql import functions as F

from lodespark.functions import text as T
from lodespark.operators import lexical as X, retrieval as R

WEIGHTS = {"body": 1.5, "source": 0.5}


def tables(spark):
    fields = {"body": F.col("text"), "source": F.col("source")}
    rnd = random.Random(3)
    text = lambda: rnd.choice([" ", "-", " / ", "\n"]).join(rnd.choices(["Alpha", "beta", "BETA", "gamma+", "delta", "x1", "été", "Kelvin"], k=rnd.randint(0, 9)))
    rows = [(k // 2 if k < 20 else k, text(), rnd.choice(["web", "alpha beta", None])) for k in range(150)] + [(7, "alpha beta", "web"), (7, "beta alpha", "web"), (None, "alpha x1", None), (200, None, None), (201, "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    q = spark.createDataFrame([(k, text()) for k in range(12)] + [(50, "never met")], "query_id int, text string")
    return docs, fields, q.select("query_id", F.explode(T.with_bigrams(T.tokens(F.col("text")))).alias("term"))


@pytest.mark.parametrize("cells", [1 << 22, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_scores_against_joins(spark, monkeypatch, cells, descending):
    monkeypatch.setattr(X, "CELLS", cells)
    docs, fields, queries = tables(spark)
    own = X.Lexical(docs, fields, queries)
    index = R.postings(docs, fields)
    idf = R.idf_table(index, docs.agg(F.count(F.lit(1)).alias("n")))
    lengths = index.select("doc_id", "field", "len").distinct().groupBy("field").agg(F.avg("len").alias("avg_len"))
    want = R.bm25(index, idf, lengths, queries, WEIGHTS, 4, descending)
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert key(own.bm25(WEIGHTS, 4, descending)) == key(want)
    asked = {r["term"] for r in queries.select("term").distinct().collect()}
    assert {(r["term"], r["df"]) for r in own.idf().collect()} == {(r["term"], r["df"]) for r in idf.collect() if r["term"] in asked}
    postings = lambda df: sorted((repr(r["doc_id"]), r["field"], r["term"], r["tf"], r["len"]) for r in df.collect() if r["term"] in asked)
    assert postings(own.index(own.counts)) == postings(index)


def test_no_shuffle_of_words_or_pairs(spark):
    docs, fields, queries = tables(spark)
    own = X.Lexical(docs, fields, queries)
    plan = own.bm25(WEIGHTS, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Window" in plan
    assert own.counts.count() == docs.select("doc_id").distinct().count()


def test_no_queries_or_documents(spark):
    docs, fields, queries = tables(spark)
    assert X.Lexical(docs, fields, queries.where("false")).bm25(WEIGHTS, 3).count() == 0
    assert X.Lexical(docs.where("false"), fields, queries).bm25(WEIGHTS, 3).count() == 0


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_tfidf_against_joins(spark, monkeypatch, cells):
    """Repeated query terms count as often; rows that share an id are one document; no row is made for a word."""
    monkeypatch.setattr(X, "CELLS", cells)
    docs, fields, _ = tables(spark)
    body = {"body": fields["body"]}
    rows = [(k, t) for k, ts in enumerate(["alpha alpha beta", "gamma+ x1 x1 x1", "delta", "never met"]) for t in ts.split()]
    queries = spark.createDataFrame(rows, "query_id int, term string")
    index = R.postings(docs, body, False).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"))
    want = R.tfidf(index, R.idf_table(index, docs.agg(F.count(F.lit(1)).alias("n")), max_share=1.0), queries, 4)
    got = X.Lexical(docs, body, queries, bigrams=False).tfidf(4)
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert key(got) == key(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_tfidf_query_makes_no_row_for_a_word(spark, sf):
    from lodespark.plans import registry

    plan = registry()["tfidf_log_search"][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" in plan
