"""Labels from votes do not depend on the order of their rows."""

import itertools

from pyspark.sql import functions as F

from lodespark.functions import sums as X
from lodespark.operators import evaluation as E, linking as L
from lodespark.plans import registry


def test_ties_of_decimals_are_ties_in_any_order(spark):
    votes = [(1, 0.1), (2, 0.2), (2, 0.3), (1, 0.7), (1, 0.05), (2, 0.35)]  # half of the weight for 1, half for 2
    rows = [(k, v, c, False) for k, order in enumerate(itertools.permutations(votes)) for v, c in order]
    df = spark.createDataFrame(rows, "item int, vote int, confidence double, hard_negative boolean").coalesce(1)
    assert {(r.label, r.confidence) for r in E.vote_ensemble(df).select("label", "confidence").distinct().collect()} == {(2, 0.283333)}
    silver = L.silver_labels(df.toDF("pair", "vote", "confidence", "hard"))
    assert silver.select("relevance", "confidence", "priority").distinct().count() == 1


def test_half_places_round_up(spark):
    rows = [(k, 0, c, False) for k in range(5) for c in [0.6] * 10 + [0.7] * 19 + [0.85] * 3]  # 21.85 / 32 = 0.6828125
    df = spark.createDataFrame(rows, "item int, vote int, confidence double, hard_negative boolean")
    assert {r.confidence for r in E.vote_ensemble(df).collect()} == {0.682813}


def test_placed_votes_are_added_in_their_order(spark):
    rows = [(k, 0, c, False, i) for k in range(5) for i, c in enumerate([0.1] * 10 + [0.7] * 3)]
    want = 0.0
    for _, _, c, _, _ in rows[:13]:
        want += c
    assert want != 3.1  # the exact sum
    df = spark.createDataFrame(rows[::-1], "pair int, vote int, confidence double, hard boolean, place int").repartition(4)
    running = X.running(df, "pair", {"upto": F.col("confidence")})
    assert {r.upto for r in running.where("place = 12").collect()} == {want}


def test_votes_of_a_table_equal_its_sql_at_half_places(spark, duck, tmp_path):
    # 21.85 / 32 = 0.6828125, but a little less when doubles are added up in this order
    rows = [(7, n % 4 + 4, (1 - c) / 5, "N", 1.0, 0.0) for n, c in enumerate([0.6] * 10 + [0.7] * 19 + [0.85] * 3)]
    names = "l_partkey bigint, l_linenumber int, l_discount double, l_returnflag string, l_quantity double, l_tax double"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    duck = duck.cursor()
    duck.execute(f"CREATE TEMP VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    query, sql = registry()["vote_ensemble"]
    assert [tuple(r) for r in query(spark, str(tmp_path)).collect()] == duck.execute(sql).fetchall()


def test_placed_silver_votes_are_added_in_their_order(spark):
    rows = [(1, 2, c, False, i) for i, c in enumerate([0.6] * 1 + [0.7] * 3)]
    df = spark.createDataFrame(rows, "pair int, vote int, confidence double, hard boolean, place int").repartition(3)
    assert L.silver_labels(df).first()["confidence"] == 0.837
    assert L.silver_labels(df.drop("place")).first()["confidence"] == 0.838  # of the exact sum
