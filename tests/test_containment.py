"""Concepts by containment of token sets against a comparison of all; the plan has no join of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodespark.operators import containment as C

RECORD, CONCEPT = "record string, term string, word string", "concept string, term string, n int"


def words(term):
    return frozenset((term or "").lower().replace("_", " ").replace("-", " ").split())


def wanted(records, concepts):
    out = set()
    for r, rt, _ in records:
        for c, ct, _ in concepts:
            a, b = words(rt), words(ct)
            if r is not None and c is not None and a and b and (a <= b or b <= a):
                out.add((r, c))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_containment_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    term = lambda most: rnd.choice([" ", "_", "-"]).join(rnd.choices(["Alpha", "beta", "gamma", "delta", "x1", "hot", "hot", "hot"], k=rnd.randint(1, most)))
    records = [(f"r{k % 40}", term(5), "clash") for k in range(90)] + [("r1", None, "x"), ("r2", "", "x"), (None, "hot", "x"), ("r3", "--", "x"), ("r4", "alpha " * 5000, "x")]
    concepts = [(f"c{k % 20}", term(3), 1) for k in range(30)] + [("c1", None, 1), (None, "hot", 1), ("c2", "", 1), ("c3", "never met", 1), ("c4", "alpha never", 1)]
    r, c = spark.createDataFrame(records * 2, RECORD), spark.createDataFrame(concepts, CONCEPT)
    got = C.contained_concepts(r, c).collect()
    assert {tuple(x) for x in got} == wanted(records, concepts) and len(got) == len({tuple(x) for x in got})
    assert C.contained_concepts(r.where("false"), c).count() == 0 and C.contained_concepts(r, c.where("false")).count() == 0


def test_plan_joins_on_keys(spark):
    r, c = spark.createDataFrame([("r", "a b", "x")], RECORD), spark.createDataFrame([("c", "a", 1)], CONCEPT)
    plan = C.contained_concepts(r, c)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_index_of_fields_and_concepts(spark):
    rows = [("a", ["Hippo-campus CA1", " "], ["mouse"]), ("b", None, ["Mouse", None]), ("c", None, None), (None, ["x"], ["y"])]
    df = spark.createDataFrame(rows, "record string, regions array<string>, species array<string>").withColumn("extra", F.lit(1))
    concepts = spark.createDataFrame([("k1", "campus", 1), ("k2", "old mouse", 1), ("k3", "rat", 1)], CONCEPT)
    got = {tuple(x) for x in C.concept_index(df, concepts, {"regions": "region", "species": "species"}).collect()}
    assert got == {("a", "k1"), ("a", "k2"), ("b", "k2"), ("a", "region:hippo_campus_ca1"), ("a", "species:mouse"), ("b", "species:mouse")}


def test_records_are_not_shuffled(spark, monkeypatch):
    """Only words' counts and matches pass an exchange, never a record's token set; with very many concepts the joins are plain and agree."""
    rnd = random.Random(9)
    term = lambda most: " ".join(rnd.choices(["alpha", "beta", "gamma", "delta", "x1", "hot"], k=rnd.randint(1, most)))
    records, concepts = [(f"r{k % 30}", term(5), "") for k in range(80)], [(f"c{k % 10}", term(3), 1) for k in range(20)]
    r, c = spark.createDataFrame(records, RECORD), spark.createDataFrame(concepts, CONCEPT)
    got = C.contained_concepts(r, c)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 3 and {tuple(x) for x in got.collect()} == wanted(records, concepts)
    monkeypatch.setattr(C, "SENT", 0)
    plain = C.contained_concepts(r, c)
    assert "strategy=broadcast" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(x) for x in plain.collect()} == wanted(records, concepts)
