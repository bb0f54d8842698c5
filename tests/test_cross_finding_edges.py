"""Edges between findings of any years that share one region or more, against a comparison of all."""

import random

from lodespark.operators import literature as L


def test_edges_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.randrange(12), rnd.choice("tu"), rnd.choice(["increase", "decrease", "none", "other", "correlation"]), rnd.random() < 0.3, 2000 + rnd.randrange(5), rnd.sample("abcdefgh", 1 + k % 4)) for k in range(60)]
    want = {}
    for a, pa, ta, da, na, _, ra in rows:
        for b, pb, tb, db, nb, _, rb in rows:
            n, odd = len(set(ra) & set(rb)), {"other", "correlation"} & {da, db}
            relation = ("supports" if not (na or nb) else None) if da == db else "direct_refutation" if na or nb else "contradicts"
            if a < b and pa != pb and ta == tb and n and not odd and relation:
                want[a, b] = (relation, n, round(min(0.95 if relation == "supports" else 0.9, 0.6 + 0.1 * n), 6))
    df = spark.createDataFrame(rows, "finding_id bigint, paper_id bigint, task string, direction string, negated boolean, year int, regions array<string>")
    got = {(r.a, r.b): (r.relation, r.n_regions, r.confidence) for r in L.cross_finding_edges(df).collect()}
    assert got == want and any(n == 1 for _, n, _ in want.values())


def test_blocks_against_brute_force(spark, monkeypatch):
    """Blocks and products of any size, rows that share a finding_id, nulls, and repeated regions; no row for a shared region."""
    monkeypatch.setattr(L, "BLOCK", 16)
    monkeypatch.setattr(L, "TILE", 3)
    monkeypatch.setattr(L, "WIDE", 2)
    rnd = random.Random(2)
    pick = lambda *x: rnd.choice([*x, None])
    rows = [(k % 75 if k % 9 else None, pick(*range(9)), pick(*"tu"), pick("increase", "decrease", "none", "other", "correlation", "new"), pick(True, False, False), 2000, [pick(*"abcde") for _ in range(k % 5)] if k % 11 else None) for k in range(120)]
    want = {}
    for a, pa, ta, da, na, _, ra in rows:
        for b, pb, tb, db, nb, _, rb in rows:
            n = sum(x == y and x is not None for x in ra or () for y in rb or ())
            if None in (a, b, pa, pb, ta, tb, da, db) or a == b or pa == pb or ta != tb or not n:
                continue
            sure = na is False and nb is False
            code = (0 if sure and da not in ("other", "correlation") else None) if da == db else (1 if sure else 2) if {da, db} <= {"increase", "decrease", "none"} else None
            if code is not None:
                old = want.get((a, b), (0, 0))
                want[a, b] = (max(old[0], code), old[1] + n)
    df = spark.createDataFrame(rows, "finding_id bigint, paper_id bigint, task string, direction string, negated boolean, year int, regions array<string>")
    code = {"supports": 0, "contradicts": 1, "direct_refutation": 2}
    got = L.cross_finding_edges(df)
    assert {(r.a, r.b): (code[r.relation], r.n_regions) for r in got.collect()} == {k: v for k, v in want.items() if k[0] < k[1]}
    asked = L.cross_finding_edges(df, df.where("finding_id % 3 = 0")).collect()
    assert {(r.a, r.b): (code[r.relation], r.n_regions) for r in asked} == {k: v for k, v in want.items() if k[0] % 3 == 0}
    assert len(asked) == len({(r.a, r.b) for r in asked})
    assert L.cross_finding_edges(df.where("false")).count() == 0
    assert "region" not in [c for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line for c in line.split()]
    once = L.cross_finding_edges(df.where("finding_id IS NOT NULL").dropDuplicates(["finding_id"]))
    assert "explode(regions" not in once._jdf.queryExecution().analyzed().toString()  # the old form made a row for each region


def test_blocks_of_queries_are_not_shuffled_once_for_each_other_block(spark):
    rows = [(k, k % 5, "t", "none", False, 2000, ["a"]) for k in range(40)]
    df = spark.createDataFrame(rows, "finding_id bigint, paper_id bigint, task string, direction string, negated boolean, year int, regions array<string>")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = L.cross_finding_edges(df, df.where("finding_id % 10 = 0"))
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [task" in plan and "SortMergeJoin" not in plan and "explode(sequence" not in plan
        assert edges.count() == 4 * 32
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
