"""Catalogue, linking and graph operators on hand-made rows: nulls, empty arrays, ties, repeats."""

import random

from pyspark.sql import functions as F

from lodespark.operators import catalog as C, evaluation as E, graph as G, linking as L, literature as Lit, retrieval as R


def test_filters_and_violations(spark):
    df = spark.createDataFrame([(1, ["Brand#1", "x"], "A b", 2.0), (2, None, "a-B", 5.0), (3, [], None, None), (4, ["brand 1"], "A_B", 7.0)], "id int, tags array<string>, name string, score double")
    schema = {"tags": "array<string>", "name": "string", "score": "double"}
    ids = lambda f: [r.id for r in df.where(C.passes(f, schema)).orderBy("id").collect()]
    assert ids({"tags": ["BRAND 1"]}) == [1, 4] and ids({"name": "a b", "min_score": 5.0}) == [2, 4] and ids({}) == [1, 2, 3, 4] and ids({"name": ["A/B"]}) == [1, 2, 4]
    got = {r.id: r.v for r in df.select("id", C.violations({"tags": ["Brand#1", "X"]}).alias("v")).collect()}
    assert got == {1: ["tags:brand 1", "tags:x"], 2: [], 3: [], 4: ["tags:brand 1"]}


def test_null_years_and_citations(spark):
    df = spark.createDataFrame([(1, 2000, None, "V"), (2, None, 9, "V"), (3, 2005, 3, None)], "id int, year int, citations int, venue string")
    ids = lambda **k: [r.id for r in df.where(C.paper_filter(**k)).orderBy("id").collect()]
    assert ids(min_year=1999) == [1, 3] and ids(min_citations=1) == [2, 3] and ids(venues=["v"]) == [1, 2] and ids() == [1, 2, 3]


def test_gate_levels_completeness(spark):
    df = spark.createDataFrame([(1, ["u", "b", "a"], "x"), (2, [], ""), (3, None, None)], "id int, xs array<string>, name string")
    kinds = {"xs": "array<string>", "name": "string"}
    got = df.select("id", C.gate([("empty", F.size("xs") > 0), ("nameless", F.col("name") == "x")]).alias("g"), C.first_mapped(F.col("xs"), {"a": "A", "b": "B"}).alias("l"), C.completeness(kinds).alias("c"), C.missing_fields(kinds).alias("m")).collect()
    assert [(r.g, r.l, r.c, r.m) for r in sorted(got)] == [("ok", "B", 1.0, []), ("empty", None, 0.0, ["xs", "name"]), ("empty", None, 0.0, ["xs", "name"])]


def test_adjudication(spark):
    rows = [("a", 1, 2, None, False), ("a", 2, 2, None, False), ("b", 1, 1, None, False), ("b", 2, 3, None, False), ("c", 1, 1, None, True), ("d", 1, 0, 2, False), ("d", 2, 0, 3, False), ("d", 3, 1, None, False), ("e", 1, None, 3, False), ("f", 1, 2, None, None), ("f", 2, 2, None, None), ("g", 1, 2, None, None), ("g", 2, 2, None, True)]
    df = spark.createDataFrame(rows, "candidate string, at int, score int, final int, violation boolean")
    got = {r.candidate: (r.score, r.status, r.disagreement) for r in L.adjudicated(df).collect()}
    assert got == {"a": (2, "agreement", False), "b": (1, "needs_adjudication", True), "c": (1, "single_review", False), "d": (3, "adjudicated", True), "f": (2, "agreement", False), "g": (2, "needs_adjudication", True)}


def test_silver_labels(spark):
    rows = [(1, 3, 0.5, False), (1, 2, 0.5, False), (2, None, 0.9, False), (3, 0, 0.8, True), (3, 3, 0.9, False), (4, 2, 0.6, False), (4, 2, 0.8, False)]
    got = {r.pair: (r.relevance, r.confidence, r.disagree, r.priority) for r in L.silver_labels(spark.createDataFrame(rows, "pair int, vote int, confidence double, hard boolean")).collect()}
    assert got[1][0] == 2 and got[2] == (1, 0.3, True, 0.6) and got[3] == (0, 0.8, True, 0.45) and got[4] == (2, 0.85, False, 0.0)  # 2.5 rounds to even


def test_links(spark):
    papers = spark.createDataFrame([(1, "Ann"), (1, "bob"), (1, "ANN "), (2, "cy")], "paper int, author string")
    data = spark.createDataFrame([(7, "ann"), (7, "Bob"), (8, "bob")], "dataset int, author string")
    assert [(r.paper, r.dataset, r.shared, r.confidence) for r in L.author_links(papers, data).collect()] == [(1, 7, 2, 0.7)]
    keys = lambda n, rows: spark.createDataFrame(rows, f"{n} int, key string")
    assert [tuple(r) for r in L.identifier_links(keys("paper", [(1, ""), (2, None), (3, "k")]), keys("dataset", [(1, ""), (2, None), (3, "k"), (3, "k")])).collect()] == [(3, 3)]


def test_transitive_stops_at_targets(spark):
    e = spark.createDataFrame([("a", "t1"), ("t1", "t2"), ("a", "b"), ("b", "t3"), ("b", "a"), ("t3", "t4")], "src string, dst string")
    got = {(r.node, r.hops, r.weight) for r in G.transitive(e, spark.createDataFrame([("a",)], "node string"), "t").collect()}
    assert got == {("t1", 1, 0.8), ("t3", 2, 0.6)}


def test_hierarchy_scores(spark):
    closure = spark.createDataFrame([("top", "mid"), ("mid", "low"), ("top", "low")], "ancestor string, node string")
    have = spark.createDataFrame([(1, "mid"), (2, "low"), (3, "top"), (4, "cort_x"), (5, None), (6, "low"), (6, "mid")], "id int, region string")
    got = {r.id: r.score for r in G.hierarchy_score(have, ["mid", "cort_y"], closure).collect()}
    assert got == {1: 1.0, 2: 0.7, 3: 0.5, 4: 0.4, 5: 0.0, 6: 1.0}


def test_containment_of_short_and_long_passages(spark):
    docs = spark.createDataFrame([(1, "xa b c d ey and more"), (2, "a  b c d e"), (3, "b"), (4, None), (5, "a b c d e a b c d e")], "doc_id int, text string")
    passages = spark.createDataFrame([(10, "a b c d e"), (11, "b"), (12, "a b c d e f")], "item_id int, passage string")
    got = sorted((r.item_id, r.doc_id) for r in R.containment(docs, passages).collect())
    assert got == [(10, 1), (10, 5), (11, 1), (11, 2), (11, 3), (11, 5)]


def test_ranks_within_ranges(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.choice([0.1, 0.1, 0.5, rnd.random()]), float(k % 2)) for k in range(503)]
    df = spark.createDataFrame(rows, "id int, confidence double, label double")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want, at = {}, 0
    for b in range(10):
        n = 503 // 10 + (b < 503 % 10)
        want[b] = (n, round(sum(r[1] for r in order[at : at + n]) / n, 6))
        at += n
    assert {r.bin: (r.n, round(r.conf, 6)) for r in E.quantile_bins(df).collect()} == want


def test_relation_counts_equal_the_edges(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.randrange(6), rnd.choice("tu"), rnd.choice(["increase", "decrease", "none", "other"]), rnd.random() < 0.3, 2000, rnd.sample("abcd", 1)) for k in range(80)]
    df = spark.createDataFrame(rows, "finding_id bigint, paper_id bigint, task string, direction string, negated boolean, year int, regions array<string>")
    edges = {r.relation: r["count"] for r in Lit.cross_finding_edges(df).groupBy("relation").count().collect()}
    counts = {r.relation: r.n for r in Lit.relation_counts(df).groupBy("relation").agg(F.sum("pairs").alias("n")).collect()}
    assert edges == counts and Lit.relation_counts(df.where("false")).count() == 0


def test_asked_names_are_normalised_like_stored_ones(spark):
    names = spark.createDataFrame([("n1", "Two-Photon imaging."), ("n2", "other"), ("n3", None)], "node string, name string")
    assert [r.node for r in G.nodes_by_name(names, ["two/photon  Imaging"]).collect()] == ["n1"]
    papers = spark.createDataFrame([(1, "J. Neuro-Science"), (2, None)], "id int, venue string")
    assert [r.id for r in papers.where(C.paper_filter(venues=["j neuro science."])).collect()] == [1]


def test_sets_without_required_kinds(spark):
    members = spark.createDataFrame([(1, "a", 0.5, ["x"], ["t"])], "set_id int, item string, usefulness double, kinds array<string>, traits array<string>")
    (row,) = C.set_scores(members, [], ["y"]).collect()
    assert (row.coverage, row.score) == (0.0, 0.7)


def test_best_partners_compares_whole_sets(spark, tmp_path):
    """Two customers that share only the last of their four brands."""
    from lodespark.plans import registry

    def put(name, columns, rows):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    brands = {100: "abcy", 101: "defy"}
    put("customer", "c_custkey long, c_name string, c_mktsegment string, c_nationkey int, c_acctbal double", [(c, str(c), "x", 1, 0.0) for c in brands])
    put("orders", "o_orderkey long, o_custkey long", [(c, c) for c in brands])
    put("part", "p_partkey long, p_brand string, p_type string", [(ord(b), b, "t") for b in "abcdefy"])
    put("lineitem", "l_orderkey long, l_partkey long", [(c, ord(b)) for c, bs in brands.items() for b in bs])
    got = registry()["best_partners"][0](spark, str(tmp_path)).collect()
    want = 0.25 + 0.15 + 0.10 + 0.15 / 4 + 0.15 / 7 + 0.05  # task, modality, species, region 1 of 4, affordance 1 of 7
    assert [(r.a, r.b, r.score, r["rank"]) for r in got] == [(100, 101, round(want, 6), 1)]
