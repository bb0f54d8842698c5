"""Rows that a query makes on the way do not grow with the square of its input where its result does not."""

import pytest

from lodespark.operators import linking as L


def most_rows(df):
    """The collected rows, and the most rows that any operator of the executed plan put out."""
    out = df.collect()

    def walk(p):
        kind = p.nodeName()
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlan" else [p.plan()] if kind.endswith("QueryStage") else [p.children().apply(k) for k in range(p.children().size())]
        own = p.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(walk, below)])

    return out, walk(df._jdf.queryExecution().executedPlan())


def test_concept_links_score_equal_datasets_once(spark):
    concepts = lambda n, name: spark.range(n).selectExpr(f"id AS {name}", "explode(array(named_struct('type', 'x', 'concept', 'p'), named_struct('type', 'x', 'concept', 'q'), named_struct('type', 'y', 'concept', string(id % 3))))").selectExpr(name, "col.type", "col.concept")
    got, most = most_rows(L.concept_links(concepts(300, "paper"), concepts(600, "dataset"), {"x": 0.6, "y": 0.4}, 4, 0.1))
    want = {(p, p % 3 + 3 * r, 3, 1.0, 1.0, r + 1) for p in range(300) for r in range(4)}
    assert {(r.paper, r.dataset, r.shared, r.similarity, r.confidence, r["rank"]) for r in got} == want
    assert most < 20_000  # 180,000 pairs share concepts


@pytest.mark.parametrize("shared_least", [1, 2])
def test_concept_links_ties_across_classes(spark, shared_least):
    """Datasets of several classes and one similarity are ranked by id, with types that only one side has."""
    p = spark.createDataFrame([(1, "x", "a"), (1, "x", "b"), (2, "y", "c"), (3, "z", "d")], "paper int, type string, concept string")
    d = spark.createDataFrame([(k, "x", c) for k, c in ((9, "a"), (8, "b"), (7, "a"), (6, "b"), (5, "a"), (5, "b"))] + [(4, "y", "c"), (4, "x", "n"), (3, "z", "d")], "dataset int, type string, concept string")
    got = {(r.paper, r.dataset, r.shared, r.similarity, r["rank"]) for r in L.concept_links(p, d, {"x": 0.5, "y": 0.5}, 3, 0.1, shared_least).collect()}
    both = {(1, 5, 2, 1.0, 1)}
    assert got == (both if shared_least == 2 else both | {(1, 6, 1, 0.5, 2), (1, 7, 1, 0.5, 3), (2, 4, 1, 0.5, 1)})


def test_signal_links_score_equal_datasets_once(spark):
    keys = lambda n, name: spark.range(n).selectExpr(f"id AS {name}", "stack(2, 'task', string(id % 2), 'region', string(id % 5)) AS (signal, key)")
    direct = spark.createDataFrame([(0, 4, "doi", 1.0), (0, 5, "doi", 1.0), (1, 1, "doi", 1.0)], "paper long, dataset long, signal string, strength double")
    strengths = {"task": 0.6, "region": 0.4}
    got, most = most_rows(L.keyed_signal_links(direct, keys(50, "paper"), keys(400, "dataset"), strengths, 0.58))
    met = keys(50, "paper").join(keys(400, "dataset"), ["signal", "key"]).selectExpr("paper", "dataset", "signal", "IF(signal = 'task', 0.6D, 0.4D) AS strength")
    want = L.signal_links(direct.unionByName(met), 0.58).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 8002
    assert most <= len(want)  # 14,000 signals of pairs are not made


def test_pairs_are_not_rows_before_they_are_wanted(spark):
    """Best partners of a few records among many with shared values, nulls and empty sets, held against a plain loop."""
    from lodespark.operators import catalog as C, pairing as P

    def record(k):
        tasks = None if k == 7 else ["a", "b", "c", None][: k % 5] if k % 11 else ["c", "c", "a"]
        return (k, [None, "x", "y"][k % 3], tasks, ["m"], None if k == 9 else [str(k % 4)] if k % 6 else [], [f"r{j}" for j in range(k % 7)], [], [f"v{k % 13}"])

    data = [record(k) for k in range(900)]
    names = ("tasks", "modalities", "species", "regions", "events", "affordances")
    df = spark.createDataFrame(data, "id long, source string, " + ", ".join(f"{c} array<string>" for c in names))
    got, most = most_rows(C.best_per_kind(C.pair_type(P.pair_features(df.where("id % 30 = 0"), df, least=0.3, best=2)), 2, 0.3))
    assert most < 5_000  # of 27,000 pairs

    def features(x, y):
        s, t = dict(zip(names, x[2:], strict=True)), dict(zip(names, y[2:], strict=True))
        meeting = [n for n in names if n != "species"]
        if any(u[n] is None for u in (s, t) for n in meeting) or not any((set(s[n]) & set(t[n])) - {None} for n in meeting):
            return None
        jac = lambda n: len(set(s[n]) & set(t[n])) / len(set(s[n]) | set(t[n])) if s[n] is not None and t[n] is not None and set(s[n]) | set(t[n]) else 0.0
        low = min(len(set(s["regions"])), len(set(t["regions"])))
        region = len(set(s["regions"]) & set(t["regions"])) / low if low else 0.0
        clash = bool(s["species"]) and bool(t["species"]) and not set(s["species"]) & set(t["species"])
        far = x[1] is not None and y[1] is not None and x[1] != y[1]
        return jac("tasks"), jac("modalities"), jac("species"), region, jac("events"), jac("affordances"), far, clash

    rows = [(x[0], y[0], *f) for x in data if x[0] % 30 == 0 for y in data if x[0] != y[0] and (f := features(x, y))]
    plain = spark.createDataFrame(rows, "a long, b long, task double, modality double, species double, region double, event double, affordance double, far boolean, clash boolean")
    want = C.best_per_kind(C.pair_type(plain), 2, 0.3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 60
    kept = P.pair_features(df.where("id % 30 = 0"), df, ordered=True).count()
    assert kept == sum(r[0] < r[1] for r in rows)


def test_metapath_merges_from_the_smaller_end(spark):
    """Many starts, many nodes on the way and two targets: no row for a start and a node before the last."""
    from lodespark.operators import graph as G

    e = spark.sql("""SELECT concat('c', a.id) src, concat('p', b.id) dst, 'uses' etype, 0.9D confidence FROM range(200) a, range(10) b UNION ALL
        SELECT concat('p', a.id), concat('s', b.id), 'by', 0.8D + b.id / 1000 FROM range(10) a, range(100) b UNION ALL SELECT concat('s', id), concat('n', id % 2), 'in', 0.5D FROM range(100)""")
    steps = [("uses", True), ("by", True), ("in", True)]
    got, most = most_rows(G.metapath(e, steps, 0.1, 0.8, backward=True))
    assert sorted(map(tuple, got)) == sorted(map(tuple, G.metapath(e, steps, 0.1, 0.8).collect())) and len(got) == 400
    assert most <= 4_000  # 200,000 when starts meet all nodes on the way
    assert G.metapath(e, steps, 0.5, backward=True).collect() == []


def test_equal_records_are_scored_once(spark):
    """900 records of 30 classes: pairs of classes are scored, and give the pairs and best partners of the records."""
    from lodespark.operators import catalog as C, pairing as P

    def record(k):
        c = k % 30
        return (k, [None, "x", "y"][c % 3], ["a", "b", "c", None][: c % 5], ["m"], None if c == 9 else [str(c % 4)] if c % 6 else [], [f"r{j}" for j in range(c % 7)], [], [f"v{c % 13}"])

    names = ("tasks", "modalities", "species", "regions", "events", "affordances")
    df = spark.createDataFrame([record(k) for k in range(900)], "id long, source string, " + ", ".join(f"{c} array<string>" for c in names))
    asked = df.where("id % 7 = 0")
    classes = C.pair_type(P.class_features(asked, df, least=0.3))
    assert classes.count() <= 30 * 30
    rows = lambda t: sorted(map(tuple, t.where("score >= 0.3").select("a", "b", "kind", "score").collect()))
    got = rows(P.members_met(classes))
    assert got == rows(C.pair_type(P.pair_features(asked, df, least=0.3))) and len(got) > 40_000
    best = lambda t: sorted(map(tuple, C.best_per_kind(t, 2, 0.3).collect()))
    some = P.members_met(C.pair_type(P.class_features(asked, df, least=0.3, best=2)))
    assert best(some) == best(C.pair_type(P.pair_features(asked, df, least=0.3, best=2))) and some.count() < len(got) / 2


def test_members_of_a_class_come_in_parts(spark, monkeypatch):
    from lodespark.operators import pairing as P

    monkeypatch.setattr(P, "MEMBERS", 7)
    names = ("tasks", "modalities", "species", "regions", "events", "affordances")
    df = spark.range(50).selectExpr("id", "'x' AS source", *(f"array('{c}') AS {c}" for c in names))
    rows = P.class_features(df.where("id % 2 = 0"), df)
    assert rows.selectExpr("max(size(a))", "max(size(b))").first() == (7, 7)
    assert {(r.a, r.b) for r in P.members_met(rows).collect()} == {(a, b) for a in range(0, 50, 2) for b in range(50) if a != b}


def test_related_by_hubs_equals_all_pairs(spark):
    """Nodes that share a hub are not all paired; several hubs, nodes without one, and ties, held against the plain join."""
    from lodespark.operators import graph as G

    rnd = __import__("random").Random(4)
    rows = [(f"c{k:03}", f"p{rnd.randrange(200)}", "uses") for k in range(400) for _ in range(k % 4)]
    rows += [(f"c{k:03}", f"n{h}", "in") for k in range(400) for h in {k % 3, k % 7 % 3} if k % 10]
    edges = spark.createDataFrame(rows, "src string, dst string, etype string").selectExpr("*", "1.0D AS confidence")
    starts = spark.createDataFrame([(f"c{k:03}",) for k in range(1, 400, 13)], "node string")
    weights = {"uses": 3.0, "in": 1.0}
    got, most = most_rows(G.related(edges, weights, starts, 5, hubs=("in",)))
    want, all_pairs = most_rows(G.related(edges, weights, starts, 5))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 50
    one, few = most_rows(G.related(edges.where("etype = 'in'"), weights, spark.createDataFrame([("c001",), ("c002",)], "node string"), 5, hubs=("in",)))
    assert len(one) == 10 and few <= len(rows)


def test_paths_do_not_fan_out_where_no_target_is_near(spark):
    """50 starts and 1950 others at one hub, and a target behind another node: no path from the hub to the others is made."""
    from lodespark.operators import graph as G

    rows = [(f"c{k}", "hub") for k in range(2000)] + [("c0", "p"), ("p", "q"), ("q", "s"), ("hub", "s")]
    edges = spark.createDataFrame(rows, "src string, dst string").selectExpr("*", "'t' AS etype", "1.0D AS confidence")
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    paths, most = most_rows(G.simple_paths(edges, nodes(*(f"c{k}" for k in range(50))), nodes("s"), 3))
    assert sorted(r.path for r in paths) == sorted([f"c{k}>hub>s" for k in range(50)] + ["c0>p>q>s"])
    assert most < 10_000  # of 100,000 walks of two steps
    twice = G.simple_paths(edges.union(edges.where("src = 'c0'")), nodes("c0", "c0", "c1"), nodes("s", "s"), 3)
    assert sorted(r.path for r in twice.collect()) == ["c0>hub>s", "c0>hub>s", "c0>p>q>s", "c0>p>q>s", "c1>hub>s"]
