"""Micro-fixtures that can be checked by hand."""

import inspect
import json

import numpy as np
from pyspark.sql import functions as F

from lodespark.functions import sets, text
from lodespark.operators import coverage, evaluation, fusion, graph, literature, retrieval, signals
from lodespark.operators.components import connected_components
from lodespark.sources import jsonl
from lodespark.streaming import feedback


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_rrf_ties_by_id(spark):
    runs = spark.createDataFrame([("a", 1, d, 0.0, r) for r, d in enumerate(["d1", "d2", "d3"], 1)] + [("b", 1, d, 0.0, r) for r, d in enumerate(["d2", "d1", "d4"], 1)], "system string, query_id int, doc_id string, score double, rank int")
    got = [(r.doc_id, r.rank) for r in fusion.rrf(runs).orderBy("rank").collect()]
    assert got == [("d1", 1), ("d2", 2), ("d3", 3), ("d4", 4)]
    assert fusion.rrf(runs).where("doc_id = 'd1'").first().score == round(1 / 61 + 1 / 62, 9)


def test_constant_list_normalises_to_one(spark):
    runs = spark.createDataFrame([("a", 1, 1, 5.0, 1), ("a", 1, 2, 5.0, 2)], "system string, query_id int, doc_id int, score double, rank int")
    assert {r.score for r in fusion.weighted_sum(runs).collect()} == {1.0}


def test_source_diversity_defers_or_drops(spark):
    r = spark.createDataFrame([(1, k, "x" if k < 4 else None, 10.0 - k) for k in range(6)], "query_id int, doc_id int, source string, score double")
    assert [x.doc_id for x in fusion.source_diversity(r, 2).orderBy("rank").collect()] == [0, 1, 4, 5, 2, 3]
    assert [x.doc_id for x in fusion.source_diversity(r, 2, drop=True).orderBy("rank").collect()] == [0, 1, 4, 5]


def test_bigrams_of_one_token_and_of_none(spark):
    df = spark.createDataFrame([("One",), ("",), (None,), ("a b c",)], "t string").select(text.with_bigrams(text.tokens(F.col("t"))).alias("w"))
    assert [r.w for r in df.collect()] == [["one"], [], [], ["a", "b", "c", "a_b", "b_c"]]


def test_term_in_all_documents_has_no_idf(spark):
    docs = spark.createDataFrame([(k, "common " + ("rare" if k == 0 else "")) for k in range(30)], "doc_id int, text string")
    index = retrieval.postings(docs, {"body": F.col("text")}, bigrams=False)
    idf = {r.term: r.idf for r in retrieval.idf_table(index, docs.agg(F.count("*").alias("n"))).collect()}
    assert idf["common"] == 0 and idf["rare"] > 2


def test_dois_and_phrases(spark):
    r = spark.createDataFrame([("see https://doi.org/10.1234/AbC. and 10.1234/abc", "x y")], "t string, u string")
    got = r.select(text.extract_dois(F.col("t")).alias("d"), text.contains_phrase(F.col("u"), "x").alias("x"), text.contains_phrase(F.col("u"), "y z").alias("z"), text.normalize_doi(F.lit(" DOI:10.5/X; ")).alias("n")).first()
    assert got.d == ["10.1234/abc"] and got.x and not got.z and got.n == "10.5/x"


def test_set_scores_on_empty(spark):
    e = spark.createDataFrame([([], [], ["a"])], "a array<string>, b array<string>, c array<string>")
    assert tuple(e.select(sets.jaccard(F.col("a"), F.col("b")), sets.dice(F.col("a"), F.col("b")), sets.overlap_ratio(F.col("a"), F.col("c")), sets.field_score(F.col("a"), F.col("c"))).first()) == (0.0, 0.0, 0.0, 0.5)


def test_graph_with_cycle_loop_and_isolated(spark):
    e = spark.createDataFrame([("a", "b", "t", 1.0), ("b", "c", "t", 1.0), ("c", "a", "t", 1.0), ("d", "d", "t", 1.0), ("c", "x", "t", 0.05)], "src string, dst string, etype string, confidence double")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.bfs(e, start, 5), "node", "hops") == [("a", 0), ("b", 1), ("c", 2), ("x", 3)]
    assert rows(graph.simple_paths(e, start, spark.createDataFrame([("x",)], "node string"), 3), "path") == [("a>b>c>x",), ("a>c>x",)]
    assert rows(graph.metapath(e, [("t", True), ("t", True)], least=0.1), "start", "target") == [("a", "c"), ("b", "a"), ("c", "b"), ("d", "d")]
    nodes = spark.createDataFrame([(n,) for n in "abcdz"], "node string")
    assert dict(rows(graph.quality_report(e, nodes, 0.1), "issue", "n")) == {"dangling": 1, "weak_confidence": 1, "self_loop": 1, "orphan": 1}


def test_components_of_chains(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7), (None, 3)], "src int, dst int")
    got = dict(rows(connected_components(e), "node", "component"))
    assert all(got[k] == 0 for k in range(41)) and got[101] == 100 and len(got) == 43
    assert connected_components(e.where("false")).count() == 0


def test_votes_round_half_to_even(spark):
    v = spark.createDataFrame([("x", 1, 1.0, False), ("x", 2, 1.0, False), ("y", 2, 1.0, False), ("y", 3, 1.0, False), ("z", 3, 1.0, True)], "item string, vote int, confidence double, hard_negative boolean")
    assert rows(evaluation.vote_ensemble(v), "item", "label", "confidence") == [("x", 2, 1.0), ("y", 2, 1.0), ("z", 0, 0.95)]


def test_metrics_without_relevant(spark):
    runs = spark.createDataFrame([("s", 1, 1, 1.0, 1, 0), ("s", 1, 2, 0.5, 2, 1)], "system string, query_id int, doc_id int, score double, rank int, grade int")
    judged = runs.select("query_id", "doc_id", "grade")
    assert evaluation.binary_metrics(runs, judged, 10).first().rr == 0
    assert evaluation.hard_negative_rate(runs, 10).first().rate == 0
    assert evaluation.hard_negative_rate(runs, 10, if_none="all").first().rate == 1


def test_confidence_on_bin_edges(spark):
    r = spark.createDataFrame([(0.1, 1.0), (1.0, 1.0), (0.0, 0.0)], "confidence double, label double")
    assert rows(evaluation.reliability_bins(r), "bin", "n") == [(0, 1), (1, 1), (9, 1)]


def test_cross_findings(spark):
    f = spark.createDataFrame([(1, 1, ["r", "s"], "t", "increase", False, 2000), (2, 2, ["r", "s"], "t", "decrease", False, 2000), (3, 3, ["r"], "t", "increase", True, 2000), (4, 1, ["r"], "t", "increase", False, 2000)], "finding_id int, paper_id int, regions array<string>, task string, direction string, negated boolean, year int")
    assert rows(literature.cross_finding_edges(f), "a", "b", "relation", "n_regions") == [(1, 2, "contradicts", 2), (2, 3, "direct_refutation", 1), (2, 4, "contradicts", 1)]


def test_dark_pairs_and_uncovered(spark):
    e = spark.createDataFrame([(1, "a", "x", 1.0), (1, "b", "u", 1.0), (2, "a", "y", 1.0), (2, "b", "v", 0.1)], "dataset_id int, dimension string, value string, confidence double")
    assert rows(coverage.dark_pairs(e, "a", "b", 5), "value_a", "value_b") == [("y", "u")]
    vocabulary = spark.createDataFrame([("u",), ("v",)], "value string")
    assert rows(coverage.uncovered_values(vocabulary, e, "b"), "value") == [("v",)]


def test_spectrum_of_a_sine():
    t = np.arange(512)
    f, p = signals.welch(np.sin(2 * np.pi * 0.125 * t), 1.0, 64)
    assert abs(f[p.argmax()] - 0.125) < 1e-9 and abs(p.sum() * (f[1] - f[0]) - 0.5) < 0.02


def test_short_and_flat_signals_give_nothing(spark):
    s = spark.createDataFrame([("short", k, float(k)) for k in range(3)] + [("flat", k, 1.0) for k in range(50)], "signal string, at long, value double")
    assert signals.psd(s).count() == 0


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", "s", ["x"]), ("a", "s", None)], "dataset_id string, source string, species array<string>")
    jsonl.write_records(df, str(tmp_path / "r"))
    with open(tmp_path / "bad.jsonl", "w") as f:
        f.write('{"dataset_id": "c", "source": "t"}\n\n{broken\n{"source": "none"}\n')
    assert rows(jsonl.read_records(spark, str(tmp_path / "r")), "dataset_id") == [("a",), ("b",)]
    assert rows(jsonl.read_records(spark, str(tmp_path / "bad.jsonl")), "dataset_id") == [("c",)]
    assert jsonl.read_records(spark, str(tmp_path / "missing")).count() == 0


def test_graph_round_trip_and_errors(spark, tmp_path):
    n = spark.createDataFrame([("a", "t", "A"), ("b", "t", "B")], "node_id string, node_type string, label string")
    e = spark.createDataFrame([("e1", "a", "b", "x", 0.5)], "edge_id string, src string, dst string, etype string, confidence double")
    jsonl.write_graph(n, e, str(tmp_path / "g"), {"v": "1"})
    meta, nodes, edges = jsonl.read_graph(spark, str(tmp_path / "g"))
    assert meta.count() == 1 and rows(nodes, "node") == [("a",), ("b",)] and rows(edges, "src", "dst", "confidence") == [("a", "b", 0.5)]
    (tmp_path / "bad").write_text(json.dumps({"record_type": "node", "id": "a"}) + "\n" + json.dumps({"record_type": "node", "id": "a"}) + "\n")
    try:
        jsonl.read_graph(spark, str(tmp_path / "bad"))[1].collect()
        raise AssertionError("duplicate ids must fail")
    except Exception as error:
        assert "occurs twice" in str(error)


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.union(events.limit(50)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = feedback.read_events(spark, str(tmp_path / "in"), 1)
    q = feedback.usefulness_counts(feedback.once(stream, "400 days")).writeStream.outputMode("update").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    got = dict(spark.sql("SELECT event_type, max(n) AS n FROM counts GROUP BY event_type").collect())
    assert got == dict(events.groupBy("event_type").count().collect())
    out = str(tmp_path / "out")
    known = lambda s: s.read.schema(feedback.EVENTS).parquet(out) if (tmp_path / "out").exists() else s.createDataFrame([], feedback.EVENTS)
    for k in range(2):  # a replay adds nothing
        feedback.ingest(feedback.read_events(spark, str(tmp_path / "in")), out, str(tmp_path / f"c{k}"), known).awaitTermination()
    assert spark.read.parquet(out).count() == events.count()


def test_bootstrap_of_many_resamples_has_the_spread_of_the_mean(spark):
    metrics = spark.range(400).selectExpr("'s' AS system", "id AS query_id", "double(id % 2) AS x")
    low, high = evaluation.bootstrap_means(metrics, "x").select("low", "high").first()
    assert abs(low - (0.5 - 1.96 * 0.025)) < 0.006 and abs(high - (0.5 + 1.96 * 0.025)) < 0.006
    assert inspect.signature(evaluation.bootstrap_means).parameters["resamples"].default >= 1000  # as the reference has it


def test_bootstrap_weights_go_as_far_as_poisson_does():
    assert evaluation.POISSON[5] < 0.9995 and evaluation.POISSON[-2] < 1 and abs(evaluation.POISSON[-1] - 1) < 1e-15
