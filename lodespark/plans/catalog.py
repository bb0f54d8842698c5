"""Catalogue queries: filters and scores of customers as records, links between orders as papers and parts as datasets."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lodespark.functions import sums as X, text as T
from lodespark.operators import catalog as C, graph as G, linking as L, pairing as P
from lodespark.plans.graph import STARTS, UND, _customers, _nodes
from lodespark.sources import tables as S

W = f"WITH {S.RECORDS}"
WE = f"WITH {S.EDGES}"
NORM = "trim(regexp_replace(regexp_replace(lower({x}), '[/_-]+', ' ', 'g'), '[^a-z0-9+]+', ' ', 'g'))"
SCHEMA = {"brands": "array<string>", "types": "array<string>", "source": "string", "title": "string", "balance": "double"}
EXCLUDED = {"brands": ["Brand#11", "Brand#22", "Brand#33"], "types": ["PROMO"]}
LEVELS = {"ECONOMY": "trial", "LARGE": "session", "PROMO": "subject", "STANDARD": "session"}


def _levels_sql(x):
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in LEVELS.items()) + " END"


def _papers(spark, d):
    o = S.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("paper"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("citations"), F.col("o_orderpriority").alias("venue"))


def _lines(spark, d):
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")


def _asked(spark, d):
    """Lines of the query orders, whose key 100 divides."""
    return _lines(spark, d).where("l_orderkey % 100 = 0")


def _record_scores(spark, d):
    r = S.records(spark, d).select("dataset_id", F.col("brands").alias("ontology"), F.col("types").alias("behavior"), F.array("source").alias("modality"), "title", "balance")
    heads = C.head_scores({"ontology": ["Brand#11", "Brand#12", "Brand#13"], "behavior": ["PROMO"], "modality": ["BUILDING", "MACHINERY"], "affordance": []})
    heads["paper"] = C.paper_score(F.col("ontology"))
    missing = F.size(C.missing_fields({"ontology": "array<string>", "behavior": "array<string>", "title": "string"}))
    score = C.record_score(heads, ~F.arrays_overlap("modality", F.array(F.lit("BUILDING"), F.lit("MACHINERY"))), missing, F.array_contains("behavior", "LARGE") & (F.col("balance") < 0))
    return r.select("dataset_id", score.alias("score"))


def _sets(spark, d):
    r = S.records(spark, d)
    return r.select(F.col("nation").alias("set_id"), F.col("dataset_id").alias("item"), F.least(F.lit(1.0), F.size("brands") / 25).alias("usefulness"), F.col("types").alias("kinds"), F.col("brands").alias("traits"))


def _features(spark, d, least, best=None, affordances=lambda: F.slice("brands", 1, 3)):
    """Customers whose id 100 divides as queries, against all."""
    r = S.records(spark, d).select(F.col("dataset_id").alias("id"), F.col("source"), F.col("types").alias("tasks"), F.array(F.lit("m")).alias("modalities"), F.array(F.col("nation").cast("string")).alias("species"), F.col("brands").alias("regions"), F.array().cast("array<string>").alias("events"), affordances().alias("affordances"))
    scored = C.pair_type(P.class_features(r.where("id % 100 = 0"), r, least=least, best=best))
    return P.members_met(scored.where(F.col("score") >= least).select("a", "b", "kind", "score"))


PAIRS = """r AS (SELECT *, [nation] AS species, brands[1:3] AS aff FROM records),
jac AS (SELECT a.dataset_id AS a, b.dataset_id AS b, len(list_intersect(a.types, b.types)) AS ti, len(list_distinct(list_concat(a.types, b.types))) AS tu, len(list_intersect(a.brands, b.brands)) AS bi, least(len(a.brands), len(b.brands)) AS bl,
        len(list_intersect(a.aff, b.aff)) AS ai, len(list_distinct(list_concat(a.aff, b.aff))) AS au, a.source <> b.source AS far, a.nation <> b.nation AS clash FROM r a JOIN r b ON a.dataset_id % 100 = 0 AND a.dataset_id <> b.dataset_id),
feat AS (SELECT a, b, far, clash, CASE WHEN tu > 0 THEN ti / tu ELSE 0 END AS task, 1.0::DOUBLE AS modality, CASE WHEN clash THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS species, CASE WHEN bl > 0 THEN bi / bl ELSE 0 END AS region, 0.0::DOUBLE AS event, CASE WHEN au > 0 THEN ai / au ELSE 0 END AS affordance FROM jac),
pairs AS (SELECT a, b, CASE WHEN task > 0.5 AND region < 0.3 THEN 'same_task_different_region' WHEN task > 0.5 AND species < 0.3 THEN 'same_task_different_species' WHEN modality > 0.5 AND task < 0.3 THEN 'same_modality_different_task'
          WHEN affordance > 0.3 THEN 'shared_affordance' WHEN task > 0.3 AND modality < 0.3 THEN 'complementary_modalities' ELSE 'general_similarity' END AS kind,
          round(least(1, greatest(0, 0.25::DOUBLE * task + 0.15::DOUBLE * modality + 0.10::DOUBLE * species + 0.15::DOUBLE * region + 0.10::DOUBLE * event + 0.15::DOUBLE * affordance + 0.05::DOUBLE + CASE WHEN far THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN clash THEN 0.1::DOUBLE ELSE 0 END)), 6) AS score FROM feat)"""
#: The same with all brands as affordances.
WHOLE_PAIRS = PAIRS.replace("brands[1:3] AS aff", "brands AS aff")


def _concepts(spark, d, query):
    """Concepts of orders (brands and sizes of their parts) or of parts."""
    parts = S.table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"))
    if query:
        parts = _asked(spark, d).join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper"), "p_brand", "p_size")
    else:
        parts = parts.withColumnRenamed("p_partkey", "dataset")
    return parts.unpivot(parts.columns[:1], ["p_brand", "p_size"], "type", "concept")


CONCEPTS = """pc AS (SELECT DISTINCT paper, type, concept FROM (SELECT l_orderkey AS paper, unnest(['p_brand', 'p_size']) AS type, unnest([p_brand, CAST(p_size AS VARCHAR)]) AS concept FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 100 = 0)),
dc AS (SELECT p_partkey AS dataset, unnest(['p_brand', 'p_size']) AS type, unnest([p_brand, CAST(p_size AS VARCHAR)]) AS concept FROM part)"""


def _signal_links(spark, d):
    """An order's own parts by number, parts of a brand of its parts, and parts of their sizes."""
    parts = S.table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_size").cast("string").alias("p_size"))
    own = _asked(spark, d).join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper"), F.col("p_partkey").alias("dataset"), F.col("p_brand").alias("task"), F.col("p_size").alias("region"))
    keys = lambda t, n: t.unpivot([n], ["task", "region"], "signal", "key")
    direct = own.select("paper", "dataset", F.lit("doi").alias("signal"), F.lit(1.0).alias("strength"))
    return L.keyed_signal_links(direct, keys(own.drop("dataset"), "paper"), keys(parts.toDF("dataset", "task", "region"), "dataset"), {"task": 0.6, "region": 0.4}, 0.58)


def _reviews(spark, d):
    t = S.table(spark, d, "lineitem")
    score = F.least(F.lit(3), F.floor((F.col("l_quantity") - 1) / 12.5)).cast("int")
    return t.select(
        F.col("l_partkey").alias("candidate"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), F.when(F.col("l_tax") > 0, score).alias("score"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.07), (3 - score)).alias("final"), (F.col("l_linestatus") == "F").alias("violation"),
    )


REVIEWS = """rv AS (SELECT l_partkey AS candidate, l_orderkey * 8 + l_linenumber AS nth, CASE WHEN l_tax > 0 THEN CAST(least(3, floor((l_quantity - 1) / 12.5)) AS INTEGER) END AS score,
CASE WHEN l_returnflag = 'R' AND l_tax > 0.07 THEN 3 - CAST(least(3, floor((l_quantity - 1) / 12.5)) AS INTEGER) END AS final, l_linestatus = 'F' AS violation FROM lineitem)"""


def _votes(spark, d):
    t = S.table(spark, d, "lineitem")
    vote = F.least(F.lit(3), F.floor((F.col("l_quantity") - 1) / 12.5)).cast("int")
    return t.select(F.col("l_partkey").alias("pair"), F.when(F.col("l_linenumber") < 6, vote).alias("vote"), F.round(1 - F.col("l_discount") * 5, 4).alias("confidence"), ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.075)).alias("hard"), X.place().alias("place"))


VOTES = "v AS (SELECT l_partkey AS pair, CASE WHEN l_linenumber < 6 THEN CAST(least(3, floor((l_quantity - 1) / 12.5)) AS INTEGER) END AS vote, round(1 - l_discount * 5, 4) AS confidence, l_returnflag = 'R' AND l_tax > 0.075 AS hard FROM lineitem)"
SILVER = f"""{VOTES}, g AS (SELECT pair, max(confidence) FILTER (hard AND vote = 0) AS hc, count(vote) AS n, count(DISTINCT vote) AS kinds, sum(vote * confidence) AS weighted, sum(confidence) FILTER (vote IS NOT NULL) AS weight, coalesce(stddev_samp(vote), 0) AS spread, avg(confidence) FILTER (vote IS NOT NULL) AS mean FROM v GROUP BY pair),
silver AS (SELECT pair, CAST(CASE WHEN hc IS NOT NULL THEN 0 WHEN n = 0 THEN 1 ELSE least(3, greatest(0, round_even(CASE WHEN weight > 0 THEN weighted / weight ELSE 1 END, 0))) END AS INTEGER) AS relevance,
round(CASE WHEN hc IS NOT NULL THEN hc WHEN n = 0 THEN 0.3::DOUBLE ELSE 0.5::DOUBLE * CASE WHEN kinds = 1 THEN 1 ELSE greatest(0, 1 - spread / 3) END + 0.5::DOUBLE * mean END, 3) AS confidence, hc IS NOT NULL OR n = 0 OR kinds > 1 AS disagree, hc IS NOT NULL AS is_hard FROM g),
labels_s AS (SELECT pair, relevance, confidence, disagree, round(least(1, CASE WHEN confidence < 0.45 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN disagree THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN is_hard THEN 0.2::DOUBLE ELSE 0 END), 3) AS priority FROM silver)"""


def _linkage(spark, d):
    label = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("source"))
    ranked = S.runs(spark, d, systems=("cos",)).join(label, "query_id").select("source", "query_id", "doc_id", "rank", F.when(F.col("grade") == 3, 1).alias("hit"))
    return L.linkage_metrics(ranked, S.judgement_counts(spark, d).where("grade = 3").select("query_id", "n"), 10)


def _heavy(spark, d):
    label = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("source"))
    return L.keep_per_source(S.runs(spark, d, systems=("cos",)).join(label, "doc_id").select("query_id", "doc_id", "source", "rank"), ["L0", "L1", "L2"], 3)


def _bonus_rerank(spark, d):
    """The best ten after bonuses. They add -0.02 to 0.1, so only vectors within 0.12 of the tenth best cosine can be among them; scores that end below 0 are all equal, so while it may, every vector can."""
    pairs = S.close_pairs(spark, d, 10, 0.12 + 2e-6, 0.02 + 2e-6)
    return C.bonus_rerank(pairs.select("query_id", "doc_id", F.col("cos").alias("score"), (F.col("grade") == 3).alias("has_papers"), (F.col("doc_id") % 3 == 0).alias("has_id"), F.col("head").alias("satisfaction")), 10)


def _closure(spark, d):
    n = S.table(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("parent"))
    return G.descendants(n, 2)


def _names(spark, d):
    n = S.table(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_name").alias("name"))
    s = S.table(spark, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_name").alias("name"))
    return n.unionByName(s)


def _backlog(spark, d):
    """Per brand: how many datasets name it, how many with confidence, from how many sources, and up to five of them."""
    e = S.entries(spark, d).where("dimension = 'brand'").join(S.records(spark, d).select("dataset_id", "source"), "dataset_id")
    g = e.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.75).alias("high"), F.countDistinct("source").alias("sources"))
    nth = F.row_number().over(Window.partitionBy("value").orderBy("dataset_id"))
    first = e.select("value", "dataset_id").withColumn("nth", nth).where("nth <= 5").groupBy("value").agg(F.array_join(F.array_sort(F.collect_list("dataset_id")).cast("array<string>"), ",").alias("examples"))
    return g.join(first, "value")


NODE_NAMES = "names AS (SELECT 'n:' || n_nationkey AS node, n_name AS name FROM nation UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier)"

QUERIES = {
    "record_filters": (
        lambda s, d: S.records(s, d).where(C.passes({"brands": ["brand-11", "BRAND 12"], "source": "building", "min_balance": 0.0}, SCHEMA)).select("dataset_id", "balance"),
        f"{W} SELECT dataset_id, balance FROM records WHERE list_has_any(list_transform(brands, lambda b: {NORM.format(x='b')}), ['brand 11', 'brand 12']) AND {NORM.format(x='source')} = 'building' AND balance >= 0",
    ),
    "exclusion_violations": (
        lambda s, d: S.records(s, d).select("dataset_id", F.array_join(C.violations(EXCLUDED), ",").alias("found")).where("found <> ''"),
        f"""{W}, x AS (SELECT dataset_id, array_to_string(list_sort(list_distinct(list_concat(
            list_transform(list_intersect(list_transform(brands, lambda b: {NORM.format(x='b')}), ['brand 11', 'brand 22', 'brand 33']), lambda v: 'brands:' || v),
            list_transform(list_intersect(list_transform(types, lambda b: {NORM.format(x='b')}), ['promo']), lambda v: 'types:' || v)))), ',') AS found FROM records) SELECT * FROM x WHERE found <> ''""",
    ),
    "paper_filters": (
        lambda s, d: _papers(s, d).where(C.paper_filter(1996, 1999, 100, ["1 urgent", "2 high"])),
        f"SELECT o_orderkey AS paper, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(floor(o_totalprice / 1000) AS INTEGER) AS citations, o_orderpriority AS venue FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND floor(o_totalprice / 1000) >= 100 AND {NORM.format(x='o_orderpriority')} IN ('1 urgent', '2 high')",
    ),
    "finding_filters": (
        lambda s, d: S.findings(s, d).where(C.finding_filter(["Brand#11", "Brand#25"], None, ["increase", "none"])).select("finding_id", "direction"),
        f"WITH {S.FINDINGS} SELECT finding_id, direction FROM findings WHERE list_has_any(regions, ['Brand#11', 'Brand#25']) AND direction IN ('increase', 'none')",
    ),
    "claim_patterns": (lambda s, d: C.triple_pattern(S.edges(s, d), None, "supplied_by", "s:7", 0.95), f"{WE} SELECT * FROM edges WHERE etype = 'supplied_by' AND dst = 's:7' AND confidence >= 0.95"),
    "node_search": (
        lambda s, d: C.label_search(_names(s, d).select("node", F.col("name").alias("label"), F.substring("node", 1, 1).alias("kind")), "N_1", "n", 10),
        f"WITH {NODE_NAMES} SELECT node, name AS label, 'n' AS kind FROM names WHERE contains(lower(name), 'n_1') AND starts_with(node, 'n:') ORDER BY node LIMIT 10",
    ),
    "nodes_by_name": (lambda s, d: G.nodes_by_name(_names(s, d), ["nation 3", "Nation 4", "supplier 000000002"]), f"WITH {NODE_NAMES} SELECT DISTINCT node FROM names WHERE {NORM.format(x='name')} IN ('nation 3', 'nation 4', 'supplier 000000002')"),
    "record_gate": (
        lambda s, d: S.records(s, d).select("dataset_id", C.gate([("no_values", F.size("brands") > 0), ("wrong_kind", F.col("source") != "AUTOMOBILE"), ("closed", F.col("balance") > 0)]).alias("reason")),
        f"{W} SELECT dataset_id, CASE WHEN len(brands) = 0 THEN 'no_values' WHEN source = 'AUTOMOBILE' THEN 'wrong_kind' WHEN balance <= 0 THEN 'closed' ELSE 'ok' END AS reason FROM records",
    ),
    "first_level": (
        lambda s, d: S.records(s, d).select("dataset_id", C.first_mapped(F.col("types"), LEVELS).alias("level")),
        f"{W} SELECT dataset_id, list_filter(list_transform(types, lambda t: {_levels_sql('t')}), lambda x: x IS NOT NULL)[1] AS level FROM records",
    ),
    "completeness": (
        lambda s, d: S.records(s, d).select("dataset_id", F.round(C.completeness(SCHEMA), 6).alias("share"), F.array_join(C.missing_fields(SCHEMA), ",").alias("missing")),
        f"{W} SELECT dataset_id, round((CAST(len(brands) > 0 AS INTEGER) + CAST(len(types) > 0 AS INTEGER) + 3) / 5, 6) AS share, CASE WHEN len(brands) = 0 THEN 'brands,types' ELSE '' END AS missing FROM records",
    ),
    "record_scores": (
        _record_scores,
        f"""{W}, h AS (SELECT *, len(list_intersect(['Brand#11', 'Brand#12', 'Brand#13'], brands)) / 3 AS o, len(list_intersect(['PROMO'], types)) / 1 AS b, CASE WHEN source IN ('BUILDING', 'MACHINERY') THEN 0.5::DOUBLE ELSE 0 END AS m, least(len(brands) / 3, 1) AS p,
            CASE WHEN len(brands) = 0 THEN 2 ELSE 0 END AS missing FROM records)
        SELECT dataset_id, round(least(1, greatest(0, 0.28::DOUBLE * o + 0.20::DOUBLE * b + 0.12::DOUBLE * m + 0.04::DOUBLE * p - CASE WHEN source IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 0.18::DOUBLE END - 0.04::DOUBLE * missing - CASE WHEN list_contains(types, 'LARGE') AND balance < 0 THEN 0.5::DOUBLE ELSE 0 END)) * 100, 2) AS score FROM h""",
    ),
    "hybrid_scores": (
        lambda s, d: S.search_pairs(s, d).where("grade = 3").select("query_id", "doc_id", C.hybrid_score([F.col("head")], [F.col("cos")]).alias("weighted"), C.hybrid_score([F.col("head")], [F.col("cos")], "max").alias("larger")),
        f"WITH {S.SEARCH_PAIRS} SELECT query_id, doc_id, round(0.6::DOUBLE * least(1, head) + (1 - 0.6::DOUBLE) * least(1, cos), 4) AS weighted, round(greatest(least(1, head), least(1, cos)), 4) AS larger FROM search_pairs WHERE grade = 3",
    ),
    "bonus_rerank": (
        _bonus_rerank,
        f"""WITH {S.SEARCH_PAIRS}, x AS (SELECT query_id, doc_id, round(least(1, greatest(0, cos + CASE WHEN grade = 3 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.03::DOUBLE ELSE 0 END + 0.02::DOUBLE * head)), 6) AS score FROM search_pairs)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 10""",
    ),
    "source_grades": (
        lambda s, d: S.records(s, d).select("source", C.source_grade(F.when(F.col("source") == "BUILDING", 0.9).when(F.col("source") == "MACHINERY", 0.7), F.array_contains("types", "STANDARD"), F.size("brands") < 5, F.lit(True), F.col("balance") > 0).alias("grade")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("grade"), 4).alias("mean"), F.count_if(F.col("grade") < 0.5).alias("low")),
        f"""{W}, x AS (SELECT source, round(least(1, greatest(0, CASE source WHEN 'BUILDING' THEN 0.9::DOUBLE WHEN 'MACHINERY' THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN list_contains(types, 'STANDARD') THEN 0.05::DOUBLE ELSE 0 END - CASE WHEN len(brands) < 5 THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN balance > 0 THEN 0 ELSE 0.04::DOUBLE END)), 3) AS grade FROM records)
        SELECT source, count(*) AS n, round(avg(grade), 4) AS mean, count(*) FILTER (grade < 0.5) AS low FROM x GROUP BY source""",
    ),
    "set_scores": (
        lambda s, d: C.set_scores(_sets(s, d), ["PROMO", "STANDARD", "SMALL"], ["ECONOMY"]),
        f"""{W}, b AS (SELECT nation AS set_id, count(*) AS items, avg(least(1, len(brands) / 25)) AS mean, count(*) FILTER (len(types) = 0) / count(*) AS bare, count(*) FILTER (list_contains(types, 'ECONOMY')) / count(*) AS hard, (count(*) - count(DISTINCT types)) / count(*) AS redundancy FROM records GROUP BY 1),
        k AS (SELECT nation AS set_id, count(DISTINCT t) FILTER (t IN ('PROMO', 'STANDARD', 'SMALL')) / 3 AS coverage FROM (SELECT nation, unnest(types) AS t FROM records) GROUP BY 1),
        o AS (SELECT set_id, count(*) FILTER (k = 1) / count(*) AS complement FROM (SELECT nation AS set_id, t, count(*) AS k FROM (SELECT nation, unnest(brands) AS t FROM records) GROUP BY ALL) GROUP BY set_id),
        x AS (SELECT b.*, coalesce(coverage, 0) AS coverage, coalesce(complement, 0) AS complement FROM b LEFT JOIN k USING (set_id) LEFT JOIN o USING (set_id))
        SELECT set_id, items, round(mean, 4) AS mean, round(coverage, 4) AS coverage, round(complement, 4) AS complement, round(redundancy, 4) AS redundancy, round(bare, 4) AS bare, round(hard, 4) AS hard,
               round(least(1, greatest(0, mean + 0.1::DOUBLE * coverage + 0.1::DOUBLE * complement + 0.1::DOUBLE - 0.15::DOUBLE * redundancy - 0.05::DOUBLE * bare - 0.3::DOUBLE * hard)), 6) AS score FROM x""",
    ),
    "pair_scores": (lambda s, d: _features(s, d, 0.5), f"{W}, {PAIRS} SELECT a, b, kind, score FROM pairs WHERE score >= 0.5"),
    "best_partners": (lambda s, d: C.best_per_kind(_features(s, d, 0.3, 3, lambda: F.col("brands")), 3, 0.3), f"{W}, {WHOLE_PAIRS} SELECT a, b, kind, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY a, kind ORDER BY score DESC, b) AS rank FROM pairs WHERE score >= 0.3) WHERE rank <= 3"),
    "author_links": (
        lambda s, d: L.author_links(_asked(s, d).select(F.col("l_orderkey").alias("paper"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("author")), _lines(s, d).select(F.col("l_partkey").alias("dataset"), F.concat(F.lit(" s"), F.col("l_suppkey").cast("string")).alias("author"))),
        """WITH p AS (SELECT DISTINCT l_orderkey AS paper, l_suppkey AS author FROM lineitem WHERE l_orderkey % 100 = 0), q AS (SELECT DISTINCT l_partkey AS dataset, l_suppkey AS author FROM lineitem)
        SELECT paper, dataset, count(*) AS shared, round(least(0.85::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * count(*)), 6) AS confidence FROM p JOIN q USING (author) GROUP BY ALL HAVING count(*) >= 2""",
    ),
    "identifier_links": (
        lambda s, d: L.identifier_links(S.table(s, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("paper"), F.md5("text").alias("key")), S.table(s, d, "documents").select(F.col("doc_id").alias("dataset"), F.md5("text").alias("key"))),
        "SELECT DISTINCT a.doc_id AS paper, b.doc_id AS dataset FROM documents a JOIN documents b ON md5(a.text) = md5(b.text) WHERE a.doc_id % 100 = 0",
    ),
    "concept_links": (
        lambda s, d: L.concept_links(_concepts(s, d, True), _concepts(s, d, False), {"p_brand": 0.6, "p_size": 0.4}, 5, least=0.1),
        f"""WITH {CONCEPTS}, np AS (SELECT paper, type, count(*) AS np FROM pc GROUP BY ALL), m AS (SELECT paper, dataset, type, count(*) AS shared_n FROM pc JOIN dc USING (type, concept) GROUP BY ALL),
        t AS (SELECT paper, dataset, type, CASE type WHEN 'p_brand' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w, coalesce(shared_n, 0) AS k, np + 1 - coalesce(shared_n, 0) AS u FROM (SELECT DISTINCT paper, dataset FROM m) CROSS JOIN (SELECT unnest(['p_brand', 'p_size']) AS type) JOIN np USING (paper, type) LEFT JOIN m USING (paper, dataset, type)),
        g AS (SELECT paper, dataset, CAST(sum(k) AS BIGINT) AS shared, round(sum(w * k / u) / sum(w), 6) AS similarity FROM t GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY similarity DESC, dataset) AS rank FROM g WHERE similarity >= 0.1 AND shared >= 2)
        SELECT *, round(least(1, similarity + 0.2::DOUBLE), 6) AS confidence FROM r WHERE rank <= 5""",
    ),
    "signal_links": (
        _signal_links,
        """WITH o AS (SELECT DISTINCT l_orderkey AS paper, p_partkey, p_brand, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 100 = 0),
        s AS (SELECT DISTINCT paper, p_partkey AS dataset, 0.28::DOUBLE AS w, 1.0::DOUBLE AS x, true AS e FROM o UNION ALL SELECT DISTINCT paper, p.p_partkey, 0.12::DOUBLE, 0.6::DOUBLE, false FROM o JOIN part p USING (p_brand) UNION ALL SELECT DISTINCT paper, p.p_partkey, 0.06::DOUBLE, 0.4::DOUBLE, false FROM o JOIN part p USING (p_size)),
        g AS (SELECT paper, dataset, sum(w * x) / sum(w) AS score, bool_or(e) AS e FROM s GROUP BY ALL)
        SELECT paper, dataset, round(score, 6) AS score, CASE WHEN e OR score >= 0.8 THEN 'explicit' WHEN score >= 0.5 THEN 'inferred' WHEN score >= 0.3 THEN 'weak' ELSE 'speculative' END AS kind FROM g WHERE score >= 0.58""",
    ),
    "citation_edges": (
        lambda s, d: L.citation_edges(_lines(s, d).select(F.col("l_partkey").alias("citing"), F.col("l_suppkey").alias("cited")), S.table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"))),
        "WITH k AS (SELECT p_partkey AS id FROM part WHERE p_size > 10) SELECT DISTINCT l_partkey AS citing, l_suppkey AS cited FROM lineitem WHERE l_partkey <> l_suppkey AND l_partkey IN (SELECT id FROM k) AND l_suppkey IN (SELECT id FROM k)",
    ),
    "intellectual_ancestors": (
        lambda s, d: L.ancestors(_lines(s, d).select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited")), S.table(s, d, "orders").select(F.col("o_orderpriority").alias("topic"), F.col("o_orderkey").alias("paper"))),
        "WITH n AS (SELECT o_orderpriority AS topic, l_partkey AS cited, count(DISTINCT l_orderkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, cited) AS rank FROM n) WHERE n >= 3 AND rank <= 10",
    ),
    "adjudicated_reviews": (
        lambda s, d: L.adjudicated(_reviews(s, d)),
        f"""WITH {REVIEWS}, g AS (SELECT candidate, count(*) AS n, min_by(score, nth) AS first_score, max_by(final, nth) FILTER (final IS NOT NULL) AS final, count(DISTINCT (score, violation)) AS kinds FROM rv WHERE score IS NOT NULL GROUP BY 1)
        SELECT candidate, coalesce(final, first_score) AS score, CASE WHEN final IS NOT NULL THEN 'adjudicated' WHEN n = 1 THEN 'single_review' WHEN kinds = 1 THEN 'agreement' ELSE 'needs_adjudication' END AS status, kinds > 1 AS disagreement FROM g""",
    ),
    "session_heavy_cap": (_heavy, f"WITH {S.RUNS}, x AS (SELECT query_id, doc_id, 'L' || e.label AS source, rank FROM runs JOIN embeddings e ON vec_id = doc_id WHERE system = 'cos') SELECT query_id, doc_id, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth FROM x) WHERE source NOT IN ('L0', 'L1', 'L2') OR nth <= 3"),
    "silver_labels": (lambda s, d: L.silver_labels(_votes(s, d)), f"WITH {SILVER} SELECT * FROM labels_s"),
    "review_set": (
        lambda s, d: L.silver_labels(_votes(s, d)).orderBy(F.col("priority").desc(), F.md5(F.col("pair").cast("string"))).limit(50).select("pair", "priority"),
        f"WITH {SILVER} SELECT pair, priority FROM labels_s ORDER BY priority DESC, md5(CAST(pair AS VARCHAR)) LIMIT 50",
    ),
    "audit_priority": (
        lambda s, d: _votes(s, d).where("vote IS NOT NULL").groupBy("pair").agg(F.coalesce(F.var_samp("vote"), F.lit(0.0)).alias("v"), F.max("hard").alias("hard"), F.count(F.lit(1)).alias("n")).select("pair", L.audit_priority(F.col("v"), F.col("hard"), F.col("n")).alias("priority")),
        f"WITH {VOTES} SELECT pair, round(coalesce(var_samp(vote), 0) * CASE WHEN bool_or(hard) THEN 2 ELSE 1 END / (ln(count(*) + 1) + 1), 6) AS priority FROM v WHERE vote IS NOT NULL GROUP BY pair",
    ),
    "linkage_metrics": (
        _linkage,
        f"""WITH {S.RUNS}, rel AS (SELECT query_id, doc_id FROM search_pairs WHERE grade = 3), n AS (SELECT query_id, count(*) AS relevant FROM rel GROUP BY 1),
        h AS (SELECT r.query_id, 'L' || e.label AS source, r.rank, rel.doc_id IS NOT NULL AS hit FROM runs r JOIN embeddings e ON e.vec_id = r.query_id LEFT JOIN rel ON rel.query_id = r.query_id AND rel.doc_id = r.doc_id WHERE system = 'cos' AND rank <= 10),
        g AS (SELECT source, query_id, count(*) FILTER (hit AND rank <= 5) AS h5, count(*) FILTER (hit) AS h10, min(rank) FILTER (hit) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) AS dcg FROM h GROUP BY ALL),
        i AS (SELECT query_id, relevant, list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda k: 1 / log2(k + 1))) AS ideal FROM n)
        SELECT source, count(*) AS queries, round(avg(h5 / 5), 6) AS p5, round(avg(h10 / 10), 6) AS p10, round(avg(h10 / relevant), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg FROM g JOIN i USING (query_id) GROUP BY source""",
    ),
    "transitive_targets": (
        lambda s, d: G.transitive(S.edges(s, d), _customers(s, d), "s:"),
        f"""WITH RECURSIVE {S.EDGES}, {STARTS}, walk(start, node, hops) AS (SELECT node, node, 0 FROM starts UNION SELECT start, dst, hops + 1 FROM walk JOIN edges ON src = node WHERE hops < 3 AND NOT starts_with(node, 's:'))
        SELECT start, node, min(hops) AS hops, CASE min(hops) WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM walk WHERE starts_with(node, 's:') GROUP BY ALL""",
    ),
    "transitive_boost": (
        lambda s, d: G.transitive_boost(G.transitive(S.edges(s, d), _customers(s, d), "r:")),
        f"""WITH RECURSIVE {S.EDGES}, {STARTS}, walk(start, node, hops) AS (SELECT node, node, 0 FROM starts UNION SELECT start, dst, hops + 1 FROM walk JOIN edges ON src = node WHERE hops < 3 AND NOT starts_with(node, 'r:'))
        SELECT start, round(least(0.15::DOUBLE, count(DISTINCT node) * 0.05::DOUBLE), 6) AS boost FROM walk WHERE starts_with(node, 'r:') GROUP BY start""",
    ),
    "hierarchy_scores": (
        lambda s, d: G.hierarchy_score(S.records(s, d).select(F.col("dataset_id").alias("id"), F.concat(F.lit("n:"), F.col("nation").cast("string")).alias("region")), ["r:1", "n:3"], _closure(s, d)),
        f"{W} SELECT dataset_id AS id, CASE WHEN nation = 3 THEN 1.0::DOUBLE WHEN n_regionkey = 1 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS score FROM records JOIN nation ON nation = n_nationkey",
    ),
    "explained_connections": (
        lambda s, d: G.shortest_paths(G.simple_paths(S.edges(s, d), _customers(s, d), S.table(s, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node")), 2)),
        f"""WITH {S.EDGES}, {STARTS}, {UND}, p AS (SELECT x.node AS a, u.dst AS m, v.dst AS b FROM starts x JOIN und u ON u.src = x.node JOIN und v ON v.src = u.dst WHERE starts_with(v.dst, 's:') AND NOT starts_with(u.dst, 's:'))
        SELECT a AS start, b AS "end", min(a || '>' || m || '>' || b) AS path, 2 AS hops FROM p GROUP BY a, b""",
    ),
    "induced_subgraph": (
        lambda s, d: G.induced(S.edges(s, d), _nodes(s, d).where("node LIKE 'r:%'")),
        f"{WE} SELECT src, dst, etype, confidence FROM edges WHERE etype = 'part_of'",
    ),
    "strongest_suppliers": (
        lambda s, d: G.strongest_out(S.edges(s, d).where("etype = 'supplied_by'"), 6),
        f"{WE} SELECT src, dst, confidence AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS rank FROM edges WHERE etype = 'supplied_by') WHERE rank <= 6",
    ),
    "acquisition_backlog": (
        _backlog,
        f"""WITH {S.ENTRIES}, {S.RECORDS}, e AS (SELECT entries.*, source FROM entries JOIN records USING (dataset_id) WHERE dimension = 'brand'), f AS (SELECT value, dataset_id, row_number() OVER (PARTITION BY value ORDER BY dataset_id) AS nth FROM e)
        SELECT value, count(*) AS n, count(*) FILTER (confidence >= 0.75) AS high, count(DISTINCT source) AS sources, (SELECT string_agg(CAST(dataset_id AS VARCHAR), ',' ORDER BY dataset_id) FROM f WHERE f.value = e.value AND nth <= 5) AS examples FROM e GROUP BY value""",
    ),
    "corpus_report": (
        lambda s, d: S.records(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("brands") > 0).alias("with_brands"), F.round(F.avg(F.size("brands")), 4).alias("mean_brands"), F.round(F.avg(C.completeness(SCHEMA)), 6).alias("completeness")),
        f"{W} SELECT source, count(*) AS n, count(*) FILTER (len(brands) > 0) AS with_brands, round(avg(len(brands)), 4) AS mean_brands, round(avg((CAST(len(brands) > 0 AS INTEGER) + CAST(len(types) > 0 AS INTEGER) + 3) / 5), 6) AS completeness FROM records GROUP BY source",
    ),
    "negated_texts": (
        lambda s, d: S.table(s, d, "documents").select("doc_id", T.negated(F.col("text")).alias("negated")),
        "SELECT doc_id, coalesce(regexp_matches(lower(text), '" + "|".join(T.NEGATIONS) + "'), false) AS negated FROM documents",
    ),
}
