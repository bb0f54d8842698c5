"""Graph queries over the foreign-key graph of customers, parts, suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lodespark.operators import graph as G
from lodespark.operators.components import connected_components
from lodespark.sources import tables as S

W = f"WITH {S.EDGES}"
WR = f"WITH RECURSIVE {S.EDGES}"
UND = "und AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst)"


def _customers(spark, d):
    """Start nodes: every customer whose key 100 divides, as queries against the whole graph."""
    return S.table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node"))


STARTS = "starts AS (SELECT 'c:' || c_custkey AS node FROM customer WHERE c_custkey % 100 = 0)"


def _nodes(spark, d):
    t = lambda n, k, c: S.table(spark, d, n).select(F.concat(F.lit(k), F.col(c).cast("string")).alias("node"))
    return t("customer", "c:", "c_custkey").union(t("supplier", "s:", "s_suppkey")).union(t("part", "p:", "p_partkey")).union(t("nation", "n:", "n_nationkey")).union(t("region", "r:", "r_regionkey"))


NODES = "nodes AS (SELECT 'c:' || c_custkey AS node FROM customer UNION ALL SELECT 's:' || s_suppkey FROM supplier UNION ALL SELECT 'p:' || p_partkey FROM part UNION ALL SELECT 'n:' || n_nationkey FROM nation UNION ALL SELECT 'r:' || r_regionkey FROM region)"


def _components(spark, d):
    """Entities that share an identifier: documents with one text, as (document, text digest) edges."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("src"), F.concat(F.lit("t"), F.md5("text")).alias("dst"))
    c = connected_components(docs)
    return c.where("node NOT LIKE 't%'").select(F.col("node").cast("bigint").alias("doc_id"), F.count(F.lit(1)).over(Window.partitionBy("component")).alias("size"))


def _hierarchy(spark, d):
    n = S.table(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("parent"))
    c = S.table(spark, d, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("child"), F.concat(F.lit("n:"), F.col("c_nationkey").cast("string")).alias("parent"))
    return G.descendants(n.union(c), 4)


def _layers(spark, d):
    e = S.edges(spark, d)
    first = e.where("etype = 'supplied_by' AND confidence >= 0.97").select("src", "dst", "confidence")
    return G.merge_layers([first, e.where("etype = 'supplied_by'").select("src", "dst", F.lit(0.5).alias("confidence"))], ["src", "dst"])


QUERIES = {
    "neighbors": (lambda s, d: G.neighbors(S.edges(s, d), _customers(s, d), ["uses", "located_in"]), f"{W}, {STARTS} SELECT DISTINCT src AS node, dst AS neighbor, etype FROM edges JOIN starts ON src = node WHERE etype IN ('uses', 'located_in') UNION SELECT dst, src, etype FROM edges JOIN starts ON dst = node WHERE etype IN ('uses', 'located_in')"),
    "shared_concept_rank": (
        lambda s, d: G.related(S.edges(s, d), {"uses": 3.0, "located_in": 1.0}, _customers(s, d), 10, hubs=("located_in",)),
        f"{W}, {STARTS}, p AS (SELECT a.src AS node, b.src AS other, round(sum(CASE a.etype WHEN 'uses' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM edges a JOIN edges b ON a.dst = b.dst AND a.etype = b.etype AND a.src <> b.src WHERE a.src IN (SELECT node FROM starts) AND a.etype IN ('uses', 'located_in') GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS rank FROM p) WHERE rank <= 10",
    ),
    "bfs_depth": (
        lambda s, d: G.bfs(S.edges(s, d), _customers(s, d), 3),
        f"""{WR}, {STARTS}, walk(start, node, hops) AS (SELECT node, node, 0 FROM starts UNION SELECT start, dst, hops + 1 FROM walk JOIN edges ON src = node WHERE hops < 3) SELECT start, node, min(hops) AS hops FROM walk GROUP BY ALL""",
    ),
    "simple_paths_depth3": (
        lambda s, d: G.simple_paths(S.edges(s, d), _customers(s, d), S.table(s, d, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("node")), 3),
        f"""{WR}, {STARTS}, {UND},
        walk(path, last, hops) AS (SELECT [node], node, 0 FROM starts UNION ALL SELECT list_append(path, dst), dst, hops + 1 FROM walk JOIN und ON src = last WHERE hops < 3 AND NOT list_contains(path, dst) AND NOT starts_with(last, 's:') AND (hops < 2 OR starts_with(dst, 's:')))
        SELECT array_to_string(path, '>') AS path, hops FROM walk WHERE starts_with(last, 's:')""",
    ),
    "metapath_scores": (
        lambda s, d: G.metapath(S.edges(s, d), [("uses", True), ("supplied_by", True), ("located_in", True)], least=0.1, weight=0.8, backward=True),
        f"""{W}, a AS (SELECT src AS start, dst AS node, confidence AS c FROM edges WHERE etype = 'uses'),
        b AS (SELECT start, e.dst AS node, count(*) AS n, max(c * confidence) AS c FROM a JOIN edges e ON e.src = node WHERE etype = 'supplied_by' GROUP BY ALL),
        x AS (SELECT start, e.dst AS node, sum(n) AS n, max(c * confidence) AS c FROM b JOIN edges e ON e.src = node WHERE etype = 'located_in' GROUP BY ALL)
        SELECT start, node AS target, CAST(n AS BIGINT) AS n_paths, round(c * 0.8::DOUBLE, 6) AS best FROM x WHERE c >= 0.1""",
    ),
    "pathsim": (
        lambda s, d: G.pathsim(S.edges(s, d), [("located_in", False), ("uses", True)]),
        f"""{W}, h AS (SELECT l.dst AS start, u.dst AS target, count(*) AS n FROM edges l JOIN edges u ON l.src = u.src WHERE l.etype = 'located_in' AND u.etype = 'uses' GROUP BY ALL), o AS (SELECT start, sum(n * n) AS s FROM h GROUP BY start),
        p AS (SELECT x.start AS a, y.start AS b, sum(x.n * y.n) AS n FROM h x JOIN h y ON x.target = y.target AND x.start < y.start GROUP BY ALL)
        SELECT a, b, round(2 * n / (q.s + r.s), 6) AS pathsim FROM p JOIN o q ON q.start = a JOIN o r ON r.start = b""",
    ),
    "shared_neighborhood": (
        lambda s, d: G.shared_neighborhood(S.edges(s, d), _customers(s, d), "uses"),
        f"""{W}, {STARTS}, u AS (SELECT DISTINCT src, dst FROM edges WHERE etype = 'uses'), n AS (SELECT src, count(*) AS n FROM u GROUP BY src)
        SELECT a.src AS a, b.src AS b, round(2 * count(*) / (any_value(x.n) + any_value(y.n)), 6) AS score FROM u a JOIN u b ON a.dst = b.dst AND a.src <> b.src JOIN n x ON x.src = a.src JOIN n y ON y.src = b.src WHERE a.src IN (SELECT node FROM starts) GROUP BY ALL""",
    ),
    "relational_division": (
        lambda s, d: G.division(S.edges(s, d).where("etype = 'uses'").join(S.table(s, d, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("dst"), "p_brand"), "dst").select("src", F.col("p_brand").alias("dst"), "etype", "confidence"), "uses", s.createDataFrame([("Brand#11",), ("Brand#12",)], "dst string"), s.createDataFrame([("Brand#13",)], "dst string")),
        f"""{W}, u AS (SELECT DISTINCT src, p_brand AS dst FROM edges JOIN part ON dst = 'p:' || p_partkey WHERE etype = 'uses') SELECT src AS node FROM u GROUP BY src HAVING count(*) FILTER (dst IN ('Brand#11', 'Brand#12')) = 2 AND count(*) FILTER (dst = 'Brand#13') = 0""",
    ),
    "authority": (lambda s, d: G.authority(S.edges(s, d), "uses", 50), f"{W} SELECT dst AS node, round(least(count(*), 50) / 50, 6) AS score FROM edges WHERE etype = 'uses' GROUP BY dst"),
    "graph_quality": (
        lambda s, d: G.quality_report(S.edges(s, d), _nodes(s, d), 0.92),
        f"""{W}, {NODES}, ends AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT 'dangling' AS issue, count(*) AS n FROM ends WHERE node NOT IN (SELECT node FROM nodes) UNION ALL SELECT 'weak_confidence', count(*) FROM edges WHERE confidence < 0.92
        UNION ALL SELECT 'self_loop', count(*) FROM edges WHERE src = dst UNION ALL SELECT 'orphan', count(*) FROM nodes WHERE node NOT IN (SELECT node FROM ends)""",
    ),
    "provenance_entropy": (
        lambda s, d: G.provenance(S.edges(s, d)),
        f"{W}, g AS (SELECT etype, count(*) AS n, avg(confidence) AS confidence FROM edges GROUP BY etype), h AS (SELECT *, n / sum(n) OVER () AS share FROM g) SELECT etype, n, round(share, 6) AS share, round(confidence, 6) AS confidence, round(-sum(share * ln(share)) OVER () / ln(count(*) OVER ()), 6) AS balance FROM h",
    ),
    "layered_merge": (_layers, f"{W}, r AS (SELECT src, dst, confidence, 0 AS layer FROM edges WHERE etype = 'supplied_by' AND confidence >= 0.97 UNION ALL SELECT src, dst, 0.5, 1 FROM edges WHERE etype = 'supplied_by') SELECT src, dst, confidence, layer FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY layer) AS k FROM r) WHERE k = 1"),
    "siblings": (lambda s, d: G.siblings(S.edges(s, d).where("src LIKE 'n:%' OR src LIKE 's:%'"), "part_of"), f"{W} SELECT a.src AS a, b.src AS b, a.dst AS parent FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src WHERE a.etype = 'part_of' AND b.etype = 'part_of'"),
    "degree_stats": (lambda s, d: G.degree_stats(S.edges(s, d)), f"{W}, o AS (SELECT etype, count(*) AS sources, max(n) AS max_out, CAST(sum(n) AS BIGINT) AS n_edges FROM (SELECT etype, src, count(*) AS n FROM edges GROUP BY ALL) GROUP BY etype), i AS (SELECT etype, count(*) AS targets, max(n) AS max_in FROM (SELECT etype, dst, count(*) AS n FROM edges GROUP BY ALL) GROUP BY etype) SELECT * FROM o JOIN i USING (etype)"),
    "hierarchy_closure": (
        _hierarchy,
        """WITH RECURSIVE h AS (SELECT 'n:' || n_nationkey AS child, 'r:' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer),
        w(ancestor, node, hops) AS (SELECT parent, child, 1 FROM h UNION SELECT ancestor, child, hops + 1 FROM w JOIN h ON parent = node WHERE hops < 4) SELECT ancestor, node, min(hops) AS hops FROM w GROUP BY ALL""",
    ),
    "connected_components": (_components, "SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS size FROM documents"),
}
