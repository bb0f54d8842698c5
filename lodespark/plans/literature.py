"""Literature queries: orders as findings, customers as papers, documents as titled records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.functions import text as T
from lodespark.operators import graph as G
from lodespark.operators import literature as L
from lodespark.sources import tables as S

W = f"WITH {S.FINDINGS}"


def _titles(spark, d):
    """First lines of pages' visible text stand for titles: the host and path words of a page's address."""
    p = S.table(spark, d, "pages").select(F.col("page_id").alias("id"), T.normalize(F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "")).alias("title"))
    return p.withColumn("tokens", T.title_tokens(F.col("title")))


def _reanalysis(spark, d):
    """Nations as datasets, part types as methods: what sells well in one nation of a region is proposed to the others."""
    lines = S.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
    o = S.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = S.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    p = S.table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("method"))
    j = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    done = j.groupBy(F.col("c_nationkey").alias("dataset"), "method").agg(F.max(1 - F.col("l_discount")).alias("confidence"))
    n = S.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    similar = n.alias("x").join(n.alias("y"), F.col("x.n_regionkey") == F.col("y.n_regionkey")).where("x.n_nationkey <> y.n_nationkey").select(F.col("x.n_nationkey").alias("dataset"), F.col("y.n_nationkey").alias("other"), F.lit(0.8).alias("similarity"))
    return L.reanalysis_candidates(done, similar, done.select("dataset", "method"))


def _contracted(spark, d):
    """Customers and suppliers as nodes of their nations, order lines as edges, a returned one against the others."""
    lines, o = S.table(spark, d, "lineitem"), S.table(spark, d, "orders")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(node("c", "o_custkey").alias("a"), node("s", "l_suppkey").alias("b"), F.when(F.col("l_returnflag") == "R", "contradicts").otherwise("supports").alias("relation"))
    customers = S.table(spark, d, "customer").select(node("c", "c_custkey").alias("node"), F.col("c_nationkey").alias("cluster"))
    return G.contracted(edges, customers.union(S.table(spark, d, "supplier").select(node("s", "s_suppkey"), "s_nationkey")))


def _strongest(spark, d):
    """Strongest line between customer and supplier nations, whichever side is smaller."""
    lines = S.table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_discount")
    o = S.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = S.table(spark, d, "customer").select("c_custkey", "c_nationkey"), S.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return L.strongest_per_pair(j.select(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_orderkey").alias("finding")))


NORM = "trim(regexp_replace(regexp_replace(lower({x}), '[/_-]+', ' ', 'g'), '[^a-z0-9+]+', ' ', 'g'))"
STOP = "(" + ", ".join(f"'{w}'" for w in T.TITLE_STOP_WORDS) + ")"
TITLES = f"""t AS (SELECT page_id AS id, {NORM.format(x="regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g')")} AS title FROM pages),
tt AS (SELECT id, title, unnest(list_distinct(list_filter(string_split(title, ' '), lambda w: length(w) >= 4 AND w NOT IN {STOP}))) AS token FROM t)"""

#: Directions that contradict each other, as the operator has them.
OPPOSITE_SQL = "(" + " OR ".join(f"(da = '{x}' AND db = '{y}')" for p in L.OPPOSITE for x, y in (tuple(p), tuple(p)[::-1])) + ")"

QUERIES = {
    "consensus_strength": (
        lambda s, d: L.consensus(S.findings(s, d), 3),
        f"{W}, r AS (SELECT finding_id, paper_id, task, direction, unnest(regions) AS region FROM findings), g AS (SELECT region, task, direction, count(DISTINCT paper_id) AS papers, count(*) AS findings FROM r GROUP BY ALL) SELECT * FROM (SELECT *, round(findings / sum(findings) OVER (PARTITION BY region, task), 6) AS strength FROM g) WHERE papers >= 3 AND direction <> 'other'",
    ),
    "qualified_consensus": (
        lambda s, d: L.qualified_consensus(S.findings(s, d), {"task": F.col("task"), "year": F.col("year"), "negated": F.col("negated")}, 2),
        f"""{W}, r AS (SELECT paper_id, direction, regions[1] AS region, task, CAST(year AS VARCHAR) AS year, CAST(negated AS VARCHAR) AS negated FROM findings),
        u AS (SELECT region, direction, 'task' AS qualifier, task AS value, paper_id FROM r UNION ALL SELECT region, direction, 'year', year, paper_id FROM r UNION ALL SELECT region, direction, 'negated', negated, paper_id FROM r)
        SELECT region, direction, qualifier, value, count(DISTINCT paper_id) AS papers FROM u GROUP BY ALL HAVING count(DISTINCT paper_id) >= 2""",
    ),
    "cooccurrence_pairs": (lambda s, d: L.cooccurrence(S.findings(s, d), 2), f"{W}, x AS (SELECT finding_id, unnest(regions) AS r FROM findings) SELECT a.r AS a, b.r AS b, count(*) AS n, round(least(0.95::DOUBLE, 0.5::DOUBLE + 0.02::DOUBLE * count(*)), 6) AS confidence FROM x a JOIN x b USING (finding_id) WHERE a.r < b.r GROUP BY a.r, b.r HAVING count(*) >= 2"),
    "cross_finding_edges": (
        lambda s, d: L.cross_finding_edges(S.findings(s, d), S.findings(s, d).where("finding_id % 100 = 0")),
        f"""{W}, x AS (SELECT * EXCLUDE regions, unnest(regions) AS region FROM findings),
        p AS (SELECT a.finding_id AS a, b.finding_id AS b, count(*) AS n_regions, any_value(a.direction) AS da, any_value(b.direction) AS db, any_value(a.negated OR b.negated) AS neg FROM x a JOIN x b USING (region, task) WHERE a.finding_id % 100 = 0 AND a.finding_id <> b.finding_id AND a.paper_id <> b.paper_id GROUP BY ALL),
        r AS (SELECT a, b, n_regions, CASE WHEN da = db AND NOT neg THEN 'supports' WHEN {OPPOSITE_SQL} AND NOT neg THEN 'contradicts' WHEN {OPPOSITE_SQL} THEN 'direct_refutation' END AS relation FROM p)
        SELECT a, b, relation, n_regions, round(least(CASE relation WHEN 'supports' THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END, 0.6::DOUBLE + 0.1::DOUBLE * n_regions), 6) AS confidence FROM r WHERE relation IS NOT NULL""",
    ),
    "relation_counts": (
        lambda s, d: L.relation_counts(S.findings(s, d)),
        f"""{W}, x AS (SELECT * EXCLUDE regions, unnest(regions) AS region FROM findings), k AS (SELECT region, task, paper_id, direction AS dir, negated, count(*) AS n FROM x GROUP BY ALL),
        w AS (SELECT region, task, dir, negated, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL),
        p AS (SELECT a.region, a.task, a.dir AS da, b.dir AS db, a.negated OR b.negated AS neg, CASE WHEN a.dir = b.dir AND a.negated = b.negated THEN a.n * (a.n - 1) ELSE a.n * b.n END AS n FROM w a JOIN w b USING (region, task)
              UNION ALL SELECT a.region, a.task, a.dir, b.dir, a.negated OR b.negated, -CASE WHEN a.dir = b.dir AND a.negated = b.negated THEN a.n * (a.n - 1) ELSE a.n * b.n END FROM k a JOIN k b USING (region, task, paper_id)),
        r AS (SELECT region, task, CASE WHEN da = db AND NOT neg THEN 'supports' WHEN {OPPOSITE_SQL} AND NOT neg THEN 'contradicts' WHEN {OPPOSITE_SQL} THEN 'direct_refutation' END AS relation, n FROM p)
        SELECT region, task, relation, CAST(sum(n) // 2 AS BIGINT) AS pairs FROM r WHERE relation IS NOT NULL GROUP BY ALL HAVING sum(n) > 0""",
    ),
    "timeline_first_seen": (
        lambda s, d: L.timeline(S.findings(s, d)),
        f"""{W}, b AS (SELECT year, count(*) AS findings, count(DISTINCT paper_id) AS papers FROM findings GROUP BY year), t AS (SELECT year, count(*) AS n FROM (SELECT task, min(year) AS year FROM findings GROUP BY task) GROUP BY year),
        r AS (SELECT year, count(*) AS n FROM (SELECT region, min(year) AS year FROM (SELECT year, unnest(regions) AS region FROM findings) GROUP BY region) GROUP BY year)
        SELECT b.*, coalesce(t.n, 0) AS new_tasks, coalesce(r.n, 0) AS new_regions FROM b LEFT JOIN t USING (year) LEFT JOIN r USING (year)""",
    ),
    "finding_clusters": (lambda s, d: L.clusters(S.findings(s, d), 2), f"{W} SELECT substr(sha1(array_to_string(regions, ',') || '|' || direction || '|' || task), 1, 16) AS cluster_id, direction, task, count(*) AS n, count(DISTINCT paper_id) AS papers, min(year) AS first_year, max(year) AS last_year FROM findings GROUP BY regions, direction, task HAVING count(*) >= 2"),
    "topic_coverage": (
        lambda s, d: L.topic_coverage(S.findings(s, d), 25),
        f"{W}, g AS (SELECT task, count(DISTINCT region) AS regions, count(DISTINCT finding_id) AS findings, min(year) AS first_year, max(year) AS last_year FROM (SELECT *, unnest(regions) AS region FROM findings) GROUP BY task) SELECT *, round(0.35::DOUBLE * regions / 25 + 0.45::DOUBLE * least(1, (last_year - first_year) / 20) + 0.2::DOUBLE * least(1, findings / 50), 3) AS score FROM g",
    ),
    "direction_gaps": (lambda s, d: L.observed_complement(S.findings(s, d), 1000), f"{W}, f AS (SELECT unnest(regions) AS region, direction FROM findings), n AS (SELECT region, direction, count(*) AS n FROM f GROUP BY ALL) SELECT r.region, q.direction, coalesce(n, 0) AS n FROM (SELECT DISTINCT region FROM f) r CROSS JOIN (SELECT DISTINCT direction FROM f) q LEFT JOIN n ON n.region = r.region AND n.direction = q.direction WHERE coalesce(n, 0) < 1000"),
    "exact_text_duplicates": (
        lambda s, d: L.duplicates_by_key(S.table(s, d, "documents").select("doc_id", "text"), F.md5(T.normalize(F.col("text"))), [F.col("doc_id")]).select("doc_id", "duplicate"),
        f"SELECT doc_id, row_number() OVER (PARTITION BY md5({NORM.format(x='text')}) ORDER BY doc_id) > 1 AS duplicate FROM documents",
    ),
    "url_duplicates": (
        lambda s, d: L.duplicates_by_key(S.table(s, d, "pages").select("page_id", "url"), F.concat(T.url_host(F.col("url")), F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)), [F.col("page_id")]).select("page_id", T.url_host(F.col("url")).alias("host"), "duplicate"),
        r"WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages) SELECT page_id, host, row_number() OVER (PARTITION BY host || path ORDER BY page_id) > 1 AS duplicate FROM p",
    ),
    "reanalysis_candidates": (
        _reanalysis,
        """WITH j AS (SELECT c_nationkey AS dataset, p_brand || '/' || p_size AS method, max(1 - l_discount) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
        s AS (SELECT x.n_nationkey AS dataset, y.n_nationkey AS other FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey)
        SELECT other AS dataset, method, round(max(confidence * 0.8::DOUBLE), 6) AS confidence FROM j JOIN s USING (dataset) WHERE NOT EXISTS (SELECT 1 FROM j k WHERE k.dataset = other AND k.method = j.method) GROUP BY ALL""",
    ),
    "contracted_edges": (
        _contracted,
        """WITH k AS (SELECT c_nationkey AS source, s_nationkey AS target, CASE WHEN l_returnflag = 'R' THEN 'contradicts' ELSE 'supports' END AS relation, count(*) AS n
                    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY n DESC, source, target, relation) AS k FROM k)
        SELECT source, target, relation, n, least(5, 1 + n // 3) AS weight FROM r WHERE k = 1""",
    ),
    "strongest_pair_edges": (
        _strongest,
        """WITH j AS (SELECT c_nationkey AS a, s_nationkey AS b, 1 - l_discount AS confidence, l_orderkey AS finding FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
        SELECT x, y, confidence, finding FROM (SELECT least(a, b) AS x, greatest(a, b) AS y, confidence, finding, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY confidence DESC, finding) AS k FROM j) WHERE k = 1""",
    ),
    "title_matches": (
        lambda s, d: L.token_blocked_matches(_titles(s, d), _titles(s, d), 50, 0.8),
        f"""WITH {TITLES}, p AS (SELECT DISTINCT a.id, a.title, b.id AS other, b.title AS other_title FROM tt a JOIN tt b USING (token) WHERE a.id <> b.id),
        s AS (SELECT id, other, round(1 - levenshtein(title, other_title) / greatest(length(title), length(other_title)), 6) AS similarity FROM p) SELECT * FROM s WHERE similarity >= 0.8""",
    ),
}
