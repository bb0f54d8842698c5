"""Coverage queries over the stand-in entries: customers as datasets, what they bought as covered values."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.operators import coverage as C
from lodespark.sources import tables as S

DIMS = ["brand", "type", "segment", "nation"]


def _datasets(spark, d):
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("title"))


def _brands(spark, d):
    """Vocabulary with gaps: every brand, and brands of a sixth maker that nobody sells."""
    own = S.table(spark, d, "part").select(F.col("p_brand").alias("value")).distinct()
    return own.union(own.select(F.regexp_replace("value", "Brand#1", "Brand#6")).distinct()).distinct()


BRANDS = "brands AS (SELECT p_brand AS value FROM part UNION SELECT replace(p_brand, 'Brand#1', 'Brand#6') FROM part)"
GOOD = "good AS (SELECT DISTINCT dataset_id, dimension, value FROM entries WHERE confidence >= 0.65)"
DATASETS = "datasets AS (SELECT c_custkey AS dataset_id, c_mktsegment AS source, c_name AS title FROM customer)"
W = f"WITH {S.ENTRIES}, {GOOD}, {DATASETS}, {BRANDS}"


def _count(dim):
    return f"SELECT value, count(DISTINCT dataset_id) AS n FROM good WHERE dimension = '{dim}' GROUP BY value"


PAIRS = "SELECT r.value AS row_value, c.value AS col_value, count(*) AS n FROM good r JOIN good c USING (dataset_id) WHERE r.dimension = 'segment' AND c.dimension = 'brand' GROUP BY ALL"
PRICED = "g AS (SELECT p_partkey AS dataset_id, 'p_brand' AS dimension, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'price', CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) FROM part)"
MARGINS = "a AS (SELECT value AS value_a, count(*) AS n_a FROM g WHERE dimension = 'p_brand' GROUP BY 1), b AS (SELECT value AS value_b, count(*) AS n_b FROM g WHERE dimension = 'price' GROUP BY 1), n AS (SELECT x.value AS value_a, y.value AS value_b, count(*) AS n FROM g x JOIN g y USING (dataset_id) WHERE x.dimension = 'p_brand' AND y.dimension = 'price' GROUP BY ALL)"


def _priced(spark, d):
    """Entries from single parts: a part is a dataset, its brand and its price in whole units are values."""
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("dataset_id"), "p_brand", F.floor("p_retailprice").cast("string").alias("price"))
    return p.unpivot("dataset_id", ["p_brand", "price"], "dimension", "value").withColumn("confidence", F.lit(0.9))


QUERIES = {
    "value_counts": (lambda s, d: C.counted(S.entries(s, d), "brand"), f"{W} {_count('brand')}"),
    "gap_matrix": (lambda s, d: C.gap_matrix(S.entries(s, d), "segment", "brand"), f"{W} {PAIRS}"),
    "gap_matrix_semi": (
        lambda s, d: C.gap_matrix(S.entries(s, d), "type", "brand", only_with=("segment", "BUILDING")),
        f"{W} SELECT r.value AS row_value, c.value AS col_value, count(*) AS n FROM good r JOIN good c USING (dataset_id) WHERE r.dimension = 'type' AND c.dimension = 'brand' AND dataset_id IN (SELECT dataset_id FROM entries WHERE dimension = 'segment' AND value = 'BUILDING') GROUP BY ALL",
    ),
    "uncovered_values": (lambda s, d: C.uncovered_values(_brands(s, d), S.entries(s, d), "brand"), f"{W} SELECT value FROM brands WHERE value NOT IN (SELECT value FROM good WHERE dimension = 'brand')"),
    "dark_pairs": (
        lambda s, d: C.dark_pairs(_priced(s, d), "p_brand", "price", top=25),
        f"""WITH {PRICED}, {MARGINS} SELECT value_a, value_b, n_a, n_b, n_a + n_b AS score FROM a, b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.value_a = a.value_a AND n.value_b = b.value_b) ORDER BY score DESC, value_a, value_b LIMIT 25""",
    ),
    "thin_pairs": (
        lambda s, d: C.thin_pairs(_priced(s, d), "p_brand", "price", target=3, top=25),
        f"""WITH {PRICED}, {MARGINS} SELECT value_b, value_a, n, n_a, n_b, n_a + n_b - n AS opportunity FROM n JOIN a USING (value_a) JOIN b USING (value_b) WHERE n < 3 ORDER BY n, opportunity DESC, value_a, value_b LIMIT 25""",
    ),
    "vocabulary_coverage": (lambda s, d: C.vocabulary_coverage(_brands(s, d), S.entries(s, d), "brand"), f"{W} SELECT b.value, count(DISTINCT dataset_id) AS n FROM brands b LEFT JOIN entries e ON e.value = b.value AND e.dimension = 'brand' GROUP BY b.value"),
    "datasets_for_value": (
        lambda s, d: C.datasets_for_value(S.entries(s, d), _datasets(s, d).select("dataset_id", "title"), "segment", "BUILDING", limit=20, offset=5),
        f"{W} SELECT dataset_id, title, round(confidence, 3) AS confidence FROM entries JOIN datasets USING (dataset_id) WHERE dimension = 'segment' AND value = 'BUILDING' AND confidence >= 0.65 ORDER BY 3 DESC, 2 LIMIT 20 OFFSET 5",
    ),
    "missing_dimension": (lambda s, d: C.missing_dimension(_datasets(s, d), S.entries(s, d), "brand"), f"{W} SELECT * FROM datasets WHERE dataset_id NOT IN (SELECT dataset_id FROM entries WHERE dimension = 'brand')"),
    "source_coverage_rates": (
        lambda s, d: C.source_rates(_datasets(s, d), S.entries(s, d), DIMS),
        f"""{W} SELECT source, count(*) AS n_datasets, {", ".join(f"round(100.0::DOUBLE * count(*) FILTER (dataset_id IN (SELECT dataset_id FROM good WHERE dimension = '{x}')) / count(*), 1) AS {x}_pct" for x in DIMS)} FROM datasets GROUP BY source""",
    ),
    "coverage_summary": (lambda s, d: C.summary(_datasets(s, d), S.entries(s, d)), f"{W} SELECT dimension, count(DISTINCT dataset_id) AS n, round(100.0::DOUBLE * count(DISTINCT dataset_id) / (SELECT count(*) FROM datasets), 1) AS pct FROM good GROUP BY dimension"),
    "rarity_boost": (
        lambda s, d: C.rarity_boost(S.entries(s, d), "brand"),
        f"""{W}, c AS ({_count('brand')}), t AS (SELECT count(DISTINCT dataset_id) AS total FROM entries), r AS (SELECT value, 1 - ln(n + 1) / ln(total + 1) AS rarity FROM c, t)
        SELECT dataset_id, round(least(0.1::DOUBLE, avg(rarity) * 0.1::DOUBLE), 4) AS boost FROM (SELECT DISTINCT dataset_id, value FROM entries WHERE dimension = 'brand') JOIN r USING (value) GROUP BY dataset_id""",
    ),
    "source_states": (
        lambda s, d: C.source_states(_datasets(s, d), C.state_grid(_datasets(s, d), S.entries(s, d), DIMS)),
        f"""{W}, grid AS (SELECT dataset_id, source, dimension, (SELECT max(confidence) FROM entries e WHERE e.dataset_id = x.dataset_id AND e.dimension = x.dimension) AS best FROM (SELECT *, unnest({DIMS}) AS dimension FROM datasets) x)
        SELECT source, dimension, count(*) FILTER (best >= 0.8) AS observed, count(*) FILTER (best < 0.8) AS inferred_silver, count(*) FILTER (best IS NULL) AS unknown_needs_review, count(*) AS total,
               round(1 - count(*) FILTER (best IS NULL) / count(*), 4) AS actionable FROM grid GROUP BY source, dimension""",
    ),
    "worklist_summary": (
        lambda s, d: C.worklist_summary(C.worklist(_datasets(s, d), C.state_grid(_datasets(s, d), S.entries(s, d), DIMS), {"brand": 90, "type": 80}), top=20),
        f"""{W}, open AS (SELECT dataset_id, source, dimension FROM (SELECT *, unnest({DIMS}) AS dimension FROM datasets) x WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.dataset_id = x.dataset_id AND e.dimension = x.dimension))
        SELECT source, dimension, count(*) AS n, max(CASE dimension WHEN 'brand' THEN 95 WHEN 'type' THEN 85 ELSE 55 END) AS max_priority, min(dataset_id) AS first_dataset FROM open GROUP BY ALL ORDER BY 4 DESC, 3 DESC, 1, 2 LIMIT 20""",
    ),
    "coverage_plan": (
        lambda s, d: C.coverage_plan(
            _brands(s, d),
            S.table(s, d, "part").select(F.col("p_brand").alias("value"), F.col("p_partkey").alias("id")),
            S.entries(s, d).where("dimension = 'brand'").select("value", F.col("dataset_id").alias("id")),
            corpus_target=85,
            benchmark_target=1200,
        ),
        f"""{W}, c AS (SELECT p_brand AS value, count(*) AS corpus FROM part GROUP BY 1), q AS (SELECT value, count(DISTINCT dataset_id) AS queries FROM entries WHERE dimension = 'brand' GROUP BY 1),
        x AS (SELECT value, coalesce(corpus, 0) AS corpus, coalesce(queries, 0) AS queries FROM brands LEFT JOIN c USING (value) LEFT JOIN q USING (value)),
        y AS (SELECT *, 2 * greatest(0, 85 - corpus) + greatest(0, 1200 - queries) AS score FROM x)
        SELECT *, CASE WHEN score >= 6 THEN 'critical' WHEN score >= 3 THEN 'high' ELSE 'medium' END AS class FROM y WHERE score > 0""",
    ),
    "coverage_rollup": (lambda s, d: C.with_subtotals(S.entries(s, d)), f"{W} SELECT dimension, value, count(DISTINCT dataset_id) AS n, CAST(grouping(dimension, value) AS BIGINT) AS level FROM good GROUP BY ROLLUP (dimension, value)"),
    "first_supplier_wins": (
        lambda s, d: C.first_per_key(S.table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_discount"), ["l_partkey"], [F.col("l_discount").desc(), F.col("l_suppkey")]),
        "SELECT l_partkey, l_suppkey, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_suppkey) AS k FROM lineitem) WHERE k = 1",
    ),
}
