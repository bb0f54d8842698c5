"""Evaluation queries: two vector systems judged by labels; calibration and agreement over document labels and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.functions import sums as X
from lodespark.operators import evaluation as E
from lodespark.sources import tables as S


def _judged(spark, d):
    return S.judgement_counts(spark, d)


def _all(spark, d):
    """NDCG in five variants side by side."""
    runs, judged = S.runs(spark, d), _judged(spark, d)
    variants = {
        "exp_all": E.ndcg(runs, judged, 10), "linear_all": E.ndcg(runs, judged, 10, gain="linear"),
        "exp_list": E.ndcg(runs, None, 10), "linear_list": E.ndcg(runs, None, 10, gain="linear"), "inverse_list": E.ndcg(runs, None, 10, gain="linear", discount="inverse"),
    }
    out = None
    for name, v in variants.items():
        v = v.select(F.lit(name).alias("variant"), "system", "query_id", "ndcg")
        out = v if out is None else out.unionByName(v)
    return out


def _ndcg_sql(name, gain, disc, ideal):
    g = {"exp": "(2.0::DOUBLE ** grade - 1)", "linear": "grade::DOUBLE"}[gain]
    dsc = (lambda r: f"{r}::DOUBLE") if disc == "inverse" else (lambda r: f"log2({r} + 1)")
    part, src = ("query_id", "search_pairs") if ideal == "all" else ("system, query_id", "runs")
    join = "USING (query_id)" if ideal == "all" else "USING (system, query_id)"
    return f"""SELECT '{name}' AS variant, a.system, a.query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg
      FROM (SELECT system, query_id, sum({g} / {dsc("rank")}) AS dcg FROM runs WHERE rank <= 10 GROUP BY ALL) a
      JOIN (SELECT {part}, sum({g} / {dsc("place")}) AS idcg FROM (SELECT {part}, grade, row_number() OVER (PARTITION BY {part} ORDER BY grade DESC) AS place FROM {src}) WHERE place <= 10 GROUP BY ALL) b {join}"""


NDCG = f"WITH {S.RUNS} " + " UNION ALL ".join(_ndcg_sql(*x) for x in (("exp_all", "exp", "log2", "all"), ("linear_all", "linear", "log2", "all"), ("exp_list", "exp", "log2", "list"), ("linear_list", "linear", "log2", "list"), ("inverse_list", "linear", "inverse", "list")))
BINARY = f"""{S.RUNS}, total AS (SELECT query_id, count(*) FILTER (grade >= 2) AS relevant FROM search_pairs GROUP BY 1),
g AS (SELECT system, query_id, coalesce(1 / min(rank) FILTER (grade >= 2), 0) AS rr, count(*) FILTER (grade >= 2 AND rank <= 10) AS hits, count(*) FILTER (rank <= 10) AS returned FROM runs GROUP BY ALL),
binary_metrics AS (SELECT system, query_id, round(rr, 6) AS rr, round(hits / returned, 6) AS precision_returned, round(hits / 10, 6) AS precision_k, round(CASE WHEN relevant > 0 THEN hits / relevant ELSE 0 END, 6) AS recall FROM g JOIN total USING (query_id))"""


def _binary(spark, d):
    return E.binary_metrics(S.runs(spark, d), _judged(spark, d), 10)


def _confidences(spark, d):
    """Confidence 1 - 10 * discount of a line, and whether it was returned."""
    return S.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("l_discount") * 10)).alias("confidence"), (F.col("l_returnflag") == "R").cast("double").alias("label"))


CONF = "c AS (SELECT l_orderkey * 8 + l_linenumber AS id, least(1, greatest(0, 1 - l_discount * 10))::DOUBLE AS confidence, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM lineitem)"


def _kappa(spark, d):
    """Two raters: quantity quartile and price quartile of a line, as classes 0..3."""
    q = F.least(F.lit(3), F.floor((F.col("l_quantity") - 1) / 12.5)).cast("int")
    p = F.least(F.lit(3), F.floor(F.col("l_extendedprice") / 25000)).cast("int")
    return E.quadratic_kappa(S.table(spark, d, "lineitem").select(q.alias("a"), p.alias("b")), 4)


def _votes(spark, d):
    """Votes on parts: each line rates its part."""
    return S.table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), (F.col("l_linenumber") % 4).alias("vote"), (1 - F.col("l_discount") * 5).alias("confidence"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("hard_negative"), X.place().alias("place"))


QUERIES = {
    "ndcg_variants": (_all, NDCG),
    "mrr_recall_precision": (_binary, f"WITH {BINARY} SELECT * FROM binary_metrics"),
    "macro_metrics": (lambda s, d: E.macro(_binary(s, d), ["rr", "precision_k", "recall"]), f"WITH {BINARY} SELECT system, count(*) AS n_queries, round(avg(rr), 4) AS rr, round(avg(precision_k), 4) AS precision_k, round(avg(recall), 4) AS recall FROM binary_metrics GROUP BY system"),
    "sign_test": (
        lambda s, d: E.sign_test(_binary(s, d), "precision_k", "cos", "head"),
        f"WITH {BINARY}, counts AS (SELECT count(*) FILTER (x.precision_k > y.precision_k) AS wins, count(*) FILTER (x.precision_k < y.precision_k) AS losses, count(*) FILTER (x.precision_k = y.precision_k) AS ties FROM binary_metrics x JOIN binary_metrics y USING (query_id) WHERE x.system = 'cos' AND y.system = 'head') SELECT *, round(CASE WHEN wins + losses > 0 THEN abs(wins - losses) / sqrt(wins + losses) ELSE 0 END, 6) AS z FROM counts",
    ),
    "hard_negative_rate": (
        lambda s, d: E.hard_negative_rate(S.runs(s, d), 20),
        f"WITH {S.RUNS}, f AS (SELECT *, min(rank) FILTER (grade >= 2) OVER (PARTITION BY system, query_id) AS first FROM runs) SELECT system, query_id, round(CASE WHEN max(first) IS NULL THEN 0 WHEN count(*) FILTER (grade = 0) > 0 THEN count(*) FILTER (grade = 0 AND rank < first) / count(*) FILTER (grade = 0) ELSE 0 END, 6) AS rate FROM f WHERE rank <= 20 AND (first IS NULL OR first <= 20) GROUP BY ALL "
        f"UNION ALL SELECT system, query_id, 0 AS rate FROM f WHERE rank <= 20 AND first > 20 GROUP BY ALL",
    ),
    "degradation": (
        lambda s, d: E.degradation(_binary(s, d).where("system = 'cos'"), _binary(s, d).where("system = 'head'"), "recall"),
        f"WITH {BINARY}, l AS (SELECT query_id, round(CASE WHEN x.recall > 0 THEN (x.recall - y.recall) / x.recall ELSE 0 END, 6) AS loss FROM binary_metrics x JOIN binary_metrics y USING (query_id) WHERE x.system = 'cos' AND y.system = 'head') SELECT *, CASE WHEN loss >= 0.3 THEN 'critical' WHEN loss >= 0.15 THEN 'high' WHEN loss >= 0.05 THEN 'medium' ELSE 'low' END AS severity FROM l",
    ),
    "source_skew": (
        lambda s, d: E.source_skew(S.runs(s, d), S.table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("source")), 10),
        f"WITH {S.RUNS}, g AS (SELECT system, label AS source, count(*) AS n FROM runs JOIN embeddings ON vec_id = doc_id WHERE rank <= 10 GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY system), 6) AS share FROM g",
    ),
    "reliability_bins": (lambda s, d: E.reliability_bins(_confidences(s, d)), f"WITH {CONF} SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(confidence), 6) AS conf, round(avg(label), 6) AS acc, round(abs(avg(confidence) - avg(label)), 6) AS gap FROM c GROUP BY 1"),
    "quantile_bins": (lambda s, d: E.quantile_bins(_confidences(s, d)), f"WITH {CONF}, b AS (SELECT *, ntile(10) OVER (ORDER BY confidence, id) - 1 AS bin FROM c) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(confidence), 6) AS conf, round(avg(label), 6) AS acc FROM b GROUP BY 1"),
    "ece_brier": (
        lambda s, d: E.calibration(_confidences(s, d)),
        f"""WITH {CONF}, b AS (SELECT count(*) AS n, avg(confidence) - avg(label) AS gap FROM c GROUP BY least(floor(confidence * 10), 9)),
        e AS (SELECT sum(n * abs(gap)) / sum(n) AS ece, max(abs(gap)) AS mce, sum(CASE WHEN gap > 0 THEN n * gap ELSE 0 END) / sum(n) AS over FROM b)
        SELECT round(ece, 5) AS ece, round(mce, 5) AS mce, round(over, 5) AS over, (SELECT round(avg((confidence - label) ** 2), 5) FROM c) AS brier, (SELECT round(regr_slope(label, confidence), 5) FROM c) AS slope, (SELECT round(regr_intercept(label, confidence), 5) FROM c) AS intercept FROM e""",
    ),
    "quadratic_kappa": (
        _kappa,
        """WITH p AS (SELECT least(3, floor((l_quantity - 1) / 12.5::DOUBLE)) AS a, least(3, floor(l_extendedprice / 25000)) AS b FROM lineitem), o AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL),
        x AS (SELECT sum((a - b) ** 2 * n) AS observed, sum(n) AS total FROM o), y AS (SELECT sum((q.a - r.b) ** 2 * na * nb) AS expected FROM (SELECT a, sum(n) AS na FROM o GROUP BY a) q, (SELECT b, sum(n) AS nb FROM o GROUP BY b) r)
        SELECT CAST(total AS BIGINT) AS n, round(1 - observed * total / expected, 6) AS kappa FROM x, y""",
    ),
    "spearman": (
        lambda s, d: E.spearman(S.table(s, d, "lineitem"), "l_quantity", "l_extendedprice"),
        """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM lineitem) SELECT count(*) AS n, round(corr(x, y), 6) AS spearman FROM r""",
    ),
    "vote_ensemble": (
        lambda s, d: E.vote_ensemble(_votes(s, d)),
        """WITH v AS (SELECT l_partkey AS item, l_linenumber % 4 AS vote, 1 - l_discount * 5 AS confidence, l_returnflag = 'R' AND l_quantity > 49 AS hard FROM lineitem),
        g AS (SELECT item, bool_or(hard) AS veto, sum(vote * confidence) / sum(confidence) AS mean, avg(confidence) AS conf, var_pop(vote) AS variance, count(*) AS n_votes FROM v GROUP BY item)
        SELECT item, CASE WHEN veto THEN 0 ELSE least(3, greatest(0, CAST(round_even(mean, 0) AS INTEGER))) END AS label, round(CASE WHEN veto THEN 0.95::DOUBLE ELSE conf END, 6) AS confidence, n_votes, NOT veto AND n_votes >= 3 AND conf >= 0.75 AND variance < 0.5 AS silver FROM g""",
    ),
    "review_agreement": (
        lambda s, d: E.agreement(S.table(s, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("label"))),
        "SELECT count(*) AS groups, round(avg(CASE WHEN kinds = 1 THEN 1 ELSE 0 END), 6) AS rate FROM (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)",
    ),
    "bootstrap_ci": (lambda s, d: E.bootstrap_means(_binary(s, d), "precision_k"), None),
}
