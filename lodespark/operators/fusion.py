"""Fusing ranked lists (system, query_id, doc_id, score, rank); every method is windows and one aggregation by (query, document)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K = 60


def _weight(weights: dict[str, float] | None) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(*(F.when(F.col("system") == s, F.lit(float(w))) for s, w in weights.items()), F.lit(1.0))


def _ranked(scores: DataFrame, top: int | None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    out = scores.withColumn("score", F.round("score", 9)).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= top) if top else out


def _minmax() -> Column:
    """Scores of a list spread over 0..1; a constant list is all 1."""
    w = Window.partitionBy("system", "query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))


def rrf(runs: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Sum of w / (k + rank); an id repeated in a list counts at its last place."""
    last = runs.groupBy("system", "query_id", "doc_id").agg(F.max("rank").alias("rank"))
    return _ranked(last.groupBy("query_id", "doc_id").agg(F.sum(_weight(weights) / (k + F.col("rank"))).alias("score")), top)


def weighted_sum(runs: DataFrame, weights: dict[str, float] | None = None, top: int | None = None) -> DataFrame:
    """Min-max scores times weights that add up to 1 over the systems."""
    total = runs.select("system").distinct().agg(F.sum(_weight(weights)).alias("total"))
    rows = runs.withColumn("norm", _minmax()).crossJoin(total)
    return _ranked(rows.groupBy("query_id", "doc_id").agg(F.sum(_weight(weights) / F.col("total") * F.col("norm")).alias("score")), top)


def borda(runs: DataFrame, weights: dict[str, float] | None = None, top: int | None = None) -> DataFrame:
    """Sum of w * (list length - rank + 1)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("system", "query_id"))
    rows = runs.withColumn("points", _weight(weights) * (n - F.col("rank") + 1))
    return _ranked(rows.groupBy("query_id", "doc_id").agg(F.sum("points").alias("score")), top)


def combmnz(runs: DataFrame, weights: dict[str, float] | None = None, top: int | None = None) -> DataFrame:
    """Sum of weighted min-max scores times the number of lists."""
    rows = runs.withColumn("norm", _weight(weights) * _minmax())
    return _ranked(rows.groupBy("query_id", "doc_id").agg((F.sum("norm") * F.countDistinct("system")).alias("score")), top)


def explain(runs: DataFrame, k: int = RRF_K) -> DataFrame:
    """Each list's share of a document's reciprocal-rank score."""
    return runs.select("query_id", "doc_id", "system", F.round(1 / (k + F.col("rank")), 6).alias("part"))


def component_mean(runs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of scores; confidence grows with the number of systems, four being certain."""
    w = _weight(weights)
    g = runs.groupBy("query_id", "doc_id").agg((F.sum(w * F.col("score")) / F.sum(w)).alias("score"), F.countDistinct("system").alias("n_systems"))
    return g.select("query_id", "doc_id", F.round("score", 9).alias("score"), F.least(F.col("n_systems") / 4, F.lit(1.0)).alias("confidence"))


def hybrid(base: DataFrame, other: DataFrame, weight: float = 0.3, top: int | None = None) -> DataFrame:
    """(1 - w) * base + w * other over the outer union of two (query_id, doc_id, score) tables."""
    b, o = base.withColumnRenamed("score", "b"), other.withColumnRenamed("score", "o")
    j = b.join(o, ["query_id", "doc_id"], "full_outer")
    return _ranked(j.select("query_id", "doc_id", ((1 - weight) * F.coalesce("b", F.lit(0.0)) + weight * F.coalesce("o", F.lit(0.0))).alias("score")), top)


def source_diversity(ranked: DataFrame, per_source: int, drop: bool = False, limit: int | None = None) -> DataFrame:
    """The first ``per_source`` results of each source keep their order; the rest go to the end, or go.

    Expects (query_id, doc_id, source, score); a null source is one of its own.
    """
    source = Window.partitionBy("query_id", F.coalesce("source", F.lit("unknown"))).orderBy(F.col("score").desc(), "doc_id")
    rows = ranked.withColumn("in_source", F.row_number().over(source))
    rows = rows.where(F.col("in_source") <= per_source) if drop else rows
    place = Window.partitionBy("query_id").orderBy((F.col("in_source") > per_source).cast("int"), F.col("score").desc(), "doc_id")
    rows = rows.withColumn("rank", F.row_number().over(place))
    return rows.where(F.col("rank") <= limit) if limit else rows


def pooled(runs: DataFrame, depth: int) -> DataFrame:
    """The pool for judging: each candidate with its systems, best rank and best score, most systems first."""
    rows = runs.where(F.col("rank") <= depth)
    return rows.groupBy("query_id", "doc_id").agg(F.countDistinct("system").alias("n_systems"), F.array_join(F.array_sort(F.collect_set("system")), ",").alias("systems"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score"))
