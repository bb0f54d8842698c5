"""Retrieval evaluation: per-query metrics from judged runs, calibration, agreement, gates.

Runs have (system, query_id, doc_id, score, rank, grade); judgements (query_id, doc_id, grade). Every metric is one
aggregation by (system, query_id) over a window-ranked table; nothing is looped over queries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodespark.functions import sums as X


def _gain(kind: str) -> Column:
    return F.pow(F.lit(2.0), F.col("grade")) - 1 if kind == "exp" else F.col("grade").cast("double")


def _discount(kind: str, rank: Column) -> Column:
    return rank.cast("double") if kind == "inverse" else F.log2(rank + 1)


def ndcg(runs: DataFrame, judged: DataFrame | None, k: int, gain: str = "exp", discount: str = "log2") -> DataFrame:
    """NDCG at k by system and query.

    With ``judged`` the ideal order is that of all judgements of the query; without, that of the retrieved list itself
    (a variant that flatters). Queries without gain score 0. Judgements may be counts (query_id, grade, n): of these at
    most k of a grade are made rows.
    """
    if judged is not None and "n" in judged.columns:
        judged = judged.select("query_id", "grade", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))).alias("nth"))
    dcg = runs.where(F.col("rank") <= k).groupBy("system", "query_id").agg(F.sum(_gain(gain) / _discount(discount, F.col("rank"))).alias("dcg"))
    keys = ["query_id"] if judged is not None else ["system", "query_id"]
    best = Window.partitionBy(*keys).orderBy(F.col("grade").desc())
    ideal = (judged if judged is not None else runs).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    ideal = ideal.groupBy(*keys).agg(F.sum(_gain(gain) / _discount(discount, F.col("place"))).alias("idcg"))
    out = dcg.join(ideal, keys)
    return out.select("system", "query_id", F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)), 6).alias("ndcg"))


def binary_metrics(runs: DataFrame, judged: DataFrame, k: int, relevant: int = 2) -> DataFrame:
    """Reciprocal rank, precision over the returned and over k, recall at k; a grade of ``relevant`` counts. Judgements are rows or counts (query_id, grade, n)."""
    hit = (F.col("grade") >= relevant) & (F.col("rank") <= k)
    g = runs.groupBy("system", "query_id").agg(
        F.coalesce(1 / F.min(F.when(F.col("grade") >= relevant, F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.count_if(hit).alias("hits"), F.count_if(F.col("rank") <= k).alias("returned"),
    )
    each = F.col("n") if "n" in judged.columns else F.lit(1)
    total = judged.groupBy("query_id").agg(F.sum(F.when(F.col("grade") >= relevant, each).otherwise(0)).alias("relevant"))
    g = g.join(total, "query_id", "left")
    return g.select("system", "query_id", F.round("rr", 6).alias("rr"), F.round(F.col("hits") / F.col("returned"), 6).alias("precision_returned"), F.round(F.col("hits") / k, 6).alias("precision_k"), F.round(F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(F.lit(0.0)), 6).alias("recall"))


def hard_negative_rate(runs: DataFrame, k: int, relevant: int = 2, if_none: str = "zero") -> DataFrame:
    """Share of a list's grade-0 results that stand above its first relevant one.

    Without a relevant result: 0, or (``if_none="all"``) all of them.
    """
    first = F.min(F.when(F.col("grade") >= relevant, F.col("rank"))).over(Window.partitionBy("system", "query_id"))
    rows = runs.where(F.col("rank") <= k).withColumn("first", first)
    above = F.count_if((F.col("grade") == 0) & (F.col("rank") < F.col("first")))
    bad = F.count_if(F.col("grade") == 0)
    none = F.lit(0.0) if if_none == "zero" else F.when(bad > 0, 1.0).otherwise(0.0)
    rate = F.when(F.max("first").isNull(), none).when(bad > 0, above / bad).otherwise(F.lit(0.0))
    return rows.groupBy("system", "query_id").agg(F.round(rate, 6).alias("rate"))


def macro(metrics: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over queries, rounded to 4 places."""
    return metrics.groupBy(*(by or ["system"])).agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(c), 4).alias(c) for c in columns))


def sign_test(metrics: DataFrame, column: str, a: str, b: str) -> DataFrame:
    """Wins, losses and ties of system a against b over queries, and the sign test's z."""
    x = metrics.where(F.col("system") == a).select("query_id", F.col(column).alias("x"))
    y = metrics.where(F.col("system") == b).select("query_id", F.col(column).alias("y"))
    g = x.join(y, "query_id").agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") < F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"))
    n = F.col("wins") + F.col("losses")
    return g.withColumn("z", F.round(F.when(n > 0, (F.abs(F.col("wins") - F.col("losses"))) / F.sqrt(n)).otherwise(F.lit(0.0)), 6))


def reliability_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins of (confidence, label 0/1): count, mean confidence, accuracy, gap; the last bin is closed."""
    k = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    g = rows.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("conf"), F.avg("label").alias("acc"))
    return g.select("bin", "n", F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"), F.round(F.abs(F.col("conf") - F.col("acc")), 6).alias("gap"))


#: Ranges of values over which rows are counted, so that no window orders a whole table.
RANGES = 64


def _ranged(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``range``, the number of approximate quantiles at or below the value: ranges are in the values' order, whatever the approximation."""
    edges = rows.agg(F.percentile_approx(column, [k / RANGES for k in range(1, RANGES)], 1000)).first()[0] or []
    edges = F.array(*map(F.lit, sorted(set(edges)))) if edges else F.array().cast("array<double>")
    return rows.withColumn("range", F.size(F.filter(edges, lambda e: e <= F.col(column))))


def _offsets(counts: DataFrame) -> DataFrame:
    """(range, before): rows of all earlier ranges, from (range, m); one row for each range."""
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.groupBy("range").agg(F.sum("m").alias("m")).select("range", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("before"))


def quantile_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Bins of equal count by confidence (ties by id); the first take what is left over. Rows are numbered within ranges only."""
    ranged = _ranged(rows, "confidence")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("m"))
    total = counts.agg(F.sum("m").alias("total"))
    at = F.row_number().over(Window.partitionBy("range").orderBy("confidence", "id")) - 1
    placed = ranged.withColumn("at", at).join(_offsets(counts), "range").crossJoin(total).withColumn("at", F.col("at") + F.col("before"))
    size, more = F.floor(F.col("total") / bins), F.col("total") % bins
    big = more * (size + 1)
    k = F.when(F.col("at") < big, F.floor(F.col("at") / (size + 1))).otherwise(more + F.floor((F.col("at") - big) / size)).cast("int")
    return placed.withColumn("bin", k).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("conf"), F.round(F.avg("label"), 6).alias("acc"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error, Brier score, slope and intercept of label on confidence."""
    b = rows.groupBy(F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), (F.avg("confidence") - F.avg("label")).alias("gap"))
    errors = b.agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece"), F.max(F.abs("gap")).alias("mce"), (F.sum(F.when(F.col("gap") > 0, F.col("n") * F.col("gap")).otherwise(0.0)) / F.sum("n")).alias("over"))
    fit = rows.agg(F.avg(F.pow(F.col("confidence") - F.col("label"), 2)).alias("brier"), F.regr_slope("label", "confidence").alias("slope"), F.regr_intercept("label", "confidence").alias("intercept"))
    return errors.crossJoin(fit).select(*(F.round(c, 5).alias(c) for c in ("ece", "mce", "over", "brier", "slope", "intercept")))


def quadratic_kappa(pairs: DataFrame, classes: int) -> DataFrame:
    """Quadratic weighted kappa of (a, b) class pairs; 1 where chance leaves no disagreement."""
    o = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = o.agg(F.sum("n").alias("total"), F.sum(F.pow(F.col("a") - F.col("b"), 2) * F.col("n")).alias("observed"))
    pa, pb = o.groupBy("a").agg(F.sum("n").alias("na")), o.groupBy("b").agg(F.sum("n").alias("nb"))  # one row for each class
    chance = pa.crossJoin(pb).agg(F.sum(F.pow(F.col("a") - F.col("b"), 2) * F.col("na") * F.col("nb")).alias("expected"))
    k = F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(1 - F.col("observed") * F.col("total") / F.col("expected"))
    return total.crossJoin(chance).select(F.col("total").alias("n"), F.round(k, 6).alias("kappa"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties.

    Mean ranks come from counts by value, and distinct values are only ordered within ranges.
    """

    def ranks(c: str) -> DataFrame:
        g = _ranged(rows.groupBy(c).agg(F.count(F.lit(1)).alias("m")), c)
        within = F.sum("m").over(Window.partitionBy("range").orderBy(c).rowsBetween(Window.unboundedPreceding, 0))
        g = g.withColumn("upto", within).join(_offsets(g.select("range", "m")), "range")
        return g.select(F.col(c).alias(f"{c}_v"), (F.col("before") + F.col("upto") - (F.col("m") - 1) / 2).alias(f"{c}_rank"))

    j = rows.join(ranks(x), F.col(x) == F.col(f"{x}_v")).join(ranks(y), F.col(y) == F.col(f"{y}_v"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr(f"{x}_rank", f"{y}_rank"), 6).alias("spearman"))


def vote_ensemble(votes: DataFrame) -> DataFrame:
    """(item, label, confidence, n_votes, silver) of (item, vote, confidence, hard_negative) rows.

    A hard-negative vote decides: 0 at 0.95. Else the confidence-weighted mean, rounded half to even, kept in 0..3;
    silver needs three votes, confidence 0.75 and a variance below 0.5. Sums do not depend on the order of the votes,
    unless these have a ``place``: then doubles are added up in its order, as SQL over the table adds them.
    """
    weighted, weight = F.col("vote") * F.col("confidence"), F.col("confidence")
    if "place" in votes.columns:
        votes = X.running(votes, "item", {"weighted": weighted, "weight": weight})
        mean, conf = F.try_divide(F.max_by("weighted", "place"), F.max_by("weight", "place")), F.try_divide(F.max_by("weight", "place"), F.count("confidence"))
    else:
        mean, conf = X.ratio(X.total(weighted), X.total(weight)), X.mean(weight)
    g = votes.groupBy("item").agg(F.max("hard_negative").alias("veto"), mean.alias("mean"), conf.alias("conf"), F.var_pop("vote").alias("variance"), F.count("vote").alias("n_votes"))
    label = F.when(F.col("veto"), F.lit(0)).otherwise(F.least(F.lit(3), F.greatest(F.lit(0), F.bround("mean").cast("int"))))
    conf = F.when(F.col("veto"), F.lit(0.95)).otherwise(F.col("conf"))
    silver = ~F.col("veto") & (F.col("n_votes") >= 3) & (F.col("conf") >= 0.75) & (F.col("variance") < 0.5)
    return g.select("item", label.alias("label"), F.round(conf, 6).alias("confidence"), "n_votes", silver.alias("silver"))


def agreement(reviews: DataFrame) -> DataFrame:
    """Share of items with several reviews whose reviews are all equal; null when there are none."""
    g = reviews.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("kinds")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg((F.col("kinds") == 1).cast("int")), 6).alias("rate"))


def source_skew(runs: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Share of each source among the top k."""
    rows = runs.where(F.col("rank") <= k).join(sources, "doc_id").groupBy("system", "source").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("system")), 6))


def degradation(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Relative loss by query, 0 where there was nothing to lose, and its severity."""
    j = before.select("query_id", F.col(column).alias("x")).join(after.select("query_id", F.col(column).alias("y")), "query_id")
    loss = F.when(F.col("x") > 0, (F.col("x") - F.col("y")) / F.col("x")).otherwise(F.lit(0.0))
    return j.select("query_id", F.round(loss, 6).alias("loss")).withColumn("severity", F.when(F.col("loss") >= 0.3, "critical").when(F.col("loss") >= 0.15, "high").when(F.col("loss") >= 0.05, "medium").otherwise("low"))


#: P(X <= k) of a Poisson variable X of mean 1, up to the last k at which a double of 53 random bits can pass it.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(18)]


def bootstrap_means(metrics: DataFrame, column: str, resamples: int = 1000, seed: str = "b") -> DataFrame:
    """Percentile interval of the mean by system: Poisson weights from a hash of resample and query, so that no sample is drawn."""
    reps = metrics.select("system", "query_id", F.col(column).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("rep"))
    u = F.pmod(F.xxhash64(F.lit(seed), "rep", "query_id"), F.lit(1 << 53)) / float(1 << 53)
    means = reps.withColumn("u", u).withColumn("w", F.size(F.filter(F.array(*map(F.lit, POISSON)), lambda c: c <= F.col("u"))))
    means = means.groupBy("system", "rep").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("m"))
    return means.groupBy("system").agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))


def gate(checks: DataFrame) -> DataFrame:
    """(name, value, minimum) to pass or fail, and whether all pass."""
    rows = checks.withColumn("ok", F.col("value") >= F.col("minimum"))
    return rows.withColumn("all_ok", F.min("ok").over(Window.partitionBy(F.lit(1))))
