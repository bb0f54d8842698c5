"""Coverage analytics over entries (dataset_id, dimension, value, confidence).

All counts are of distinct datasets. Hash aggregation combines before every shuffle; the only cartesian product is of
two marginal tables whose size is the number of values of a dimension, and it goes through a broadcast only if small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Entries below this confidence do not count as coverage.
FLOOR = 0.65


def counted(entries: DataFrame, dimension: str, floor: float = FLOOR) -> DataFrame:
    """(value, n): datasets of each value of a dimension."""
    rows = entries.where((F.col("dimension") == dimension) & (F.col("confidence") >= floor))
    return rows.groupBy("value").agg(F.countDistinct("dataset_id").alias("n"))


def gap_matrix(entries: DataFrame, row_dim: str, col_dim: str, only_with: tuple[str, str] | None = None, floor: float = FLOOR) -> DataFrame:
    """(row_value, col_value, n): datasets that have both values; optionally only datasets with another (dimension, value)."""
    good = entries.where(F.col("confidence") >= floor)
    rows = good.where(F.col("dimension") == row_dim).select("dataset_id", F.col("value").alias("row_value")).distinct()
    cols = good.where(F.col("dimension") == col_dim).select("dataset_id", F.col("value").alias("col_value")).distinct()
    if only_with:
        keep = entries.where((F.col("dimension") == only_with[0]) & (F.col("value") == only_with[1])).select("dataset_id")
        rows = rows.join(keep, "dataset_id", "left_semi")
    return rows.join(cols, "dataset_id").groupBy("row_value", "col_value").agg(F.count(F.lit(1)).alias("n"))


def uncovered_values(vocabulary: DataFrame, entries: DataFrame, dimension: str, floor: float = FLOOR) -> DataFrame:
    """Vocabulary rows (value) that no dataset covers."""
    return vocabulary.join(counted(entries, dimension, floor).select("value"), "value", "left_anti")


def dark_pairs(entries: DataFrame, dim_a: str, dim_b: str, top: int, floor: float = FLOOR) -> DataFrame:
    """Pairs of values that occur but never together, by the sum of their counts; ties by value."""
    a = counted(entries, dim_a, floor).select(F.col("value").alias("value_a"), F.col("n").alias("n_a"))
    b = counted(entries, dim_b, floor).select(F.col("value").alias("value_b"), F.col("n").alias("n_b"))
    seen = gap_matrix(entries, dim_a, dim_b, floor=floor).select(F.col("row_value").alias("value_a"), F.col("col_value").alias("value_b"))
    pairs = a.crossJoin(b).join(seen, ["value_a", "value_b"], "left_anti").withColumn("score", F.col("n_a") + F.col("n_b"))
    return pairs.orderBy(F.col("score").desc(), "value_a", "value_b").limit(top)


def thin_pairs(entries: DataFrame, dim_a: str, dim_b: str, target: int, top: int, floor: float = FLOOR) -> DataFrame:
    """Pairs with fewer than ``target`` datasets; opportunity = both marginals less the pair's count."""
    n = gap_matrix(entries, dim_a, dim_b, floor=floor).toDF("value_a", "value_b", "n").where(F.col("n") < target)
    a = counted(entries, dim_a, floor).select(F.col("value").alias("value_a"), F.col("n").alias("n_a"))
    b = counted(entries, dim_b, floor).select(F.col("value").alias("value_b"), F.col("n").alias("n_b"))
    out = n.join(a, "value_a").join(b, "value_b").withColumn("opportunity", F.col("n_a") + F.col("n_b") - F.col("n"))
    return out.orderBy("n", F.col("opportunity").desc(), "value_a", "value_b").limit(top)


def vocabulary_coverage(vocabulary: DataFrame, entries: DataFrame, dimension: str) -> DataFrame:
    """(value, n) for every vocabulary value, 0 included, whatever the confidence."""
    rows = entries.where(F.col("dimension") == dimension).select("dataset_id", "value")
    return vocabulary.join(rows, "value", "left").groupBy("value").agg(F.countDistinct("dataset_id").alias("n"))


def datasets_for_value(entries: DataFrame, titles: DataFrame, dimension: str, value: str, limit: int, offset: int = 0, floor: float = FLOOR) -> DataFrame:
    """A page of datasets with the value: by confidence, then title."""
    rows = entries.where((F.col("dimension") == dimension) & (F.col("value") == value) & (F.col("confidence") >= floor))
    page = rows.join(titles, "dataset_id").select("dataset_id", "title", F.round("confidence", 3).alias("confidence"))
    return page.orderBy(F.col("confidence").desc(), "title").offset(offset).limit(limit)


def missing_dimension(datasets: DataFrame, entries: DataFrame, dimension: str) -> DataFrame:
    """Datasets without an entry in the dimension (anti-join: safe with nulls)."""
    return datasets.join(entries.where(F.col("dimension") == dimension).select("dataset_id"), "dataset_id", "left_anti")


def source_rates(datasets: DataFrame, entries: DataFrame, dimensions: list[str], floor: float = FLOOR) -> DataFrame:
    """Per source: datasets, and the percentage of them that each dimension covers."""
    total = datasets.groupBy("source").agg(F.count(F.lit(1)).alias("n_datasets"))
    has = entries.where(F.col("confidence") >= floor).select("dataset_id", "dimension").distinct().join(datasets, "dataset_id")
    wide = has.groupBy("source").pivot("dimension", dimensions).count()
    out = total.join(wide, "source", "left")
    return out.select("source", "n_datasets", *(F.round(100.0 * F.coalesce(F.col(d), F.lit(0)) / F.col("n_datasets"), 1).alias(f"{d}_pct") for d in dimensions))


def summary(datasets: DataFrame, entries: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Per dimension: datasets covered and their percentage of all."""
    total = datasets.agg(F.count(F.lit(1)).alias("total"))
    n = entries.where(F.col("confidence") >= floor).groupBy("dimension").agg(F.countDistinct("dataset_id").alias("n"))
    return n.crossJoin(total).select("dimension", "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def rarity_boost(entries: DataFrame, dimension: str, cap: float = 0.10, floor: float = FLOOR) -> DataFrame:
    """Per dataset: mean rarity 1 - ln(n + 1) / ln(N + 1) of its values times the cap; N is the number of datasets."""
    total = entries.agg(F.countDistinct("dataset_id").alias("total"))
    rare = counted(entries, dimension, floor).crossJoin(total).select("value", (1 - F.ln(F.col("n") + 1) / F.ln(F.col("total") + 1)).alias("rarity"))
    own = entries.where(F.col("dimension") == dimension).select("dataset_id", "value").distinct()
    return own.join(rare, "value").groupBy("dataset_id").agg(F.round(F.least(F.lit(cap), F.avg("rarity") * cap), 4).alias("boost"))


def state_grid(datasets: DataFrame, entries: DataFrame, dimensions: list[str]) -> DataFrame:
    """Dense (dataset_id, dimension, state): observed at 0.8 or more, silver below, unknown without an entry."""
    best = entries.groupBy("dataset_id", "dimension").agg(F.max("confidence").alias("best"))
    grid = datasets.select("dataset_id", F.explode(F.array(*map(F.lit, dimensions))).alias("dimension"))
    state = F.when(F.col("best") >= 0.8, "observed").when(F.col("best").isNotNull(), "inferred_silver").otherwise("unknown_needs_review")
    return grid.join(best, ["dataset_id", "dimension"], "left").select("dataset_id", "dimension", state.alias("state"))


def source_states(datasets: DataFrame, grid: DataFrame) -> DataFrame:
    """Per source and dimension: datasets in each state and the share that is not unknown."""
    rows = grid.join(datasets.select("dataset_id", "source"), "dataset_id")
    states = ["observed", "inferred_silver", "unknown_needs_review"]
    wide = rows.groupBy("source", "dimension").agg(*(F.count_if(F.col("state") == s).alias(s) for s in states), F.count(F.lit(1)).alias("total"))
    return wide.withColumn("actionable", F.round(1 - F.col("unknown_needs_review") / F.col("total"), 4))


def worklist(datasets: DataFrame, grid: DataFrame, base: dict[str, int]) -> DataFrame:
    """Unknown cells with a priority: the dimension's base, +5 for a named source, kept within 1..100."""
    priority = F.coalesce(*(F.when(F.col("dimension") == d, F.lit(p)) for d, p in base.items()), F.lit(50))
    rows = grid.where(F.col("state") == "unknown_needs_review").join(datasets.select("dataset_id", "source"), "dataset_id")
    return rows.select("dataset_id", "source", "dimension", F.least(F.lit(100), F.greatest(F.lit(1), priority + F.when(F.col("source").isNotNull(), 5).otherwise(0))).alias("priority"))


def worklist_summary(work: DataFrame, top: int) -> DataFrame:
    """Per source and dimension: items, highest priority and the smallest dataset that has it."""
    s = work.groupBy("source", "dimension").agg(F.count(F.lit(1)).alias("n"), F.max("priority").alias("max_priority"), F.max_by("dataset_id", F.struct("priority", -F.col("dataset_id"))).alias("first_dataset"))
    return s.orderBy(F.col("max_priority").desc(), F.col("n").desc(), "source", "dimension").limit(top)


def coverage_plan(vocabulary: DataFrame, corpus: DataFrame, benchmark: DataFrame, corpus_target: int = 3, benchmark_target: int = 2) -> DataFrame:
    """Vocabulary values short of datasets or queries: score 2 * gap in the corpus + gap in the benchmark, and its class."""
    c = corpus.groupBy("value").agg(F.countDistinct("id").alias("corpus"))
    b = benchmark.groupBy("value").agg(F.countDistinct("id").alias("queries"))
    rows = vocabulary.join(c, "value", "left").join(b, "value", "left").fillna(0, ["corpus", "queries"])
    score = 2 * F.greatest(F.lit(0), corpus_target - F.col("corpus")) + F.greatest(F.lit(0), benchmark_target - F.col("queries"))
    rows = rows.withColumn("score", score).where("score > 0")
    return rows.withColumn("class", F.when(F.col("score") >= 6, "critical").when(F.col("score") >= 3, "high").otherwise("medium"))


def with_subtotals(entries: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Datasets by dimension and value with a subtotal for each dimension and a total (grouping sets)."""
    rows = entries.where(F.col("confidence") >= floor)
    return rows.rollup("dimension", "value").agg(F.countDistinct("dataset_id").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def first_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")
