"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

Every document of a source is wanted ``target / source size`` times. The whole part of that number is allocated as
certain copies. The rest is an inclusion probability p, and documents are ranked by the odds of a uniform number that
only depends on seed and id, divided by the odds of p (Rosén's Pareto order); the source takes documents in that order
until its remaining words are met exactly, the last one in part. No window ever orders a whole source: sums over 1024
ranges of the rank find the range that holds the boundary, and only that range is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodespark.llm.common import WORD, cut

#: No document is taken more than this many times, so no source gets more than this many times its size.
MAX_REPEATS = 3
#: Ranges of the rank over which a source's words are summed.
RANGES = 1024


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on seed and key only (52 bits of their MD5)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) of (source, size) rows.

    Sources in order of code points, null last, get the weights in turn and share all words; a target stops at
    MAX_REPEATS times its source's size, and the excess is shared again by weight. With every source's cap / weight in
    order, the caps bind for a prefix; the level of the rest follows from two running sums. Past the first source that its
    cap does not bind these sums only fall, so its level is the largest of those that keep within their caps.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.lit(float(MAX_REPEATS)) * F.col("source_size"))
    order, whole = Window.orderBy(F.col("cap") / F.col("weight"), "at"), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("left") / F.col("rest") <= F.col("cap") / F.col("weight"), F.col("left") / F.col("rest"))).over(whole)
    return s.withColumn("level", level).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """(id, source, size, source_size, target, taken): the words that the mix takes of each document.

    ``taken`` is copies * size, but for the one document of a source at the boundary, which is taken in part. Documents
    without words take none. Null texts are empty, null is a source of its own (the last), documents with a null id
    share one random number; ties of the rank go by id. Repeated rows are documents of their own with the same rank:
    they are taken together, and one of them may be the boundary. A table without words has targets of 0.
    """
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")))
    targets = source_targets(sized.select("source", "size"), weights)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("copies", F.floor(wanted)).withColumn("p", wanted - F.col("copies"))
    plan = plan.withColumn("remain", F.floor(F.col("target") + 0.5) - F.col("copies") * F.col("source_size"))
    plan = plan.withColumnRenamed("source", "s")
    u = uniform(F.col("id"), seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("q", F.when(F.col("p") > 0, odds))
    ranked = ranked.withColumn("range", F.when(F.col("p") > 0, F.floor(F.col("q") / (1 + F.col("q")) * RANGES)).otherwise(F.lit(0)))
    sums = ranked.groupBy("s", "range", "remain").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("s").orderBy("range")
    edge = (
        sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .where((F.col("before") < F.col("remain")) & (F.col("before") + F.col("words") >= F.col("remain")))
        .select(F.col("s").alias("es"), F.col("range").alias("edge"), "before")
    )
    ranked = ranked.join(edge, F.col("s").eqNullSafe(F.col("es")), "left")
    base = F.col("copies") * F.col("size")
    out = [F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target"]
    # without an edge a source has nothing left to take, or not enough words to take it from
    clear = ranked.where(F.col("edge").isNull() | (F.col("range") != F.col("edge")))
    first = F.when(F.col("edge").isNotNull(), F.col("range") < F.col("edge")).otherwise(F.col("remain") > 0)
    clear = clear.select(*out, (base + F.when(first & (F.col("p") > 0), F.col("size")).otherwise(0)).cast("bigint").alias("taken"))
    within = Window.partitionBy("s", "range").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edged = ranked.where(F.col("range") == F.col("edge")).withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("remain") - F.col("so_far")))
    return clear.unionByName(edged.select(*out, (base + part).cast("bigint").alias("taken")))
