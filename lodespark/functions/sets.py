"""Column functions on arrays as sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the union; 0 when both or one are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared over the sum of sizes (distinct values); 0 when both are empty."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared over the smaller set; 0 when one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def field_score(asked: Column, has: Column) -> Column:
    """Share of the asked values that a record has; nothing asked: 0.5 if it has any, else 0."""
    n = F.size(F.array_distinct(asked))
    return F.when(n > 0, F.size(F.array_intersect(asked, has)) / n).when(F.size(has) > 0, F.lit(0.5)).otherwise(F.lit(0.0))


def complementarity(a: Column, b: Column) -> Column:
    """0.7 * unique share + 0.3 * overlap of the union, or 0.3 * unique share when disjoint."""
    union, both = F.size(F.array_union(a, b)), F.size(F.array_intersect(a, b))
    unique, shared = (union - both) / union, both / union
    return F.when(union == 0, F.lit(0.0)).when(both == 0, 0.3 * unique).otherwise(0.7 * unique + 0.3 * shared)
