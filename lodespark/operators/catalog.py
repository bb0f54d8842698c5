"""Filters, constraint checks and scores over catalogue records, and pairs and sets of records.

Records are rows with scalars and string arrays. A filter or score is a column expression, so it stays in the scan's
stage. Features of their pairs are made by ``pairing``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodespark.functions import sets as A, text as T

#: Weights of a record's heads against a query, and what a record loses.
HEADS = {"ontology": 0.28, "behavior": 0.20, "modality": 0.12, "affordance": 0.10, "metadata": 0.10, "semantic": 0.08, "readiness": 0.08, "paper": 0.04}
MISMATCH, MISSING, EXCLUDED = 0.18, 0.04, 0.5
#: Heads that are zero when the query does not ask for them.
ONLY_WHEN_ASKED = ("ontology", "behavior", "affordance")


def _named(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{name}:"), v))


# -- filters ----------------------------------------------------------------------------------------------------------


def passes(filters: dict[str, object], schema: dict[str, str]) -> Column:
    """One predicate of a filter map: a list wants a shared value, a scalar equality, both after normalising; ``min_x`` wants x at or above. Null never passes."""
    tests = [F.lit(True)]
    for name, wanted in filters.items():
        if name.startswith("min_"):
            tests.append(F.col(name[4:]) >= F.lit(wanted))
            continue
        is_array = schema[name].startswith("array")
        own = F.transform(F.col(name), T.normalize) if is_array else T.normalize(F.col(name).cast("string"))
        if isinstance(wanted, list):
            asked = F.array(*(T.normalize(F.lit(str(w))) for w in wanted))
            tests.append(F.arrays_overlap(own if is_array else F.array(own), asked))
        else:
            tests.append(own == T.normalize(F.lit(str(wanted))))
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def violations(excluded: dict[str, list[str]]) -> Column:
    """Sorted distinct ``field:value`` of the excluded values that a record has; empty when it has none."""

    def of(c: str, values: list[str]) -> Column:
        own = F.coalesce(F.transform(F.col(c), T.normalize), F.array().cast("array<string>"))
        return _named(c, F.array_intersect(own, F.array(*(T.normalize(F.lit(v)) for v in values))))

    return F.array_sort(F.array_distinct(F.concat(*(of(c, values) for c, values in excluded.items()))))


def paper_filter(min_year: int | None = None, max_year: int | None = None, min_citations: int | None = None, venues: list[str] | None = None) -> Column:
    """Bounds on year and citations and any of the venues; a null year fails a bound on it, null citations count as none."""
    tests = [F.lit(True)]
    tests += [F.col("year") >= min_year] if min_year is not None else []
    tests += [F.col("year") <= max_year] if max_year is not None else []
    tests += [F.coalesce("citations", F.lit(0)) >= min_citations] if min_citations is not None else []
    tests += [T.normalize(F.col("venue")).isin(*(T.normalize(F.lit(v)) for v in venues))] if venues else []
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def finding_filter(regions: list[str] | None = None, tasks: list[str] | None = None, directions: list[str] | None = None) -> Column:
    """Any of the regions, any of the tasks, any of the directions; what is not asked for is free."""
    tests = [F.lit(True)]
    tests += [F.arrays_overlap("regions", F.array(*map(F.lit, regions)))] if regions else []
    tests += [F.col("task").isin(*tasks)] if tasks else []
    tests += [F.col("direction").isin(*directions)] if directions else []
    return reduce(lambda a, b: a & b, tests)


def triple_pattern(claims: DataFrame, subject: str | None = None, predicate: str | None = None, target: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    """Claims (src, etype, dst, confidence) that match a pattern of fixed places; a null confidence counts as 0."""
    for name, wanted in (("src", subject), ("etype", predicate), ("dst", target)):
        claims = claims.where(F.col(name) == wanted) if wanted is not None else claims
    return claims.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)


def label_search(nodes: DataFrame, part: str, kind: str | None, limit: int) -> DataFrame:
    """The first ``limit`` nodes by id whose label holds the text, case ignored, of a kind if given."""
    hit = nodes.where(F.lower("label").contains(part.lower()))
    return (hit.where(F.col("kind") == kind) if kind else hit).orderBy("node").limit(limit)


def gate(tests: list[tuple[str, Column]]) -> Column:
    """The name of the first test that does not hold (null does not), else ``ok``."""
    out = None
    for name, holds in tests:
        miss = ~F.coalesce(holds, F.lit(False))
        out = F.when(miss, name) if out is None else out.when(miss, name)
    return out.otherwise("ok")


def first_mapped(values: Column, levels: dict[str, str]) -> Column:
    """The level of the first value, in the array's order, that has one; null if none has."""
    table = F.create_map(*(F.lit(x) for kv in levels.items() for x in kv))
    return F.get(F.filter(F.transform(values, lambda v: F.element_at(table, v)), lambda v: v.isNotNull()), F.lit(0))


def completeness(columns: dict[str, str]) -> Column:
    """Share of the columns with a value: not null, not an empty text or array."""
    filled = [(F.coalesce(F.size(c) > 0, F.lit(False)) if kind.startswith("array") else F.coalesce(F.col(c).cast("string") != "", F.lit(False))).cast("int") for c, kind in columns.items()]
    return reduce(lambda a, b: a + b, filled) / F.lit(len(filled))


def missing_fields(columns: dict[str, str]) -> Column:
    """Names of the columns without a value, in the order given."""
    holes = [F.when(~(F.coalesce(F.size(c) > 0, F.lit(False)) if kind.startswith("array") else F.coalesce(F.col(c).cast("string") != "", F.lit(False))), F.lit(c)) for c, kind in columns.items()]
    return F.array_compact(F.array(*holes))


# -- scores of one record -----------------------------------------------------------------------------------------------


def head_scores(asked: dict[str, list[str]]) -> dict[str, Column]:
    """Share of each head's asked values that a record has (column of the head's name); nothing asked: half if it has any, and none for the heads that must be asked for."""
    out = {}
    for head, values in asked.items():
        if not values and head in ONLY_WHEN_ASKED:
            out[head] = F.lit(0.0)
        else:
            out[head] = A.field_score(F.array(*map(F.lit, values)).cast("array<string>"), F.col(head))
    return out


def paper_score(papers: Column) -> Column:
    """Three different linked papers are full marks."""
    return F.least(F.size(F.array_distinct(F.coalesce(papers, F.array().cast("array<string>")))) / 3, F.lit(1.0))


def record_score(heads: dict[str, Column], mismatch: Column, missing: Column, excluded: Column, boost: Column | None = None) -> Column:
    """Weighted heads and boost, less a penalty for the wrong modality, for up to five missing fields and for an exclusion; 0 to 100."""
    total = reduce(lambda a, b: a + b, (F.lit(HEADS[k]) * v for k, v in heads.items()), boost if boost is not None else F.lit(0.0))
    total = total - F.when(mismatch, MISMATCH).otherwise(0.0) - MISSING * F.least(missing, F.lit(5)) - F.when(excluded, EXCLUDED).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)) * 100, 2)


def hybrid_score(sparse: list[Column], dense: list[Column], how: str = "weighted", weight: float = 0.6) -> Column:
    """Sparse and dense parts, each summed to 1 at most, fused by weight, by the larger, or by reciprocal pseudo-ranks."""
    cap = lambda parts: F.least(F.lit(1.0), reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts)))
    s, d = cap(sparse), cap(dense)
    if how == "max":
        out = F.greatest(s, d)
    elif how == "rrf":
        out = 1 / (60 + 1 / (s + 0.01)) + 1 / (60 + 1 / (d + 0.01))
    else:
        out = weight * s + (1 - weight) * d
    return F.round(out, 4)


def bonus_rerank(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): score + 0.05 for linked papers + 0.03 for an identifier + 0.02 * satisfaction, within 0 and 1; the best k."""
    total = F.col("score") + F.when(F.col("has_papers"), 0.05).otherwise(0.0) + F.when(F.col("has_id"), 0.03).otherwise(0.0) + 0.02 * F.col("satisfaction")
    rows = scored.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def graph_bonus(base: Column, graph: Column, concept: Column, region: Column, annotated: Column, weight: float = 0.05) -> Column:
    """Base score + weight * (graph, only for annotated queries, + concept + region up to 0.6)."""
    return F.round(base + weight * (F.when(annotated, graph).otherwise(0.0) + concept + F.least(region, F.lit(0.6))), 6)


def source_grade(profile: Column, matched: Column, missing: Column, has_id: Column, has_url: Column) -> Column:
    """Reliability of a source's profile (0.4 if unknown), + 0.05 for a matched standard, - 0.08 for missing fields, - 0.08 without id, - 0.04 without address."""
    off = lambda c, x: F.when(c, x).otherwise(0.0)
    total = F.coalesce(profile, F.lit(0.4)) + off(matched, 0.05) - off(missing, 0.08) - off(~has_id, 0.08) - off(~has_url, 0.04)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 3)


# -- sets of records ------------------------------------------------------------------------------------------------------


def set_scores(members: DataFrame, required: list[str], hard: list[str]) -> DataFrame:
    """One row for each set of (set_id, item, usefulness, kinds, traits): its usefulness as a whole.

    Mean usefulness + 0.1 coverage of the required kinds + 0.1 share of traits that one member alone brings
    - 0.15 share of members whose kinds another already has - 0.05 share without kinds - 0.3 share with a hard negative;
    every member has an id, which adds the full 0.1 of provenance. Without required kinds coverage is 0.
    """
    base = members.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("usefulness").alias("mean"), F.count_if(F.size("kinds") == 0).alias("bare"),
        F.count_if(F.arrays_overlap("kinds", F.array(*map(F.lit, hard)))).alias("hard"), F.countDistinct(F.array_sort("kinds")).alias("signatures"),
    )
    kinds = members.select("set_id", F.explode("kinds").alias("kind")).where(F.col("kind").isin(*required)).groupBy("set_id").agg(F.countDistinct("kind").alias("met"))
    traits = members.select("set_id", "item", F.explode(F.array_distinct("traits")).alias("trait")).groupBy("set_id", "trait").agg(F.count(F.lit(1)).alias("k"))
    traits = traits.groupBy("set_id").agg(F.count(F.lit(1)).alias("all_traits"), F.count_if(F.col("k") == 1).alias("own_traits"))
    rows = base.join(kinds, "set_id", "left").join(traits, "set_id", "left").fillna(0, ["met", "all_traits", "own_traits"])
    share = lambda c: F.col(c) / F.col("n")
    parts = {
        "mean": F.col("mean"), "coverage": F.col("met") / max(1, len(required)), "complement": F.when(F.col("all_traits") > 0, F.col("own_traits") / F.col("all_traits")).otherwise(0.0),
        "redundancy": (F.col("n") - F.col("signatures")) / F.col("n"), "bare": share("bare"), "hard": share("hard"),
    }
    total = parts["mean"] + 0.1 * parts["coverage"] + 0.1 * parts["complement"] + 0.1 - 0.15 * parts["redundancy"] - 0.05 * parts["bare"] - 0.3 * parts["hard"]
    total = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6)
    return rows.select("set_id", F.col("n").alias("items"), *(F.round(v, 4).alias(k) for k, v in parts.items()), total.alias("score"))


# -- pairs of records -----------------------------------------------------------------------------------------------------


def pair_type(rows: DataFrame) -> DataFrame:
    """Adds the kind of a pair (the first rule that holds) and its score, linear in the features."""
    x = F.col
    kind = (
        F.when((x("task") > 0.5) & (x("region") < 0.3), "same_task_different_region").when((x("task") > 0.5) & (x("species") < 0.3), "same_task_different_species")
        .when((x("modality") > 0.5) & (x("task") < 0.3), "same_modality_different_task").when(x("affordance") > 0.3, "shared_affordance")
        .when((x("task") > 0.3) & (x("modality") < 0.3), "complementary_modalities").otherwise("general_similarity")
    )
    score = 0.25 * x("task") + 0.15 * x("modality") + 0.10 * x("species") + 0.15 * x("region") + 0.10 * x("event") + 0.15 * x("affordance") + 0.05 + F.when(x("far"), 0.1).otherwise(0.0) - F.when(x("clash"), 0.1).otherwise(0.0)
    return rows.withColumn("kind", kind).withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6))


def best_per_kind(pairs: DataFrame, k: int, least: float) -> DataFrame:
    """Of each record and kind the best k partners that reach ``least``; ties by id."""
    order = Window.partitionBy("a", "kind").orderBy(F.col("score").desc(), "b")
    return pairs.where(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("a", "b", "kind", "score", "rank")
