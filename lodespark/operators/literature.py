"""Findings and claims: consensus, contradictions, co-occurrence, linking, deduplication, timelines.

Self-joins are hash joins on a bucket key with the rest as a residual; pairs are counted or reduced to one row before
they go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodespark.operators import edits

#: Pairs of directions that contradict each other.
OPPOSITE = (("increase", "decrease"), ("increase", "none"), ("decrease", "none"))
#: Findings of a block, those held against it at a time, and regions of a product of matrices.
BLOCK, TILE, WIDE = 8192, 32, 1024


def consensus(findings: DataFrame, min_papers: int) -> DataFrame:
    """Per (region, task, direction): papers, findings and strength, the direction's share of the (region, task)."""
    rows = findings.select("finding_id", "paper_id", "task", "direction", F.explode("regions").alias("region"))
    g = rows.groupBy("region", "task", "direction").agg(F.countDistinct("paper_id").alias("papers"), F.count(F.lit(1)).alias("findings"))
    all_dirs = F.sum("findings").over(Window.partitionBy("region", "task"))
    g = g.withColumn("strength", F.round(F.col("findings") / all_dirs, 6))
    return g.where((F.col("papers") >= min_papers) & (F.col("direction") != "other"))


def qualified_consensus(findings: DataFrame, qualifiers: dict[str, Column], min_papers: int) -> DataFrame:
    """The same with one further qualifier at a time: grouping sets over the qualifiers, from one pass."""
    rows = findings.select("finding_id", "paper_id", "direction", F.element_at("regions", 1).alias("region"), *(c.cast("string").alias(n) for n, c in qualifiers.items()))
    sets = [[F.col("region"), F.col("direction"), F.col(n)] for n in qualifiers]
    g = rows.groupingSets(sets, "region", "direction", *qualifiers).agg(F.countDistinct("paper_id").alias("papers"), F.grouping_id().alias("gid"))
    name = F.coalesce(*(F.when(F.bit_get(F.col("gid"), F.lit(len(qualifiers) - 1 - k)) == 0, F.lit(n)) for k, n in enumerate(qualifiers)))
    return g.select("region", "direction", name.alias("qualifier"), F.coalesce(*qualifiers).alias("value"), "papers").where(F.col("papers") >= min_papers)


def cooccurrence(findings: DataFrame, least: int) -> DataFrame:
    """Unordered pairs of regions named together: count and confidence min(0.5 + 0.02 n, 0.95)."""
    pairs = findings.select(F.explode("regions").alias("a"), "regions").select("a", F.explode("regions").alias("b")).where("a < b")
    g = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return g.withColumn("confidence", F.round(F.least(F.lit(0.95), 0.5 + 0.02 * F.col("n")), 6))


def _relation(da: Column, db: Column, negated: Column) -> Column:
    """Equal directions support, opposite ones contradict, or refute if one finding is negated; else null."""
    opposite = F.array_sort(F.array(da, db)).isin(*(F.array(*map(F.lit, sorted(p))) for p in OPPOSITE))
    return F.when((da == db) & ~da.isin("other", "correlation") & ~negated, "supports").when(opposite & ~negated, "contradicts").when(opposite, "direct_refutation")


def cross_finding_edges(findings: DataFrame, queries: DataFrame | None = None, min_regions: int = 1) -> DataFrame:
    """(a, b, relation, n_regions, confidence): findings of different papers on one task that share regions.

    Equal directions support, opposite ones contradict, unless one is negated. Findings of a task meet in blocks, and
    a task counts the shared regions of a block's pairs as a product of matrices, so no row is made for a pair without
    an edge, nor for each region of one. Edges grow with the square of a task. With ``queries``, some of the findings,
    a is one of these, which go to every task, and b any other; without, every pair is one row with a < b. Rows that share a finding_id are
    added up. ``relation_counts`` has their numbers without the pairs.
    """
    names = ("finding_id", "paper_id", "direction", "negated", "regions")
    sizes = findings.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    several = (sizes["most"] or 0) > 1 or (queries is not None and not queries.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty())
    n_blocks = (sizes["n"] or 0) // BLOCK + 1
    known = lambda t: t.where("finding_id IS NOT NULL AND paper_id IS NOT NULL AND task IS NOT NULL AND direction IS NOT NULL AND size(regions) > 0")
    # a negation that is not known hides support and makes a refutation of a contradiction, as one that is known does
    x = lambda t: F.struct(*(F.coalesce("negated", F.lit(True)).alias(c) if c == "negated" else F.col(c) for c in names))

    def blocks(t: DataFrame, p: str, n: int) -> DataFrame:
        part = F.pmod(F.xxhash64("finding_id"), F.lit(n)).alias(f"{p}_part")
        t = known(t).select("task", part, x(t).alias("finding")).repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task", f"{p}_part")  # small as they are, blocks are work for many tasks
        return t.groupBy("task", f"{p}_part").agg(F.collect_list("finding").alias(p))

    b = blocks(findings, "b", n_blocks)
    if queries is None:
        a = blocks(findings, "a", n_blocks)
        met = a.withColumn("b_part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>"))).join(b, ["task", "b_part"])
    else:  # blocks of queries go to every task, which has them meet as they are read: no pair of blocks is shuffled
        met = b.join(F.broadcast(blocks(queries, "a", n_blocks // 64 + 1)), "task")
    schema = f"a {findings.schema['finding_id'].dataType.simpleString()}, b {findings.schema['finding_id'].dataType.simpleString()}, code int, n_regions bigint"
    g = met.select("a", "b").mapInArrow(_shared_regions(queries is None), schema)
    if several:
        g = g.groupBy("a", "b").agg(F.sum("n_regions").alias("n_regions"), F.max("code").alias("code"))
    confidence = F.least(F.when(F.col("code") == 0, F.lit(0.95)).otherwise(F.lit(0.9)), 0.6 + 0.1 * F.col("n_regions"))
    named = F.when(F.col("code") == 0, "supports").when(F.col("code") == 1, "contradicts").otherwise("direct_refutation")
    return g.where(F.col("n_regions") >= min_regions).select("a", "b", named.alias("relation"), "n_regions", F.round(confidence, 6).alias("confidence"))


def _shared_regions(ordered: bool):
    """Pairs of blocks (a, b) of findings as edges (a, b, code, n_regions): 0 supports, 1 contradicts, 2 refutes."""

    def block(row: pa.Array, regions: pa.Array, papers: pa.Array) -> tuple:
        ids, _, direction, negated, lists = row.flatten()
        of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        region = pc.index_in(lists.flatten(), regions).fill_null(-1).to_numpy(zero_copy_only=False)
        named = region >= 0
        kind = pc.index_in(direction, pa.array(["increase", "decrease", "none"])).fill_null(-1).to_numpy(zero_copy_only=False)
        return ids, pc.index_in(row.field(1), papers).to_numpy(zero_copy_only=False), direction, kind, negated.to_numpy(zero_copy_only=False), of[named], region[named]

    def counted(of: np.ndarray, region: np.ndarray, start: int, stop: int, low: int, high: int) -> np.ndarray:
        """How often each of some regions stands in each finding of start..stop."""
        first, last = np.searchsorted(of, (start, stop))
        ok = (region[first:last] >= low) & (region[first:last] < high)
        at = (of[first:last][ok] - start) * (high - low) + region[first:last][ok] - low
        return np.bincount(at, minlength=(stop - start) * (high - low)).reshape(stop - start, high - low).astype(np.float32)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                x, y = (batch.column(c).slice(k, 1).flatten() for c in ("a", "b"))
                # only regions that both blocks have can be shared; null ones are shared with nothing
                regions = pc.unique(x.field(4).flatten())
                regions = regions.filter(pc.and_(pc.is_in(regions, pc.unique(y.field(4).flatten())), pc.is_valid(regions)))
                papers = pc.unique(pa.concat_arrays([x.field(1), y.field(1)]))
                ids, paper, direction, kind, negated, of, region = block(x, regions, papers)
                other, other_paper, other_direction, other_kind, other_negated, other_of, other_region = block(y, regions, papers)
                # directions as numbers, apart from the two that support nothing
                kinds = pc.unique(pa.concat_arrays([direction, other_direction]))
                mute = pa.array(["other", "correlation"])
                number = lambda d, none: np.where(pc.is_in(d, mute).to_numpy(zero_copy_only=False), none, pc.index_in(d, kinds).to_numpy(zero_copy_only=False))  # noqa: E731, B023
                own, its = number(direction, -1), number(other_direction, -2)
                for at in range(0, len(ids), TILE):
                    a = slice(at, min(at + TILE, len(ids)))
                    n = np.zeros((a.stop - a.start, len(other)), np.float32)
                    for low in range(0, len(regions), WIDE):
                        high = min(low + WIDE, len(regions))
                        n += counted(of, region, a.start, a.stop, low, high) @ counted(other_of, other_region, 0, len(other), low, high).T
                    opposite = (kind[a, None] >= 0) & (other_kind >= 0) & (kind[a, None] != other_kind)
                    denied = negated[a, None] | other_negated
                    ok = (n > 0) & (paper[a, None] != other_paper) & (opposite | ((own[a, None] == its) & ~denied))
                    r, c = np.nonzero(ok)
                    code = np.where(opposite[r, c], 1 + denied[r, c], 0).astype(np.int32)
                    left, right = ids.take(pa.array(r + at)), other.take(pa.array(c))
                    found = pa.RecordBatch.from_arrays([left, right, pa.array(code), pa.array(n[r, c].astype(np.int64))], ["a", "b", "code", "n_regions"])
                    yield found.filter(pc.less(left, right) if ordered else pc.not_equal(left, right))

    return edges


def relation_counts(findings: DataFrame) -> DataFrame:
    """(region, task, relation, pairs): how many pairs of findings of different papers support, contradict or refute each other there.

    Counted from how many findings each kind (direction, negated) has, in all and in each paper: no pair is made.
    """
    f = findings.select("paper_id", "task", "direction", "negated", F.explode("regions").alias("region"))
    own = f.groupBy("region", "task", "paper_id", "direction", "negated").agg(F.count(F.lit(1)).alias("n"))
    whole = own.groupBy("region", "task", "direction", "negated").agg(F.sum("n").alias("n"))

    def pairs(t: DataFrame, keys: list[str]) -> DataFrame:
        x, y = (t.select(*keys, F.col("direction").alias(f"{p}d"), F.col("negated").alias(f"{p}g"), F.col("n").alias(f"{p}n")) for p in "xy")
        j = x.join(y, keys).withColumn("relation", _relation(F.col("xd"), F.col("yd"), F.col("xg") | F.col("yg"))).where("relation IS NOT NULL")
        same = (F.col("xd") == F.col("yd")) & (F.col("xg") == F.col("yg"))
        n = F.when(same, F.col("xn") * (F.col("xn") - 1)).otherwise(F.col("xn") * F.col("yn"))  # every pair from both its ends
        return j.groupBy("region", "task", "relation").agg(F.sum(n).alias("n"))

    within = pairs(own, ["region", "task", "paper_id"]).withColumnRenamed("n", "inside")
    out = pairs(whole, ["region", "task"]).join(within, ["region", "task", "relation"], "left")
    return out.select("region", "task", "relation", ((F.col("n") - F.coalesce("inside", F.lit(0))) / 2).cast("bigint").alias("pairs")).where("pairs > 0")


def timeline(findings: DataFrame) -> DataFrame:
    """Per year: findings, papers, and how many tasks and regions appear for the first time."""
    rows = findings.select("year", "finding_id", "paper_id", "task")
    base = rows.groupBy("year").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("paper_id").alias("papers"))
    first_task = rows.groupBy("task").agg(F.min("year").alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("new_tasks"))
    regions = findings.select("year", F.explode("regions").alias("region")).groupBy("region").agg(F.min("year").alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("new_regions"))
    return base.join(first_task, "year", "left").join(regions, "year", "left").fillna(0, ["new_tasks", "new_regions"])


def clusters(findings: DataFrame, least: int) -> DataFrame:
    """Findings with equal regions, direction and task: size, papers, years; the id is a digest of what they share."""
    key = F.concat_ws("|", F.concat_ws(",", "regions"), "direction", "task")
    g = findings.groupBy("regions", "direction", "task").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("paper_id").alias("papers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return g.where(F.col("n") >= least).select(F.substring(F.sha1(key), 1, 16).alias("cluster_id"), "direction", "task", "n", "papers", "first_year", "last_year")


def topic_coverage(findings: DataFrame, n_regions: int) -> DataFrame:
    """Per task: breadth, span and size in one score."""
    f = findings.select("task", "finding_id", "year", F.explode("regions").alias("region"))
    g = f.groupBy("task").agg(F.countDistinct("region").alias("regions"), F.countDistinct("finding_id").alias("findings"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    score = 0.35 * F.col("regions") / n_regions + 0.45 * F.least(F.lit(1.0), (F.col("last_year") - F.col("first_year")) / 20) + 0.2 * F.least(F.lit(1.0), F.col("findings") / 50)
    return g.withColumn("score", F.round(score, 3))


def observed_complement(findings: DataFrame, min_count: int) -> DataFrame:
    """(region, direction) combinations with fewer than ``min_count`` findings, none included."""
    f = findings.select(F.explode("regions").alias("region"), "direction")
    n = f.groupBy("region", "direction").agg(F.count(F.lit(1)).alias("n"))
    grid = f.select("region").distinct().crossJoin(f.select("direction").distinct())  # values x values
    return grid.join(n, ["region", "direction"], "left").fillna(0, ["n"]).where(F.col("n") < min_count)


def duplicates_by_key(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """Marks every row but the first of its key; null keys are never duplicates."""
    w = Window.partitionBy("__key").orderBy(*order)
    return rows.withColumn("__key", key).withColumn("duplicate", F.col("__key").isNotNull() & (F.row_number().over(w) > 1)).drop("__key")


def reanalysis_candidates(evidence: DataFrame, similar: DataFrame, done: DataFrame) -> DataFrame:
    """(dataset, method, confidence): methods that worked on a similar dataset and are not yet evidenced on this one."""
    j = evidence.join(similar, "dataset").select(F.col("other").alias("dataset"), "method", (F.col("confidence") * F.col("similarity")).alias("confidence"))
    return j.groupBy("dataset", "method").agg(F.round(F.max("confidence"), 6).alias("confidence")).join(done, ["dataset", "method"], "left_anti")


def strongest_per_pair(edges: DataFrame) -> DataFrame:
    """Of the edges of an unordered pair the most confident; ties by the smaller finding."""
    e = edges.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b"))
    w = Window.partitionBy("x", "y").orderBy(F.col("confidence").desc(), "finding")
    return e.withColumn("k", F.row_number().over(w)).where("k = 1").select("x", "y", "confidence", "finding")


def token_blocked_matches(left: DataFrame, right: DataFrame, cap: int, threshold: float) -> DataFrame:
    """(id, other, similarity): titles that share a token and whose edit similarity reaches the threshold, which is 0.5 or more.

    Expects (id, title, tokens). Tokens in at most ``cap`` titles are joined on; pairs that share more frequent ones only
    are found by ``edits.near_titles``, in blocks. Similarity is 1 - levenshtein / longer length. Pairs and so time
    grow with the square of the titles where these are alike.
    """
    if threshold < 0.5:
        raise ValueError("titles are matched from a similarity of 0.5")
    known = lambda t: t.where("id IS NOT NULL AND title <> ''")
    left, right = known(left), known(right)
    words = right.select(F.col("id").alias("other"), F.col("title").alias("other_title"), F.explode("tokens").alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumn("rare", F.col("n") <= cap).drop("n")
    spread = lambda t: t.select("id", "title", F.explode("tokens").alias("token")).join(counts, "token")
    rare = spread(left).where("rare").join(words, "token").where(F.col("id") != F.col("other")).select("id", "title", "other", "other_title").distinct()
    rare = rare.select("id", "other", F.levenshtein("title", "other_title").alias("edits"), F.greatest(F.length("title"), F.length("other_title")).alias("longer"))
    several = lambda t: not t.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    listed = lambda t: spread(t).groupBy("id", "title").agg(F.collect_set(F.when(~F.col("rare"), F.col("token"))).alias("words"), F.collect_set(F.when(F.col("rare"), F.col("token"))).alias("others")).where(F.size("words") > 0)
    near = edits.near_titles(listed(left), listed(right), threshold).where(F.col("id") != F.col("other"))
    pairs = rare.unionByName(near).select("id", "other", F.round(1 - F.col("edits") / F.col("longer"), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    return pairs.distinct() if several(left) or several(right) else pairs
