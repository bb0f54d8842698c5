"""Fusion, diversity, windows and feedback queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lodespark.operators import fusion as U
from lodespark.sources import tables as S

W = f"WITH {S.RUNS}"
TOP = "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20"
NORM = "m AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm, count(*) OVER w AS n FROM runs WINDOW w AS (PARTITION BY system, query_id))"
WEIGHT = "(CASE system WHEN 'cos' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)"
WEIGHTS = {"cos": 2.0, "head": 1.0}


def _transitions(spark, d):
    """Share of each event type after another within a user's sequence."""
    e = S.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    g = e.withColumn("next_type", after).where("next_type IS NOT NULL").groupBy("event_type", "next_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6))


def _histogram(spark, d):
    """Normalised histogram of event types for each user."""
    e = S.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 6))


def _priors(spark, d):
    """Feedback priors by item (the number in props): purchases useful, clicks partly, errors against; log-odds within 1.5."""
    e = S.table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("item"), "event_type")
    g = e.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("useful"), F.count_if(F.col("event_type") == "click").alias("partial"), F.count_if(F.col("event_type") == "error").alias("wrong"))
    rate = (F.col("useful") + 0.5 * F.col("partial") + 0.5) / (F.col("n") + 1)
    odds = F.least(F.lit(1.5), F.greatest(F.lit(-1.5), F.ln(rate / (1 - rate))))
    return g.where("n >= 2").select("item", "n", F.round(rate, 6).alias("rate"), F.round(odds - 0.1 * F.col("wrong"), 6).alias("prior"))


def _sessions(spark, d):
    """Sessions of a user: a gap of 30 minutes ends one."""
    e = S.table(spark, d, "events").select("user_id", "ts")
    g = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _tumbling(spark, d):
    e = S.table(spark, d, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _asof(spark, d):
    """The latest click of the same user before each purchase: an as-of join as one window over the union."""
    e = S.table(spark, d, "events").where("event_type IN ('click', 'purchase')").select("event_id", "user_id", "ts", "event_type", "value")
    upto = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "purchase").cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(upto)
    return e.withColumn("click_id", click).where("event_type = 'purchase'").select("event_id", "user_id", "click_id")


def _snapshot(spark, d):
    """Difference of two snapshots of the documents: the later lacks the first source and has another third of texts."""
    docs = S.table(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"), "source")
    old = docs.where("source <> 'src1'").select("doc_id", F.col("hash").alias("old"))
    new = docs.where("source <> 'src0'").select("doc_id", F.when(F.col("source") == "src2", F.md5("hash")).otherwise(F.col("hash")).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "missing").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return old.join(new, "doc_id", "full_outer").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _rules(spark, d):
    """Decision lists on orders: access tier, and levels that apply, sorted."""
    o = S.table(spark, d, "orders")
    tier = F.when(F.col("o_orderstatus") == "P", "controlled").when(F.col("o_orderpriority").startswith("1"), "restricted").when(F.col("o_totalprice") > 100000, "registered").otherwise("open")
    level = lambda c, n: F.when(c, F.lit(n))
    levels = F.array_sort(F.array_compact(F.array(level(F.col("o_totalprice") > 50000, "trial"), level(F.year("o_orderdate") >= 1998, "session"), level(F.col("o_orderpriority").rlike("^[12]"), "event"))))
    g = o.select(tier.alias("tier"), F.when(F.size(levels) > 0, F.array_join(levels, ",")).otherwise("unspecified").alias("levels"))
    return g.groupBy("tier", "levels").agg(F.count(F.lit(1)).alias("n"))


def _readiness(spark, d):
    """Additive 0-100 checklist on records."""
    r = S.records(spark, d)
    checks = [(F.size("brands") > 0, 20), (F.size("types") > 0, 15), (F.size("brands") >= 10, 15), (F.col("balance") > 0, 10), (F.col("source").isNotNull(), 10), (F.size("types") >= 4, 10), (F.col("nation") < 10, 10), (F.col("balance") > 5000, 5), (F.length("title") > 0, 5)]
    return r.select("dataset_id", sum((F.when(c, p).otherwise(0) for c, p in checks[1:]), F.when(checks[0][0], checks[0][1]).otherwise(0)).alias("readiness"))


def _roles(spark, d):
    """Role of every record against the anchor, the one with most brands (ties by id)."""
    from lodespark.functions import sets as A

    r = S.records(spark, d).select("dataset_id", "source", "brands", "types")
    anchor = r.orderBy(F.size("brands").desc(), "dataset_id").limit(1).select(F.col("dataset_id").alias("anchor_id"), F.col("source").alias("anchor_source"), F.col("brands").alias("anchor_brands"))
    j = r.crossJoin(anchor)  # one row
    sim = A.jaccard(F.col("brands"), F.col("anchor_brands"))
    role = F.when(F.col("dataset_id") == F.col("anchor_id"), "anchor").when((sim >= 0.8) & (F.col("source") == F.col("anchor_source")), "replication").when(sim >= 0.8, "generalisation").when((sim < 0.3) & (F.size("types") >= 4), "contrast").when(F.size("brands") == 0, "empty").otherwise("supporting")
    return j.select("dataset_id", role.alias("role"), F.round(sim, 6).alias("similarity"))


def _negation(spark, d):
    """Documents whose normalised text has a wanted phrase and none of the unwanted."""
    from lodespark.functions import text as T

    docs = S.table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("n"))
    return docs.where(T.contains_phrase(F.col("n"), "all rights reserved") & ~T.contains_phrase(F.col("n"), "the the") & ~F.col("n").contains("gmail")).select("doc_id")


RECORDS = f"WITH {S.RECORDS}"
SIM = "(len(list_intersect(brands, ab)) / (len(brands) + len(ab) - len(list_intersect(brands, ab))))"

QUERIES = {
    "rrf_fusion": (lambda s, d: U.rrf(S.runs(s, d), WEIGHTS, top=20), f"{W}, s AS (SELECT query_id, doc_id, round(sum({WEIGHT} / (60 + rank)), 9) AS score FROM runs GROUP BY ALL) {TOP}"),
    "weighted_sum_fusion": (lambda s, d: U.weighted_sum(S.runs(s, d), WEIGHTS, top=20), f"{W}, {NORM}, s AS (SELECT query_id, doc_id, round(sum({WEIGHT} / 3 * norm), 9) AS score FROM m GROUP BY ALL) {TOP}"),
    "borda_fusion": (lambda s, d: U.borda(S.runs(s, d), WEIGHTS, top=20), f"{W}, {NORM}, s AS (SELECT query_id, doc_id, round(sum({WEIGHT} * (n - rank + 1)), 9) AS score FROM m GROUP BY ALL) {TOP}"),
    "combmnz_fusion": (lambda s, d: U.combmnz(S.runs(s, d), WEIGHTS, top=20), f"{W}, {NORM}, s AS (SELECT query_id, doc_id, round(sum({WEIGHT} * norm) * count(*), 9) AS score FROM m GROUP BY ALL) {TOP}"),
    "fusion_explain": (lambda s, d: U.explain(S.runs(s, d)), f"{W} SELECT query_id, doc_id, system, round(1 / (60 + rank), 6) AS part FROM runs"),
    "component_mean": (lambda s, d: U.component_mean(S.runs(s, d), WEIGHTS), f"{W} SELECT query_id, doc_id, round(sum({WEIGHT} * score) / sum({WEIGHT}), 9) AS score, least(count(DISTINCT system) / 4, 1) AS confidence FROM runs GROUP BY ALL"),
    "latent_hybrid": (
        lambda s, d: U.hybrid(S.runs(s, d, systems=("cos",)).select("query_id", "doc_id", "score"), S.runs(s, d, systems=("head",)).select("query_id", "doc_id", "score"), 0.3, top=20),
        f"{W}, s AS (SELECT query_id, doc_id, round(0.7::DOUBLE * coalesce(sum(score) FILTER (system = 'cos'), 0) + 0.3::DOUBLE * coalesce(sum(score) FILTER (system = 'head'), 0), 9) AS score FROM runs GROUP BY ALL) {TOP}",
    ),
    "pooled_candidates": (lambda s, d: U.pooled(S.runs(s, d), 20), f"{W} SELECT query_id, doc_id, count(DISTINCT system) AS n_systems, string_agg(DISTINCT system, ',' ORDER BY system) AS systems, min(rank) AS best_rank, max(score) AS best_score FROM runs WHERE rank <= 20 GROUP BY ALL"),
    "transition_shares": (_transitions, "WITH t AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events), g AS (SELECT event_type, next_type, count(*) AS n FROM t WHERE next_type IS NOT NULL GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY event_type), 6) AS share FROM g"),
    "event_histogram": (_histogram, "SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY user_id, event_type"),
    "feedback_priors": (
        _priors,
        """WITH g AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS useful, count(*) FILTER (event_type = 'click') AS part, count(*) FILTER (event_type = 'error') AS wrong FROM events GROUP BY 1),
        r AS (SELECT *, (useful + 0.5::DOUBLE * part + 0.5::DOUBLE) / (n + 1) AS rate FROM g WHERE n >= 2) SELECT item, n, round(rate, 6) AS rate, round(least(1.5::DOUBLE, greatest(-1.5::DOUBLE, ln(rate / (1 - rate)))) - 0.1::DOUBLE * wrong, 6) AS prior FROM r""",
    ),
    "session_windows": (
        _sessions,
        """WITH t AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM t)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end, count(*) AS n FROM g GROUP BY user_id, k""",
    ),
    "tumbling_windows": (_tumbling, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "asof_click": (_asof, "SELECT p.event_id, p.user_id, arg_max(c.event_id, (c.ts, c.event_id)) AS click_id FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id, p.user_id"),
    "snapshot_diff": (
        _snapshot,
        """WITH o AS (SELECT doc_id, md5(text) AS old FROM documents WHERE source <> 'src1'), n AS (SELECT doc_id, CASE source WHEN 'src2' THEN md5(md5(text)) ELSE md5(text) END AS new FROM documents WHERE source <> 'src0')
        SELECT CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'missing' WHEN old <> new THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM o FULL JOIN n USING (doc_id) GROUP BY 1""",
    ),
    "decision_lists": (
        _rules,
        """WITH r AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'controlled' WHEN starts_with(o_orderpriority, '1') THEN 'restricted' WHEN o_totalprice > 100000 THEN 'registered' ELSE 'open' END AS tier,
        array_to_string(list_sort(list_filter([CASE WHEN o_totalprice > 50000 THEN 'trial' END, CASE WHEN year(o_orderdate) >= 1998 THEN 'session' END, CASE WHEN regexp_matches(o_orderpriority, '^[12]') THEN 'event' END], lambda x: x IS NOT NULL)), ',') AS l FROM orders)
        SELECT tier, CASE l WHEN '' THEN 'unspecified' ELSE l END AS levels, count(*) AS n FROM r GROUP BY ALL""",
    ),
    "readiness": (
        _readiness,
        f"""{RECORDS} SELECT dataset_id, (CASE WHEN len(brands) > 0 THEN 20 ELSE 0 END + CASE WHEN len(types) > 0 THEN 15 ELSE 0 END + CASE WHEN len(brands) >= 10 THEN 15 ELSE 0 END + CASE WHEN balance > 0 THEN 10 ELSE 0 END + CASE WHEN source IS NOT NULL THEN 10 ELSE 0 END
        + CASE WHEN len(types) >= 4 THEN 10 ELSE 0 END + CASE WHEN nation < 10 THEN 10 ELSE 0 END + CASE WHEN balance > 5000 THEN 5 ELSE 0 END + CASE WHEN length(title) > 0 THEN 5 ELSE 0 END) AS readiness FROM records""",
    ),
    "role_assignment": (
        _roles,
        f"""{RECORDS}, a AS (SELECT dataset_id AS aid, source AS asrc, brands AS ab FROM records ORDER BY len(brands) DESC, dataset_id LIMIT 1)
        SELECT dataset_id, CASE WHEN dataset_id = aid THEN 'anchor' WHEN {SIM} >= 0.8 AND source = asrc THEN 'replication' WHEN {SIM} >= 0.8 THEN 'generalisation' WHEN {SIM} < 0.3 AND len(types) >= 4 THEN 'contrast' WHEN len(brands) = 0 THEN 'empty' ELSE 'supporting' END AS role, round({SIM}, 6) AS similarity FROM records, a""",
    ),
    "negation_filter": (
        _negation,
        "WITH n AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[/_-]+', ' ', 'g'), '[^a-z0-9+]+', ' ', 'g')) || ' ' AS n FROM documents) SELECT doc_id FROM n WHERE contains(n, ' all rights reserved ') AND NOT contains(n, ' the the ') AND NOT contains(n, 'gmail')",
    ),
}
