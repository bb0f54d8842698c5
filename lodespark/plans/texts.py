"""Scalar functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.functions import text as T, vectors as V
from lodespark.operators import literature as L
from lodespark.sources import tables as S

NORM = "trim(regexp_replace(regexp_replace(lower({x}), '[/_-]+', ' ', 'g'), '[^a-z0-9+]+', ' ', 'g'))"
STOP = "(" + ", ".join(f"'{w}'" for w in T.TITLE_STOP_WORDS) + ")"


def _reconstruct(spark, d):
    """Benchmark passages from their inverted index: words to positions and back."""
    b = S.table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    index = b.groupBy("item_id", "word").agg(F.collect_list("pos").alias("positions"))
    back = index.select("item_id", "word", F.explode("positions").alias("pos")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return back.select("item_id", F.md5(F.array_join(F.transform("w", lambda x: x["word"]), " ")).alias("digest"))


def _quality_flags(spark, d):
    """Flags of documents by their text."""
    t = F.col("text")
    flag = lambda c, n: F.when(c, F.lit(n))
    flags = F.array_compact(F.array(flag(F.length(t) < 100, "short"), flag(T.contains_phrase(T.normalize(t), "all rights reserved"), "license_line"), flag(t.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), "email"), flag(t.contains("\n"), "multi_line"), flag(F.upper(t) == t, "shouting")))
    return S.table(spark, d, "documents").select("doc_id", F.array_join(flags, ",").alias("flags"))


def _turns(spark, d):
    """Conversations as wholes: turns by role, first and last speaker."""
    c = S.table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"))


QUERIES = {
    "normalize_text": (lambda s, d: S.table(s, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest")), f"SELECT doc_id, md5({NORM.format(x='text')}) AS digest FROM documents"),
    "snake_case": (lambda s, d: S.table(s, d, "part").select("p_partkey", T.snake(F.col("p_name")).alias("slug")), "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part"),
    "title_tokens": (
        lambda s, d: S.table(s, d, "benchmark").select("item_id", F.array_join(T.title_tokens(F.col("text")), " ").alias("tokens")),
        f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split({NORM.format(x='text')}, ' '), lambda w: length(w) >= 4 AND w NOT IN {STOP}))), ' ') AS tokens FROM benchmark",
    ),
    "normalize_doi": (
        lambda s, d: S.table(s, d, "part").select("p_partkey", T.normalize_doi(F.concat(F.lit("https://doi.org/10.1234/"), "p_name", F.lit("."))).alias("doi")),
        r"SELECT p_partkey, regexp_replace(lower('10.1234/' || regexp_replace(p_name, '\s+', '', 'g') || '.'), '[.,;)\]]+$', '') AS doi FROM part",
    ),
    "url_host": (
        lambda s, d: S.table(s, d, "pages").groupBy(T.url_host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")),
        r"SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '') AS host, count(*) AS n FROM pages GROUP BY 1",
    ),
    "html_strip": (
        lambda s, d: S.table(s, d, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("digest")),
        r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages",
    ),
    "rank_buckets": (
        lambda s, d: S.table(s, d, "orders").groupBy(T.rank_bucket(F.col("o_orderkey") % 13).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE WHEN o_orderkey % 13 <= 1 THEN '1' WHEN o_orderkey % 13 <= 3 THEN '2-3' WHEN o_orderkey % 13 <= 5 THEN '4-5' WHEN o_orderkey % 13 <= 10 THEN '6-10' ELSE '11+' END AS bucket, count(*) AS n FROM orders GROUP BY 1",
    ),
    "reconstruct_text": (_reconstruct, "SELECT item_id, md5(text) AS digest FROM benchmark"),
    "text_quality_flags": (
        _quality_flags,
        rf"""SELECT doc_id, array_to_string(list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN contains(' ' || {NORM.format(x='text')} || ' ', ' all rights reserved ') THEN 'license_line' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'email' END,
        CASE WHEN contains(text, chr(10)) THEN 'multi_line' END, CASE WHEN upper(text) = text THEN 'shouting' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents""",
    ),
    "conversation_summary": (_turns, "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id"),
    "corpus_hash": (
        # order-independent: a sum of digests, which combines before the shuffle where a sorted list would gather
        lambda s, d: S.table(s, d, "documents").groupBy("source").agg(F.sum(F.conv(F.substring(F.md5("text"), 1, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest"), F.count(F.lit(1)).alias("n")),
        "SELECT source, CAST(sum(CAST('0x' || substr(md5(text), 1, 12) AS BIGINT)) AS VARCHAR) AS digest, count(*) AS n FROM documents GROUP BY source",
    ),
    "vector_norms": (
        lambda s, d: S.table(s, d, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.cosine01(F.col("embedding"), F.reverse("embedding")), 6).alias("self_reverse")),
        "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(least(1, greatest(0, (list_dot_product(e, list_reverse(e)) / list_dot_product(e, e) + 1) / 2)), 6) AS self_reverse FROM v",
    ),
    "finding_duplicates": (
        lambda s, d: L.duplicates_by_key(S.table(s, d, "conversations").select("conv_id", "turn", "text"), F.concat_ws("|", F.col("conv_id").cast("string"), F.lower(F.trim("text"))), [F.col("turn")]).select("conv_id", "turn", "duplicate"),
        "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, lower(trim(text)) ORDER BY turn) > 1 AS duplicate FROM conversations",
    ),
}
