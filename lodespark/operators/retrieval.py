"""Lexical retrieval: inverted index, BM25, tf-idf, snippets, candidate generators.

An index is two tables, so that queries of any number share one pass: postings (term, doc_id, field, tf) and field
lengths. All queries are scored together; the join is on terms, partial sums are combined before the shuffle by
(query, document), and only the top is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodespark.functions import text as T

#: Saturation and length normalisation.
K1, B = 1.5, 0.75


def _terms(docs: DataFrame, fields: dict[str, Column], bigrams: bool) -> DataFrame:
    parts = []
    for name, text in fields.items():
        words = T.with_bigrams(T.tokens(text)) if bigrams else T.tokens(text)
        parts.append(docs.select("doc_id", F.lit(name).alias("field"), F.explode(T.counted(words)).alias("t")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select("doc_id", "field", "t.len", "t.term")


def postings(docs: DataFrame, fields: dict[str, Column], bigrams: bool = True, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, term, tf, len) of (doc_id, ...) rows: term frequencies and the length of each field.

    With ``only`` (term), postings of these terms alone are made: all that a set of queries needs, and other terms never
    reach a shuffle.
    """
    rows = _terms(docs, fields, bigrams)
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("doc_id", "field", "term", "len").agg(F.count(F.lit(1)).alias("tf"))


def field_lengths(docs: DataFrame, fields: dict[str, Column], bigrams: bool = True) -> DataFrame:
    """(field, avg_len): mean length of each field where it is not empty."""
    parts = []
    for name, text in fields.items():
        n = F.size(T.with_bigrams(T.tokens(text)) if bigrams else T.tokens(text))
        parts.append(docs.select("doc_id", F.lit(name).alias("field"), n.alias("len")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.where("len > 0").groupBy("field").agg(F.avg("len").alias("avg_len"))


def idf_table(index: DataFrame, n_docs: DataFrame, max_share: float = 0.95) -> DataFrame:
    """(term, df, idf): ln((N - df + 0.5) / (df + 0.5) + 1), 0 for terms in more than ``max_share`` of documents."""
    return idf_of(index.groupBy("term").agg(F.countDistinct("doc_id").alias("df")), n_docs, max_share)


def idf_of(df: DataFrame, n_docs: DataFrame, max_share: float = 0.95) -> DataFrame:
    """``idf_table`` of document frequencies (term, df)."""
    idf = F.greatest(F.lit(0.0), F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    return df.crossJoin(n_docs).select("term", "df", F.when(F.col("df") / F.col("n") > max_share, F.lit(0.0)).otherwise(idf).alias("idf"))


def bm25_parts(index: DataFrame, idf: DataFrame, lengths: DataFrame, queries: DataFrame, weights: dict[str, float], zeros: bool = True) -> DataFrame:
    """(query_id, doc_id, field, term, part) of (query_id, term) rows: every summand of the score; without ``zeros`` not those of terms with idf 0, whose postings are the longest."""
    weight = F.coalesce(*(F.when(F.col("field") == f, F.lit(float(w))) for f, w in weights.items()), F.lit(0.0))
    idf = idf.select("term", "idf")
    wanted = queries.select("query_id", "term").distinct().join(idf if zeros else idf.where("idf > 0"), "term")
    rows = index.join(wanted, "term").join(lengths, "field")
    part = weight * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1.0))))
    return rows.select("query_id", "doc_id", "field", "term", part.alias("part"))


def top_k(scores: DataFrame, k: int, descending_ids: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): the best k of each query; ties by id, ascending unless told otherwise."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").desc() if descending_ids else F.col("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(index: DataFrame, idf: DataFrame, lengths: DataFrame, queries: DataFrame, weights: dict[str, float], k: int, descending_ids: bool = False) -> DataFrame:
    scores = bm25_parts(index, idf, lengths, queries, weights, zeros=False).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
    return top_k(scores, k, descending_ids)


def tfidf(index: DataFrame, idf: DataFrame, queries: DataFrame, k: int, unknown_idf: float = 0.1) -> DataFrame:
    """Sum over query tokens, repeats kept, of (1 + ln tf) * idf."""
    q = queries.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")).join(idf.select("term", "idf"), "term", "left")
    rows = index.join(q, "term").withColumn("part", (1 + F.ln("tf")) * F.coalesce("idf", F.lit(unknown_idf)) * F.col("qtf"))
    return top_k(rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")), k)


def keyword_share(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Share of a query's distinct terms that a document's token set holds; only documents with one or more."""
    terms = docs.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    n = queries.select("query_id", "term").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    hit = terms.join(n, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"), F.max("n").alias("n"))
    return top_k(hit.select("query_id", "doc_id", F.round(F.col("hits") / F.col("n"), 6).alias("score")), k)


def index_stats(index: DataFrame) -> DataFrame:
    """Documents, vocabulary, and mean length of the non-empty fields."""
    lengths = index.select("doc_id", "field", "len").distinct()
    return index.agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("term").alias("vocabulary")).crossJoin(lengths.agg(F.round(F.avg("len"), 6).alias("avg_len")))


def containment(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, doc_id) where a document holds a passage verbatim.

    A passage of five words or more is met by its second to fourth word, which stand whole in any text that holds it;
    shorter ones are searched in every document.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    q = passages.withColumn("w", words(F.col("passage")))
    long = q.where(F.size("w") >= 5).select("item_id", "passage", F.xxhash64(F.array_join(F.slice("w", 2, 3), " ")).alias("key"))
    runs = F.get(F.transform(F.array(words(F.col("text"))), lambda w: F.when(F.size(w) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda k: F.xxhash64(F.array_join(F.slice(w, k, F.lit(3)), " ")))))), F.lit(0))
    met = docs.select("doc_id", F.explode(runs).alias("key")).join(long.select("key", "item_id"), "key").select("doc_id", "item_id").distinct()
    found = docs.select("doc_id", "text").join(met, "doc_id").join(long.select("item_id", "passage"), "item_id").where(F.col("text").contains(F.col("passage")))
    short = q.where(F.size("w") < 5).select("item_id", "passage")
    rest = docs.select("doc_id", "text").join(short, F.col("text").contains(F.col("passage")))
    return found.select("item_id", "doc_id").distinct().unionByName(rest.select("item_id", "doc_id").distinct())


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(item_id, doc_id, text, phrase) where a document holds a lower-case phrase, case ignored.

    Of a phrase of three words the middle one stands whole, between spaces, in any text that holds it; shorter phrases
    are searched in every document.
    """
    q = phrases.withColumn("w", F.split("phrase", " "))
    long, short = q.where(F.size("w") == 3).select("item_id", "phrase", F.get("w", F.lit(1)).alias("key")), q.where(F.size("w") != 3).select("item_id", "phrase")
    has = docs.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("key"))
    met = has.join(long, "key").select("doc_id", "item_id", "phrase")
    found = docs.select("doc_id", "text").join(met, "doc_id").where(F.lower("text").contains(F.col("phrase")))
    rest = docs.select("doc_id", "text").join(short, F.lower("text").contains(F.col("phrase")))
    return found.select("item_id", "doc_id", "text", "phrase").unionByName(rest.select("item_id", "doc_id", "text", "phrase"))
