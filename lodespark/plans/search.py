"""Text retrieval queries: benchmark passages against all documents, vectors against all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.functions import sets as A, text as T, vectors as V
from lodespark.operators import fusion as U, lexical as X, nearest as N, retrieval as R
from lodespark.sources import tables as S

#: A document's fields and their weights: its body, and its source as a short field.
WEIGHTS = {"body": 1.5, "source": 0.5}


def _docs(spark, d):
    return S.table(spark, d, "documents").select("doc_id", "text", "source")


def _fields():
    return {"body": F.col("text"), "source": F.col("source")}


def _queries(spark, d, bigrams=True):
    words = T.tokens(F.col("text"))
    return S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.with_bigrams(words) if bigrams else words).alias("term"))


def _index(spark, d, bigrams=True):
    return R.postings(_docs(spark, d), _fields(), bigrams)


def _n(spark, d):
    return _docs(spark, d).agg(F.count(F.lit(1)).alias("n"))


def _lexical(spark, d):
    return X.Lexical(_docs(spark, d), _fields(), _queries(spark, d))


def _bm25(spark, d, k=10, descending_ids=False):
    return _lexical(spark, d).bm25(WEIGHTS, k, descending_ids)


def _explain(spark, d):
    """Parts of the best document of each query."""
    own = _lexical(spark, d)
    best = own.bm25(WEIGHTS, 1).select("query_id", "doc_id")
    index = own.index(own.counts.join(best.select("doc_id").distinct(), "doc_id", "left_semi"))
    parts = R.bm25_parts(index, own.idf(), own.lengths(), own.queries, WEIGHTS).join(best, ["query_id", "doc_id"])
    return parts.select("query_id", "doc_id", "field", "term", F.round("part", 4).alias("part"))


def _cap(spark, d):
    hits = _bm25(spark, d, 50).join(S.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return hits.select("query_id", "doc_id", "source", "score")


def _snippets(spark, d):
    """The first hit of each benchmark passage's first three words in the documents that have them."""
    phrase = F.array_join(F.slice(F.split("text", r"\s+"), 1, 3), " ")
    q = S.table(spark, d, "benchmark").select("item_id", F.lower(phrase).alias("phrase"))
    return R.phrase_hits(_docs(spark, d), q).select("item_id", "doc_id", T.snippet(F.col("text"), F.col("phrase")).alias("snippet"))


def _containment(spark, d):
    """Verbatim benchmark passages in documents."""
    return R.containment(_docs(spark, d), S.table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")))


TOK = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[/_-]+', ' ', 'g'), '[^a-z0-9+]+', ' ', 'g')), ' '), lambda w: w <> '')"
BI = "CASE WHEN len({w}) > 1 THEN list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || '_' || {w}[i + 1])) ELSE {w} END"
INDEX = f"""
w AS (SELECT doc_id, 'body' AS field, {TOK.format(x="text")} AS w FROM documents UNION ALL SELECT doc_id, 'source', {TOK.format(x="source")} FROM documents),
wb AS (SELECT doc_id, field, {BI.format(w="w")} AS w FROM w),
index AS (SELECT doc_id, field, term, len, count(*) AS tf FROM (SELECT doc_id, field, len(w) AS len, unnest(w) AS term FROM wb) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, df, CASE WHEN df / n > 0.95 THEN 0 ELSE greatest(0, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) END AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM index GROUP BY term), n),
qw AS (SELECT item_id AS query_id, {TOK.format(x="text")} AS w FROM benchmark),
q AS (SELECT DISTINCT query_id, unnest({BI.format(w="w")}) AS term FROM qw),
lengths AS (SELECT field, avg(len) AS avg_len FROM (SELECT DISTINCT doc_id, field, len FROM index) WHERE len > 0 GROUP BY field),
parts AS (SELECT query_id, doc_id, field, term, (CASE field WHEN 'body' THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END) * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / greatest(avg_len, 1))) AS part
          FROM index JOIN q USING (term) JOIN idf USING (term) JOIN lengths USING (field)),
scores AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM parts GROUP BY ALL HAVING round(sum(part), 6) > 0),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)
"""
PLAIN = f"""
w AS (SELECT doc_id, {TOK.format(x="text")} AS w FROM documents),
index AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, greatest(0, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) AS idf FROM (SELECT term, count(*) AS df FROM index GROUP BY term), n),
q AS (SELECT item_id AS query_id, unnest({TOK.format(x="text")}) AS term FROM benchmark)
"""
TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10"


def _tfidf(spark, d):
    return X.Lexical(_docs(spark, d), {"body": F.col("text")}, _queries(spark, d, False), bigrams=False).tfidf(10)


def _fingerprints(spark, d):
    """Top five neighbours with the query's label, similarity at least 0.2 (typed kNN with a threshold)."""
    rows = S.search_pairs(spark, d).where("grade = 3 AND cos >= 0.2").select("query_id", "doc_id", F.col("cos").alias("score"))
    return R.top_k(rows, 5)


def _prf(spark, d):
    """Pseudo-relevance feedback: the normalised mean of the top five of ``head`` asks again; dot product, ties by id descending."""
    first = S.runs(spark, d, 5, ("head",)).select("query_id", "doc_id")
    v = S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    parts = first.join(v, F.col("doc_id") == F.col("vec_id")).select("query_id", F.posexplode("e").alias("pos", "x"))
    mean = parts.groupBy("query_id", "pos").agg(F.avg("x").alias("x")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("m"))
    mean = mean.withColumn("n", V.norm(F.col("m"))).where("n > 0")
    none = F.lit(None).cast("bigint").alias("label")
    found = N.nearest(v.select(F.col("vec_id").alias("id"), "e", none), mean.select(F.col("query_id").alias("id"), F.col("m").alias("e"), none), 10, {"prf": None}, "projection", others=False, descending_ids=True)
    return N.top_ranked(found, 10, descending_ids=True).select("query_id", "doc_id", "score", "rank")


def _pooling(spark, d):
    """Mean vector of each label, L2-normalised, and its cosine with every member: the least and the mean."""
    v = S.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    mean = v.select("label", F.posexplode("e").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("m"))
    return v.join(mean, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min(V.cosine(F.col("e"), F.col("m"))), 6).alias("least"), F.round(F.avg(V.cosine(F.col("e"), F.col("m"))), 6).alias("mean"))


def _usefulness(spark, d):
    """Set overlap of every record with a wanted profile: field scores, Jaccard, Dice, overlap, complementarity."""
    r = S.records(spark, d)
    want_b, want_t = F.array(*(F.lit(f"Brand#{k}") for k in (11, 12, 13, 21, 22))), F.array(F.lit("STANDARD"), F.lit("PROMO"))
    cols = [A.field_score(want_b, F.col("brands")).alias("brand_score"), A.field_score(want_t, F.col("types")).alias("type_score"), A.jaccard(want_b, F.col("brands")).alias("jaccard"), A.dice(want_b, F.col("brands")).alias("dice"), A.overlap_ratio(want_b, F.col("brands")).alias("overlap"), A.complementarity(want_b, F.col("brands")).alias("complement")]
    rows = r.select("dataset_id", *(F.round(c, 6).alias(n) for c, n in zip(cols, ("brand_score", "type_score", "jaccard", "dice", "overlap", "complement"), strict=True)))
    return rows.withColumn("score", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.28 * F.col("brand_score") + 0.2 * F.col("type_score") + 0.1 * F.col("jaccard"))) * 100 + 1e-6, 1))


W_B = "['Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22']"
SHARED = f"len(list_intersect({W_B}, brands))"
UNION = f"(5 + len(brands) - {SHARED})"
USEFULNESS = f"""WITH {S.RECORDS}, x AS (
  SELECT dataset_id, round({SHARED} / 5, 6) AS brand_score, round(len(list_intersect(['STANDARD', 'PROMO'], types)) / 2, 6) AS type_score,
         round({SHARED} / {UNION}, 6) AS jaccard, round(2 * {SHARED} / (5 + len(brands)), 6) AS dice,
         round(CASE WHEN len(brands) > 0 THEN {SHARED} / least(5, len(brands)) ELSE 0 END, 6) AS overlap,
         round(CASE WHEN {SHARED} = 0 THEN 0.3::DOUBLE ELSE 0.7::DOUBLE * (({UNION} - {SHARED}) / {UNION}) + 0.3::DOUBLE * ({SHARED} / {UNION}) END, 6) AS complement FROM records)
SELECT *, round(least(1, greatest(0, 0.28::DOUBLE * brand_score + 0.2::DOUBLE * type_score + 0.1::DOUBLE * jaccard)) * 100 + 0.000001::DOUBLE, 1) AS score FROM x"""

QUERIES = {
    "bm25_topk": (_bm25, f"WITH {INDEX} SELECT * FROM bm WHERE rank <= 10"),
    "bm25_topk_desc_ids": (lambda s, d: _bm25(s, d, 10, True), f"WITH {INDEX} SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM scores) WHERE rank <= 10"),
    "bm25_explain": (_explain, f"WITH {INDEX} SELECT query_id, doc_id, field, term, round(part, 4) AS part FROM parts JOIN (SELECT query_id, doc_id FROM bm WHERE rank = 1) USING (query_id, doc_id)"),
    "idf_table": (lambda s, d: R.idf_table(_index(s, d, False), _n(s, d)).select("term", "df", F.round("idf", 9).alias("idf")), f"WITH {INDEX.replace('FROM wb)', 'FROM w)')} SELECT term, df, round(idf, 9) AS idf FROM idf"),
    "index_stats": (lambda s, d: R.index_stats(_index(s, d)), f"WITH {INDEX} SELECT count(DISTINCT doc_id) AS n_docs, count(DISTINCT term) AS vocabulary, (SELECT round(avg(len), 6) FROM (SELECT DISTINCT doc_id, field, len FROM index)) AS avg_len FROM index"),
    "tfidf_log_search": (_tfidf, f"WITH {PLAIN}, s AS (SELECT query_id, doc_id, round(sum((1 + ln(tf)) * coalesce(idf, 0.1) * qtf), 6) AS score FROM index JOIN (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL) USING (term) LEFT JOIN idf USING (term) GROUP BY ALL) {TOP}"),
    "keyword_share": (lambda s, d: R.keyword_share(_docs(s, d), _queries(s, d, False), 10), f"WITH {PLAIN}, u AS (SELECT DISTINCT query_id, term FROM q), c AS (SELECT query_id, count(*) AS n FROM u GROUP BY 1), s AS (SELECT query_id, doc_id, round(count(*) / any_value(n), 6) AS score FROM index JOIN u USING (term) JOIN c USING (query_id) GROUP BY ALL) {TOP}"),
    "source_diversity": (
        lambda s, d: U.source_diversity(_cap(s, d), 2, limit=20),
        f"""WITH {INDEX}, c AS (SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS in_source FROM bm JOIN documents USING (doc_id) WHERE rank <= 50)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN in_source > 2 THEN 1 ELSE 0 END, score DESC, doc_id) AS rank FROM c) WHERE rank <= 20""",
    ),
    "source_cap_drop": (
        lambda s, d: U.source_diversity(_cap(s, d), 2, drop=True),
        f"""WITH {INDEX}, c AS (SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS in_source FROM bm JOIN documents USING (doc_id) WHERE rank <= 50)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM c WHERE in_source <= 2""",
    ),
    "evidence_snippets": (
        _snippets,
        r"""WITH q AS (SELECT item_id, lower(array_to_string(regexp_split_to_array(text, '\s+')[1:3], ' ')) AS phrase FROM benchmark), h AS (SELECT item_id, doc_id, text, phrase, instr(lower(text), phrase) AS pos FROM documents JOIN q ON contains(lower(text), phrase))
        SELECT item_id, doc_id, substr(text, greatest(1, pos - 48), pos + len(phrase) + 72 - greatest(1, pos - 48)) AS snippet FROM h""",
    ),
    "passage_containment": (_containment, "SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"),
    "cosine_topk": (lambda s, d: S.runs(s, d, 10, ("cos",)).select("query_id", "doc_id", "score", "rank"), f"WITH {S.RUNS} SELECT query_id, doc_id, score, rank FROM runs WHERE system = 'cos' AND rank <= 10"),
    "typed_knn": (_fingerprints, f"WITH {S.SEARCH_PAIRS}, s AS (SELECT query_id, doc_id, cos AS score FROM search_pairs WHERE grade = 3 AND cos >= 0.2) {TOP.replace('<= 10', '<= 5')}"),
    "dense_prf": (
        _prf,
        f"""WITH {S.RUNS}, f AS (SELECT query_id, doc_id FROM runs WHERE system = 'head' AND rank <= 5),
        p AS (SELECT query_id, i, avg(e[i]) AS x FROM (SELECT query_id, e, unnest(range(1, len(e) + 1)) AS i FROM f JOIN v ON vec_id = doc_id) GROUP BY ALL),
        m AS (SELECT query_id, list(x ORDER BY i) AS m FROM p GROUP BY query_id),
        s AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(e, m) / sqrt(list_dot_product(m, m)), 9) AS score FROM v, m)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM s) WHERE rank <= 10""",
    ),
    "mean_pooling": (
        _pooling,
        """WITH v AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT label, i, avg(e[i]) AS x FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM v) GROUP BY ALL), m AS (SELECT label, list(x ORDER BY i) AS m FROM p GROUP BY label)
        SELECT label, count(*) AS n, round(min(list_cosine_similarity(e, m)), 6) AS least, round(avg(list_cosine_similarity(e, m)), 6) AS mean FROM v JOIN m USING (label) GROUP BY label""",
    ),
    "set_overlap_scores": (_usefulness, USEFULNESS),
}
