"""Boolean constraints, entity resolution and evidence spans over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.functions import constraints as C
from lodespark.functions import text as T
from lodespark.operators import containment as K
from lodespark.operators import entities as E
from lodespark.operators import spans as P
from lodespark.plans.texts import NORM
from lodespark.sources import tables as S

#: NOT before AND before OR; the bracket changes that.
WANTED = '(the OR "der und" OR que) AND en NOT example OR "les des"'
PARTS = "(widget OR gadget) AND cold NOT ECONOMY OR small AND PROMO"


def _constrained(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.where(C.predicate(C.tree(WANTED), [F.col("text"), F.col("source")])).select("doc_id", "source")


def _scanned(spark, d):
    parts = S.table(spark, d, "part")
    return parts.where(C.predicate(C.tree(PARTS), [F.col("p_name"), F.col("p_type")], case_sensitive=True)).select("p_partkey", "p_name", "p_type")


def _records(spark, d):
    """Documents as papers whose DOI is the digest of the text, aliased by both its ends; pages as datasets of their host."""
    md5 = lambda c: F.md5(c.cast("binary"))
    none = F.lit(None).cast("string")
    text, doc = F.col("text"), F.col("doc_id").cast("string")
    papers = S.table(spark, d, "documents").select(
        F.concat(F.lit("d"), doc).alias("record_id"), F.concat(F.lit("paper:doc:"), doc).alias("paper_id"), "source", doc.alias("source_id"), F.concat(F.lit("https://doi.org/10.5555/"), md5(text)).alias("doi"),
        md5(F.substring(text, 1, 30)).alias("title"), none.alias("url"), F.array(md5(F.substring(text, 1, 40)), md5(F.expr("right(text, 40)"))).alias("aliases"),
    )
    pages = S.table(spark, d, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("record_id"), none.alias("paper_id"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("source"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("source_id"),
        none.alias("doi"), none.alias("title"), "url", F.array(md5(F.col("html"))).alias("aliases"),
    )
    return papers.unionByName(pages)


def _entity(name):
    return lambda s, d: E.resolve_entities(_records(s, d))[name]


CLEAN = r"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9._:/-]+', '_', 'g'), '^_+|_+$', '', 'g')"
RECORDS = f"""WITH RECURSIVE r AS (
  SELECT 'd' || doc_id AS record_id, 'paper:doc:' || doc_id AS paper_id, source, CAST(doc_id AS VARCHAR) AS source_id, 'https://doi.org/10.5555/' || md5(text) AS doi, md5(substr(text, 1, 30)) AS title, NULL::VARCHAR AS url,
         [md5(substr(text, 1, 40)), md5(right(text, 40))] AS aliases, 'paper' AS kind FROM documents
  UNION ALL SELECT 'p' || page_id, NULL, regexp_extract(url, '^[a-z]+://([^/]+)', 1), regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), NULL, NULL, url, [md5(html)],
         CASE WHEN regexp_extract(url, '^[a-z]+://([^/]+)', 1) <> '' AND regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) <> '' THEN 'dataset' ELSE 'unknown' END FROM pages),
n AS (SELECT *, {CLEAN.format(x="source")} || ':' || source_id AS named FROM r),
i AS (SELECT DISTINCT * FROM (
  SELECT record_id, kind, 'dataset_id' AS family, 'dataset:' || named AS value FROM n WHERE kind = 'dataset'
  UNION ALL SELECT record_id, kind, 'source', named FROM n WHERE kind <> 'unknown' AND source <> '' AND source_id <> ''
  UNION ALL SELECT record_id, kind, 'paper_id', paper_id FROM n WHERE kind = 'paper'
  UNION ALL SELECT record_id, kind, 'paper_id', 'paper:' || named FROM n WHERE kind = 'paper' AND source <> '' AND source_id <> ''
  UNION ALL SELECT record_id, kind, 'doi', replace(doi, 'https://doi.org/', '') FROM n WHERE kind = 'paper' AND doi IS NOT NULL
  UNION ALL SELECT record_id, kind, 'unknown', record_id FROM n WHERE kind = 'unknown'
  UNION ALL SELECT record_id, kind, 'alias', unnest(aliases) FROM n WHERE kind <> 'unknown') WHERE value <> ''),
e AS (SELECT DISTINCT record_id AS a, head AS b FROM i JOIN (SELECT family, value, min(record_id) AS head FROM i GROUP BY ALL) USING (family, value) WHERE record_id <> head),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, w.b FROM reach JOIN both_ways w ON reach.b = w.a),
m AS (SELECT record_id, kind, least(record_id, coalesce(least_id, record_id)) AS component FROM (SELECT DISTINCT record_id, kind FROM i) LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) ON a = record_id),
v AS (SELECT DISTINCT component, family, value FROM i JOIN m USING (record_id)),
named_entities AS (
  SELECT component, entity_type, first_record, n_records, n_identifiers, CASE entity_type WHEN 'paper' THEN coalesce('paper:doi:' || doi, paper_id, any_id) WHEN 'dataset' THEN coalesce(dataset_id, any_id) ELSE any_id END AS canonical_id
  FROM (SELECT component, CASE WHEN min(kind) = max(kind) THEN min(kind) ELSE 'unknown' END AS entity_type, min(record_id) AS first_record, count(DISTINCT record_id) AS n_records FROM m GROUP BY component)
  JOIN (SELECT component, min(value) FILTER (family = 'doi') AS doi, min(value) FILTER (family = 'paper_id') AS paper_id, min(value) FILTER (family = 'dataset_id') AS dataset_id, min(family || ':' || value) AS any_id, count(*) AS n_identifiers FROM v GROUP BY component) USING (component)),
placed AS (SELECT r.*, component, canonical_id FROM r JOIN m USING (record_id) JOIN named_entities USING (component))
"""
CONFLICTS = (
    RECORDS
    + """, f AS (SELECT canonical_id, component, field, value, count(*) AS n_records FROM (
  SELECT canonical_id, component, unnest(['title', 'source', 'source_id', 'doi', 'url']) AS field, unnest([title, source, source_id, doi, url]) AS value FROM placed) WHERE value <> '' GROUP BY ALL)
SELECT canonical_id, field, value, n_records FROM f QUALIFY count(*) OVER (PARTITION BY component, field) > 1"""
)
ENTITIES = (
    RECORDS
    + """, a AS (SELECT component, count(DISTINCT alias) AS n_aliases FROM (SELECT component, title AS alias FROM placed UNION ALL SELECT component, unnest(aliases) FROM placed) WHERE alias <> '' GROUP BY component)
SELECT canonical_id, entity_type, first_record, n_records, n_identifiers, coalesce(n_aliases, 0) AS n_aliases FROM named_entities LEFT JOIN a USING (component)"""
)

#: Letters of a passage that make its statement, and words that a document must share with it in a row.
STATEMENT, TOGETHER = 80, 5


def _spans(spark, d):
    """Where documents support the beginnings of passages that they share five words in a row with."""
    runs = lambda c: F.filter(F.transform(c, lambda _, i: F.array_join(F.slice(c, i + 1, TOGETHER), " ")), lambda _, i: i <= F.size(c) - TOGETHER)
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    wanted = S.table(spark, d, "benchmark").select("item_id", F.substring("text", 1, STATEMENT).alias("statement"))
    asked = wanted.select("item_id", F.explode(F.array_distinct(runs(words(F.col("statement"))))).alias("run"))
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    have = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(runs(F.col("w"))).alias("run"))
    pairs = have.join(asked, "run").select("doc_id", "item_id").distinct()
    return P.locate_spans(pairs.join(wanted, "item_id").join(docs, "doc_id"), least=0.3).withColumn("match_score", F.round("match_score", 3))


#: (first word, words) of a passage's terms.
TERMS = [(1, 2), (3, 2), (1, 12)]


def _record_concepts(spark, d):
    """Documents as records, each sentence part of the whole text a term; passages as concepts, some runs of words their terms."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("record"), F.explode(F.split("text", r"[.,;:!?\n]+")).alias("term"))
    items = S.table(spark, d, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("concept"), T.tokens(F.col("text")).alias("w"))
    concepts = items.select("concept", F.explode(F.array(*(F.array_join(F.slice("w", at, n), " ") for at, n in TERMS))).alias("term"))
    return K.contained_concepts(docs, concepts)


WHITE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SET_OF = f"list_sort(list_distinct(list_filter(regexp_split_to_array(translate(lower(term), '_-', '  '), '{WHITE}'), lambda w: w <> '')))"
RUNS = ", ".join(f"array_to_string(w[{at} : {at + n - 1}], ' ')" for at, n in TERMS)
RECORD_CONCEPTS = f"""WITH pieces AS (SELECT doc_id AS record, unnest(regexp_split_to_array(text, '[.,;:!?\n]+')) AS term FROM documents WHERE text IS NOT NULL),
b AS (SELECT 'item_' || item_id AS concept, list_filter(string_split({NORM.format(x='text')}, ' '), lambda w: w <> '') AS w FROM benchmark),
r AS (SELECT DISTINCT record, {SET_OF} AS t FROM pieces), c AS (SELECT DISTINCT concept, {SET_OF} AS t FROM (SELECT concept, unnest([{RUNS}]) AS term FROM b)),
rs AS (SELECT row_number() OVER () AS i, t FROM (SELECT DISTINCT t FROM r)), cs AS (SELECT row_number() OVER () AS j, t FROM (SELECT DISTINCT t FROM c)),
met AS (SELECT i, j, count(*) AS n FROM (SELECT i, unnest(t) AS w FROM rs) JOIN (SELECT j, unnest(t) AS w FROM cs) USING (w) GROUP BY i, j),
ok AS (SELECT rs.t AS rt, cs.t AS ct FROM met JOIN rs USING (i) JOIN cs USING (j) WHERE n = len(rs.t) OR n = len(cs.t))
SELECT DISTINCT record, concept FROM ok JOIN r ON r.t = rt JOIN c ON c.t = ct"""


QUERIES = {
    "constraint_documents": (_constrained, "SELECT doc_id, source FROM (SELECT doc_id, source, lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS s FROM documents) "
        "WHERE ((contains(t, 'the') OR contains(s, 'the') OR contains(t, 'der und') OR contains(s, 'der und') OR contains(t, 'que') OR contains(s, 'que')) AND (contains(t, 'en') OR contains(s, 'en')) AND NOT (contains(t, 'example') OR contains(s, 'example'))) OR contains(t, 'les des') OR contains(s, 'les des')"),
    "constraint_scan": (_scanned, "SELECT p_partkey, p_name, p_type FROM part WHERE ((contains(p_name, 'widget') OR contains(p_type, 'widget') OR contains(p_name, 'gadget') OR contains(p_type, 'gadget')) AND (contains(p_name, 'cold') OR contains(p_type, 'cold')) "
        "AND NOT (contains(p_name, 'ECONOMY') OR contains(p_type, 'ECONOMY'))) OR ((contains(p_name, 'small') OR contains(p_type, 'small')) AND (contains(p_name, 'PROMO') OR contains(p_type, 'PROMO')))"),
    "entity_lookup": (_entity("lookup"), RECORDS + "SELECT record_id, canonical_id FROM placed"),
    "entity_table": (_entity("entities"), ENTITIES),
    "entity_conflicts": (_entity("conflicts"), CONFLICTS),
    "evidence_spans": (_spans, None),
    "record_concepts": (_record_concepts, RECORD_CONCEPTS),
}
