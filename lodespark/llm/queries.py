"""The thin queries opN_<name>: each applies its operator to the whole of its table; and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodespark.llm import byte_bpe, exact_dedup, fertility, language, line_dedup, mixing, near_dedup, periodic_runs, phrases, quality, suffix_dedup, vector_links, warc
from lodespark.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"), length=200)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), *byte_bpe.default_vocabulary())


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(table(spark, sf_dir, "documents"), fertility.default_vocabularies())


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), max_n=3, least=10, share=50, top=2000)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_exact_dedup, op3_vector_links, op4_line_dedup, op5_minhash, op6_warc, op7_byte_bpe, op8_pareto_mix, op9_language_id, op10_quality, op11_fertility, op12_collocations, op13_periodic_runs)}


EXACT_DEDUP = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""

WARC = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, payload_bytes, min(page_id) AS first_id FROM p GROUP BY ALL),
bits AS (SELECT digest, list_aggregate(list_transform(range(0, 40), lambda i: right('000' || bin(CAST('0x' || digest[i + 1] AS INTEGER)), 4)), 'string_agg', '') AS b FROM (SELECT DISTINCT digest FROM p)),
base AS (SELECT digest, list_aggregate(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(b[5 * k + j + 1] AS INTEGER) * CAST(2 ** (4 - j) AS INTEGER))) AS INTEGER) + 1]), 'string_agg', '') AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p JOIN f USING (digest, payload_bytes) JOIN base USING (digest)
"""

PARETO_MIX = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight, 3.0::DOUBLE * sum(size) AS cap FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, encode(source) NULLS LAST) AS k FROM s),
v AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o),
level AS (SELECT max(remaining / rest) AS level FROM v WHERE remaining / rest <= cap / weight),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap))::DOUBLE AS target FROM v, level),
p AS (SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS copies, (CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS p FROM t),
q AS (SELECT d.*, p.source_size, p.target, p.copies, p.p, floor(p.target + 0.5) - p.copies * p.source_size AS remain, (d.u / (1 - d.u)) / (CASE WHEN p.p > 0 THEN p.p / (1 - p.p) END) AS q FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM q)
SELECT doc_id, source, size, source_size, target,
       CAST(copies * size + CASE WHEN p > 0 THEN greatest(0, least(size, remain - so_far)) ELSE 0 END AS BIGINT) AS taken
FROM r
"""


SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS INTEGER), 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 - 199 AS BIGINT))) AS i FROM d WHERE len(h) >= 400)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS n FROM p) WHERE n > 1),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS prev, max(b) OVER (PARTITION BY doc_id) AS last FROM s),
t AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
             string_agg(substr(h, CAST(2 * prev + 1 AS INTEGER), CAST(2 * (a - prev) AS INTEGER)), '' ORDER BY a) || any_value(substr(h, CAST(2 * last + 1 AS INTEGER))) AS kept
      FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""

VECTOR_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
ok AS (SELECT * FROM v WHERE norm > 0 AND isfinite(norm) AND NOT list_contains(list_transform(e, lambda x: x IS NULL), true)),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

MINHASH = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""


COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: list_aggregate(w[i : i + m - 1], 'string_agg', ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m),
c AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE m = 1 GROUP BY lang),
k AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS p FROM c WHERE m > 1 AND f >= 10),
gone AS (SELECT DISTINCT x.lang, x.phrase FROM k x JOIN k y ON x.lang = y.lang AND x.m < y.m AND (x.p = y.p[1 : x.m] OR x.p = y.p[y.m - x.m + 1 : y.m]) AND 100 * y.a >= 50 * x.a),
cuts AS (SELECT k.*, j, array_to_string(p[1 : j], ' ') AS head, array_to_string(p[j + 1 : m], ' ') AS tail FROM k, (SELECT unnest([1, 2]) AS j) WHERE j < m),
s AS (SELECT cuts.lang, cuts.phrase, a, j, h.f AS l, t.f AS r, CAST((1000000::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS BIGINT) AS score
      FROM cuts JOIN c h ON h.lang = cuts.lang AND h.phrase = head JOIN c t ON t.lang = cuts.lang AND t.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN sizes USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": SUFFIX_DEDUP, "op2_exact_dedup": EXACT_DEDUP, "op3_vector_links": VECTOR_LINKS, "op5_minhash": MINHASH, "op6_warc": WARC, "op8_pareto_mix": PARETO_MIX, "op12_collocations": COLLOCATIONS}
