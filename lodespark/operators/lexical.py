"""BM25 and tf-idf of many queries over whole documents, in arrays: no row for a word, nor for a query and a document that can't be among its best.

A document's words are counted where its text is read. Only terms that a query asks are kept, as numbers, one row for a
document; sizes, document frequencies and scores come from that table. The queries' terms go to every task; a task adds
up the scores of some documents for all queries and keeps, for each query, what can still be among its best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lodespark.operators import retrieval as R
from lodespark.operators.components import _cut
from lodespark.operators.nearest import best_places

#: Bytes of texts that are split into words at a time, and scores (documents x queries) that a task holds.
BYTES, CELLS = 1 << 22, 1 << 22
#: Scores are rounded to 6 places: what may round to the k-th best lies within this of it.
SLACK = 2e-6
_LEAST = np.iinfo(np.int64).min
_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789+" else 32 for c in range(256))


class _Terms:
    """Numbers of the terms that queries ask, words and adjacent pairs ``a_b``."""

    def __init__(self, terms: list[str]):
        pairs = [(t, k) for k, t in enumerate(terms) if "_" in t]
        single = [(t, k) for k, t in enumerate(terms) if "_" not in t]
        words = sorted({t for t, _ in single} | {w for t, _ in pairs for w in t.split("_")})
        code = {w: k for k, w in enumerate(words)}
        self.words, self.n = pa.array([w.encode() for w in words], pa.binary()), len(words)
        self.term_of = np.full(self.n, -1)
        for t, k in single:
            self.term_of[code[t]] = k
        both = sorted((code[a] * self.n + code[b], k) for t, k in pairs for a, b in [t.split("_")])
        self.pairs, self.pair_term = (np.array([x[c] for x in both], np.int64) for c in (0, 1))

    def found(self, texts: list[bytes], bigrams: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words and pairs of each lower-case text; text and term of every occurrence of a term)."""
        split = [t.translate(_WORDS).split() for t in texts]
        n = np.array([len(w) for w in split], np.int64)
        of = np.repeat(np.arange(len(texts)), n)
        code = pc.index_in(pa.array([w for ws in split for w in ws], pa.binary()), self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.flatnonzero(code >= 0)
        term = self.term_of[code[known]]
        at, term = [of[known[term >= 0]]], [term[term >= 0]]
        if bigrams and len(self.pairs):
            left = known[known + 1 < len(code)]
            left = left[(code[left + 1] >= 0) & (of[left + 1] == of[left])]
            key = code[left] * self.n + code[left + 1]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[place] == key
            at.append(of[left[hit]])
            term.append(self.pair_term[place[hit]])
        return np.where(n > 0, 2 * n - 1, 0) if bigrams else n, np.concatenate(at), np.concatenate(term)


def counts(docs: DataFrame, fields: dict[str, Column], terms: list[str], bigrams: bool = True) -> DataFrame:
    """(doc_id, fields): for every doc_id its rows' fields as structs (field, len, terms, tfs): which of ``terms``, by number, stand in it, and how often.

    Rows that share an id are one document; fields of theirs with equal lengths are added up when scored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(terms)
    names = list(fields)
    rows = docs.select("doc_id", *(F.lower(F.coalesce(c, F.lit(""))).alias(f"f{k}") for k, c in enumerate(fields.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Terms(shared.value)
        total = len(shared.value)
        for batch in batches:
            for k in range(len(names)):
                column = batch.column(f"f{k}")
                ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
                start = 0
                while start < len(ends):
                    stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BYTES, side="right")))
                    part = column.slice(start, stop - start)
                    length, at, term = own.found([t.encode("utf-8", "surrogatepass") for t in part.to_pylist()], bigrams)
                    key, tf = np.unique(at * total + term, return_counts=True) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    offsets = pa.array(np.searchsorted(key, np.arange(len(part) + 1) * total), pa.int32())
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (key % max(total, 1), tf)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), pa.array(np.full(len(part), k), pa.int32()), pa.array(length, pa.int64()), *lists], ["doc_id", "field", "len", "terms", "tfs"])
                    start = stop

    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, field int, len bigint, terms array<int>, tfs array<int>"
    return rows.mapInArrow(run, kind).groupBy("doc_id").agg(F.collect_list(F.struct("field", "len", "terms", "tfs")).alias("fields"))


def _flat(batch: pa.RecordBatch, n_fields: int, n_terms: int, lengths: bool = True) -> tuple[np.ndarray, ...]:
    """(document, field, len, term, tf) of every posting of a batch of ``counts``; those equal but for tf are one."""
    lists = batch.column("fields")
    of = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    field, length, terms, tfs = lists.flatten().flatten()
    row = pc.list_parent_indices(terms).to_numpy(zero_copy_only=False)
    doc, field, length = of[row], field.to_numpy(zero_copy_only=False)[row], length.to_numpy(zero_copy_only=False)[row]
    term, tf = terms.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if not lengths:
        length = np.zeros_like(length)
    if len(of) > n_fields * len(batch):  # rows that share an id
        order = np.lexsort((term, length, field, doc))
        doc, field, length, term, tf = (x[order] for x in (doc, field, length, term, tf))
        new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(field) != 0) | (np.diff(length) != 0) | (np.diff(term) != 0)])[: len(doc)]
        at = np.flatnonzero(new)
        doc, field, length, term, tf = doc[at], field[at], length[at], term[at], np.add.reduceat(tf, at) if len(at) else tf
    return doc, field, length, term, tf


class Lexical:
    """What scores need of documents and queries (query_id, term): counts, document frequencies, lengths."""

    def __init__(self, docs: DataFrame, fields: dict[str, Column], queries: DataFrame, bigrams: bool = True):
        self.names = list(fields)
        self.words = queries.select("query_id", "term").where("term IS NOT NULL")  # with repeats
        self.queries = self.words.distinct()
        self.terms = sorted(r["term"] for r in self.queries.select("term").distinct().toLocalIterator())
        self.counts = _cut(counts(docs, fields, self.terms, bigrams))
        self.n_docs = docs.agg(F.count(F.lit(1)).alias("n"))

    def index(self, rows: DataFrame) -> DataFrame:
        """Postings (doc_id, field, term, len, tf) of some rows of ``counts``."""
        name = F.get(F.array(*map(F.lit, self.names)), F.col("x.field"))
        numbers = self.queries.sparkSession.createDataFrame(list(enumerate(self.terms)), "t int, term string")
        x = rows.select("doc_id", F.explode("fields").alias("x")).select("doc_id", name.alias("field"), "x.len", F.explode(F.arrays_zip("x.terms", "x.tfs")).alias("y"))
        x = x.groupBy("doc_id", "field", "len", F.col("y.terms").alias("t")).agg(F.sum("y.tfs").alias("tf"))
        return x.join(numbers, "t").select("doc_id", "field", "term", "tf", "len")

    def idf(self, max_share: float = 0.95) -> DataFrame:
        """(term, df, idf) as ``retrieval.idf_table`` has them."""
        n_fields, n_terms, terms = len(self.names), len(self.terms), self.queries.sparkSession.sparkContext.broadcast(self.terms)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(n_terms, np.int64)
            for batch in batches:
                doc, _, _, term, _ = _flat(batch, n_fields, n_terms)
                df += np.bincount(np.unique(doc.astype(np.int64) * n_terms + term) % max(n_terms, 1), minlength=n_terms)
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([terms.value[k] for k in at], pa.string()), pa.array(df[at])], ["term", "n"])

        df = self.counts.where("doc_id IS NOT NULL").select("fields").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("df"))
        return R.idf_of(df, self.n_docs, max_share)

    def lengths(self) -> DataFrame:
        """(field, avg_len): mean length of each field where it is not empty."""
        name = F.get(F.array(*map(F.lit, self.names)), F.col("x.field"))
        x = self.counts.select(F.explode(F.array_distinct(F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["len"].alias("len"))))).alias("x"))
        return x.where("x.len > 0").groupBy(name.alias("field")).agg(F.avg("x.len").alias("avg_len"))

    def bm25(self, weights: dict[str, float], k: int, descending_ids: bool = False) -> DataFrame:
        """(query_id, doc_id, score, rank): the best k documents of each query."""
        mean = {r["field"]: r["avg_len"] for r in self.lengths().collect()}
        weight = np.array([float(weights.get(f, 0.0)) for f in self.names])
        avg = np.array([max(mean.get(f) or 1.0, 1.0) for f in self.names])

        def value(field: np.ndarray, length: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
            return weight[field] * idf * tf * (R.K1 + 1) / (tf + R.K1 * (1 - R.B + R.B * length / avg[field]))

        asked = self.queries.withColumn("times", F.lit(1).cast("bigint")).join(self.idf().where("idf > 0").select("term", "idf"), "term")
        return self._best(asked, value, k, descending_ids).where("score > 0")

    def tfidf(self, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank): the best k by the sum over query tokens, repeats kept, of (1 + ln tf) * idf, in one field."""
        asked = self.words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).join(self.idf(1.0).select("term", "idf"), "term")
        return self._best(asked, lambda field, length, tf, idf: (1 + np.log(tf)) * idf, k, lengths=False)

    def _best(self, asked: DataFrame, value, k: int, descending_ids: bool = False, lengths: bool = True) -> DataFrame:
        """The best k documents by the sum of their postings' values, for (query_id, term, times, idf) rows. Without ``lengths``, rows of one id are one document whatever their lengths."""
        spark, names, n_terms = self.queries.sparkSession, self.names, len(self.terms)
        asked = asked.toArrow()
        number = pc.index_in(asked.column("term").combine_chunks(), pa.array(self.terms, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pc.unique(asked.column("query_id").combine_chunks())
        query = pc.index_in(asked.column("query_id").combine_chunks(), ids).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(number, kind="stable")
        idf = np.zeros(n_terms)
        idf[number] = asked.column("idf").to_numpy()
        times = asked.column("times").to_numpy()
        shared = spark.sparkContext.broadcast((ids, query[order], times[order], np.searchsorted(number[order], np.arange(n_terms + 1)), idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, query, times, start, idf = shared.value
            n = len(ids)
            floor = np.zeros(n)
            most = max(1, CELLS // max(n, 1))
            for batch in batches:
                for first in range(0, len(batch) if n else 0, most):
                    part = batch.slice(first, most)
                    doc_ids = part.column("doc_id").fill_null(_LEAST).to_numpy(zero_copy_only=False)
                    doc, field, length, term, tf = _flat(part, len(names), n_terms, lengths)
                    part_value = value(field, length, tf, idf[term])
                    size = start[term + 1] - start[term]
                    total = np.zeros(n * len(part))
                    ends = np.cumsum(size)
                    for a, b in _pieces(ends, CELLS):
                        each = np.repeat(np.arange(a, b), size[a:b])
                        nth = np.arange(len(each)) - np.repeat(ends[a:b] - size[a:b] - (ends[a - 1] if a else 0), size[a:b])
                        at = start[term[each]] + nth
                        total += np.bincount(query[at] * len(part) + doc[each], weights=part_value[each] * times[at], minlength=len(total))
                    total = total.reshape(n, len(part))
                    out = []
                    for q in np.flatnonzero(total.max(axis=1) > 0):
                        at = np.flatnonzero((total[q] > 0) & (total[q] >= floor[q] - SLACK))
                        keep, least = best_places(total[q, at], doc_ids[at], k, descending_ids, SLACK)
                        floor[q] = max(floor[q], least)
                        out.append((np.full(len(keep), q), at[keep]))
                    if out:
                        q, at = (np.concatenate(x) for x in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), part.column("doc_id").take(pa.array(at)), pa.array(total[q, at])], ["query_id", "doc_id", "score"])

        kind = f"query_id {self.queries.schema['query_id'].dataType.simpleString()}, doc_id {self.counts.schema['doc_id'].dataType.simpleString()}, score double"
        found = self.counts.mapInArrow(run, kind).select("query_id", "doc_id", F.round("score", 6).alias("score"))
        return R.top_k(found, k, descending_ids)


def _pieces(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches whose sizes, of which ``ends`` are the running sums, come to about ``most``."""
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop
