"""Phrase collocations: runs of words that occur together far more often than their parts would by chance.

All 1..max_n-grams become rows (lang, phrase, f), added up by hash aggregation; a task adds up what it has read
before its rows leave Python, so frequent phrases reach the shuffle once for each block of text. Candidates then meet the
counts of their first and last parts by equi-joins, scores are whole divisions of decimals, candidates that live inside
a longer one leave by an anti-join with its one-word-shorter parts, and each language's first ones are ranked in two
steps, so that no task sorts a whole language.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lodespark.llm.common import binary, slices, written

#: Bytes of text that a task adds up together, and rows that it hands over at a time.
TOGETHER, ROWS = 8 << 20, 1 << 16
#: A-Z in lower case, every mark that ends a piece as a full stop, tabs as spaces.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b",;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + b"." * 9 + b" ")
_SPACE = re.compile(b" ")
#: Parts that a language's candidates are ranked in first.
RANK_PARTS = 64


def _parts(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Words and full stops of all texts, a stop between texts, as lists of those in about ``most`` bytes."""
    data = b" . ".join(t.translate(_PLAIN).replace(b".", b" . ") for t in texts)
    at = 0
    while len(data) - at > most:
        found = _SPACE.search(data, at + most)
        if not found:
            break
        yield data[at : found.start()].split(b" ")
        at = found.end()
    yield data[at:].split(b" ")


def _grams(texts: list[bytes], min_n: int, max_n: int, most: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(words, phrases, counts) of all min_n..max_n-grams; phrases are distinct within each block of ``most`` bytes."""
    before: list[bytes] = []
    for part in _parts(texts, most):
        words = before + [w for w in part if w]
        new = len(before)
        before = words[max(0, len(words) - max_n + 1) :]
        if len(words) == new:
            continue
        coded = pa.array(words, pa.binary()).dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        names = vocabulary = coded.dictionary.take(pa.array(by_name))
        place = np.empty(len(by_name), np.int64)
        place[by_name] = np.arange(len(by_name))
        codes, v = place[coded.indices.to_numpy()], len(names)
        stop = names.index(b".").as_py()
        is_word, own = codes != stop, np.where(codes != stop, codes, -1)
        for n in range(1, max_n + 1):
            if n > 1:  # a phrase's number is that of its first n - 1 words and its last word; numbers are in order of names
                distinct, own = np.unique(np.where((own[:-1] >= 0) & is_word[n - 1 :], own[:-1] * v + codes[n - 1 :], -1), return_inverse=True)
                gaps = int(len(distinct) > 0 and distinct[0] < 0)
                distinct, own = distinct[gaps:], own - gaps
                names = pc.binary_join_element_wise(names.take(pa.array(distinct // v)), vocabulary.take(pa.array(distinct % v)), pa.scalar(b" ", pa.binary()))
            fresh = own[max(0, new - n + 1) :]  # what ends before the new words was counted with the last block
            if n >= min_n:
                counts = np.bincount(fresh[fresh >= 0], minlength=len(names))
                there = np.flatnonzero(counts)
                yield n, names.take(pa.array(there)), counts[there]


def phrase_counts(docs: DataFrame, min_n: int = 1, max_n: int = 3, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f): how often each phrase of ``min_n`` to ``max_n`` words stands in the texts of each language.

    Letters A-Z count as a-z. A phrase lies within a piece, that is between two of ``. , ; : ! ?`` and line ends; its
    words are split by spaces and tabs and joined by one space. Overlapping occurrences all count. Null languages are
    ``und``, null texts empty.

    Rows are dealt out by key before Spark adds them up: most long phrases are unlike any other that a task has, and a
    task's own hash map of them would only spill.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    return _counted(rows, min_n, max_n).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _counted(rows: DataFrame, min_n: int, max_n: int) -> DataFrame:
    """The n-grams of each block of text with their counts there."""

    def flushed(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            for _, phrases, counts in _grams(texts, min_n, max_n, TOGETHER):
                for at in range(0, len(counts), ROWS):
                    k = len(counts[at : at + ROWS])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]).take(pa.array(np.zeros(k, np.int64))), phrases.slice(at, k).cast(pa.string()), pa.array(counts[at : at + k].astype(np.int64))],
                        ["lang", "phrase", "f"],
                    )

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, list[bytes]] = defaultdict(list)
        size = 0
        for batch in batches:
            for at, k in slices(batch.column("text"), TOGETHER // 8):
                for lang, text in zip(batch.column("lang").slice(at, k).to_pylist(), binary(batch.column("text").slice(at, k)), strict=True):
                    if text:
                        held[lang].append(text)
                        size += len(text)
                if size >= TOGETHER:
                    yield from flushed(held)
                    held, size = defaultdict(list), 0
        yield from flushed(held)

    return rows.mapInArrow(explode, "lang string, phrase string, f bigint")


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` collocations of 2 to ``max_n`` words.

    Candidates occur ``a >= least`` times. A cut after k words gives l and r, the counts of both parts, and the score
    floor(1000000 * a * a / (l * r)); the least over all cuts counts, at ties that of the smallest k. A candidate goes if
    some longer one that has it inside occurs at least ``share`` per cent as often; it is enough to look one word further,
    since what lies between occurs no less often than the longer one. ``max_n`` is 2 at least. n is the number of all words of the language.
    Counts are exact up to 10^15. An empty table, or one without candidates, gives no rows.
    """
    # the longest phrases are most of the rows: counted by themselves, so that the shuffles follow each other
    parts = [phrase_counts(docs, low, high, text_col, lang_col).where((F.instr("phrase", " ") == 0) | (F.col("f") >= least)) for low, high in ((1, max_n - 1), (max_n, max_n))]
    all_counts = written(parts[0], "phrase-counts").unionByName(written(parts[1], "phrase-counts"))
    all_counts = all_counts.withColumn("words", F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    sizes = all_counts.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    counts = all_counts.where(F.col("f") >= least)
    found = counts.where("words > 1").withColumnRenamed("f", "a")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - words)").alias("tail"))
    # a longer candidate's first and last words - 1 words: what it may absorb
    inside = cuts.where((F.col("words") > 2) & ((F.col("k") == 1) | (F.col("k") == F.col("words") - 1)))
    inside = inside.select("lang", F.explode(F.array(F.when(F.col("k") == F.col("words") - 1, F.col("head")), F.when(F.col("k") == 1, F.col("tail")))).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    hundred = F.lit(100).cast("decimal(38,0)")
    free = cuts.join(inside, (cuts.lang == inside.lang) & (cuts.phrase == inside.phrase) & (hundred * F.col("longer") >= F.lit(share).cast("decimal(38,0)") * F.col("a")), "left_anti")
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  10^6 * 10^15 * 10^15 has 37 digits
    score = F.expr("CAST((CAST(1000000 AS DECIMAL(7,0)) * exact_a * exact_a) div (exact_l * exact_r) AS BIGINT)")
    scored = free.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumns({f"exact_{c}": wide(c) for c in ("a", "l", "r")}).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
