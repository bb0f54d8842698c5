"""Periodic runs of words: stretches that repeat one block of words four times or more.

Main and Lorentz: the words of a batch of texts are interned and laid end to end, with a separator of its own after each
text. The row is cut in halves again and again. A run is told at the outermost midpoint that lies inside it: half of it
at least is on one side, so a square starts (or, read backwards, ends) at the midpoint, and the Z-function of that side
gives its period. Comparing across the midpoint extends it both ways; what reaches beyond the segment is left to the
segment around it. All midpoints of a level are taken at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodespark.llm.common import binary, slices, word_parts

#: Bytes of texts whose words are searched together.
TEXTS = 4 << 20
#: Words that candidates are compared on for all midpoints at once, before each midpoint is looked at alone.
TOGETHER = 16
#: Candidates of one side of a midpoint beyond which its whole Z-function is computed, in linear time.
MANY = 64
#: Words of a text that are joined to text again at a time.
JOINED = 1 << 16


def z_values(x: list[int]) -> list[int]:
    """For each place, the length of the longest common prefix of ``x`` and its rest from there."""
    n = len(x)
    z, a, b = [0] * n, 0, 0
    for i in range(1, n):
        k = min(b - i, z[i - a]) if i < b else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    if n:
        z[0] = n
    return z


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two rows have in common from their starts."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + step, min(4 * step, 1 << 16)
    return n


def squares(x: np.ndarray, periods: list[int]) -> list[tuple[int, int]]:
    """(period, Z-value) of the primitive squares that ``x`` starts with, of given ascending ``periods``.

    A period up to the Z-value of a smaller one is a multiple of it or none at all (Fine and Wilf).
    """
    out: list[tuple[int, int]] = []
    z = z_values(x.tolist()) if len(periods) > MANY else None
    past = 0
    for p in periods:
        if p > past and (k := z[p] if z else agreement(x, x[p:])) >= max(p, 2):
            out.append((p, k))
            past = k
    return out


def crossing(row: np.ndarray, half: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs inside segments of ``2 * half`` words that cross their midpoints.

    The length of ``row`` is a multiple of ``2 * half``; no run is longer than ``longest``.
    """
    block = min(half, max(4, longest))
    table = row.reshape(-1, 2 * half)
    for side in (1, -1):
        part = table[:, half : half + block] if side > 0 else table[:, half - block : half][:, ::-1]
        segment, period = np.nonzero(part[:, 1 : block // 2 + 1] == part[:, :1])
        period += 1
        first = segment * (2 * half) + (half if side > 0 else half - 1)
        for t in range(1, TOGETHER):
            if not len(period):
                break
            same = (t >= np.maximum(period, 2)) | (row[first + side * min(t, block - 1)] == row[first + side * np.minimum(period + t, block - 1)])
            segment, period, first = segment[same], period[same], first[same]
        ends = np.flatnonzero(np.diff(segment, append=-1)) + 1
        for a, b in zip(np.append(0, ends).tolist(), ends.tolist(), strict=False):
            middle = int(segment[a]) * 2 * half + half
            left, right = row[middle - half : middle][::-1], row[middle : middle + half]
            own = (right if side > 0 else left)[:block]
            for p, z in squares(own, period[a:b].tolist()):
                if side > 0:
                    start, end = middle - agreement(left, row[middle - half + p : middle + p][::-1]), middle + p + z
                else:
                    start, end = middle - p - z, middle + agreement(right, row[middle - p : middle - p + half])
                inside = not (start and row[start - 1] == row[start - 1 + p]) and not (end < len(row) and row[end] == row[end - p])
                if inside and end - start >= max(6, 4 * p):
                    yield start, end, p


def runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, given as word ids from 0, its runs (start, length, period) by start, then period.

    A run is a maximal stretch with smallest period q whose length is at least 6 and 4 * q.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = int((sizes + 1).sum())
    if not n or sizes.max() < 6:
        return [[] for _ in texts]
    row = -1 - np.arange(1 << max(3, n - 1).bit_length(), dtype=np.int64)  # separators and filling: all different
    for at, t in zip(starts.tolist(), texts, strict=True):
        row[at : at + len(t)] = t
    found: dict[tuple[int, int], int] = {}
    half = 4
    while 2 * half <= len(row):
        for start, end, p in crossing(row, half, int(sizes.max())):
            found[start, end] = min(p, found.get((start, end), p))
        half *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, end), p in found.items():
        k = int(np.searchsorted(starts, start, side="right")) - 1
        out[k].append((start - int(starts[k]), end - start, p))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each of ``n`` words stays when every run is collapsed to its first block."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, p in found:
        edges[start + p] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def drilled(n: int, id_: int | None) -> np.ndarray | None:
    """The contract's exercise: for every tenth id by crc32, which original word stands at each place; None if all stay."""
    h = zlib.crc32(str(id_).encode()) if id_ is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drill: bool = False) -> DataFrame:
    """(id, n_words, runs, collapsed) for every row: its runs as an array of (start, length, period) in words, and its words
    without what repeats in runs, joined by single spaces.

    Every run keeps its first block; a word goes if any run has it after that. Null and empty texts have no words and no
    runs; rows with null or repeated ids are treated one by one; an empty table stays empty. With ``drill``, words are
    first rearranged as ``drilled`` says. A text is searched whole, in memory of about 100 bytes a word.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, k in slices(batch.column("text"), TEXTS):
                ids = batch.column("id").slice(at, k)
                table: defaultdict[bytes, int] = defaultdict()
                table.default_factory = table.__len__
                coded = []
                for text, id_ in zip(binary(batch.column("text").slice(at, k)), ids.to_pylist(), strict=True):
                    x = np.concatenate([np.array(list(map(table.__getitem__, part)), np.int64) for part in word_parts(text or b"")])
                    if drill and (order := drilled(len(x), id_)) is not None:
                        x = x[order]
                    coded.append(x)
                words = list(table)
                found, collapsed = runs(coded), []
                for x, own in zip(coded, found, strict=True):
                    x = x[kept_words(len(x), own)] if own else x
                    parts = (b" ".join(map(words.__getitem__, x[j : j + JOINED].tolist())) for j in range(0, len(x), JOINED))
                    collapsed.append(b" ".join(parts).decode())
                spans = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in coded], pa.int64()), spans, pa.array(collapsed, pa.large_string())], ["id", "n_words", "runs", "collapsed"])

    kind = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(search, kind).withColumnRenamed("id", id_col)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) by ``collapse_runs`` with drill.

    The run shown is the longest, the first and of the smallest period among equals; without runs its columns are null.
    """
    got = collapse_runs(docs, id_col, text_col, drill=True)
    key = F.transform("runs", lambda r: F.struct((-r["length"]).alias("longest"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    top = got.withColumn("top", F.array_min(key)).withColumn("listed", F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")))
    return top.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"), (-F.col("top.longest")).alias("length"), F.col("top.period").alias("period"),
        F.floor(F.lit(1000) * -F.col("top.longest") / F.col("top.period")).alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
