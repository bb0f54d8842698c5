"""Quality of whole texts: random Fourier features over document statistics, ridge, isotonic calibration.

Statistics of the whole text are turned into cosines of random projections, whose products approximate a Gaussian
kernel. Ridge regression on them needs Z'Z and Z'y only: each task sums its rows' share, Spark adds the shares, and the
driver solves a system whose size is the number of features. Scores of labelled rows are counted in a fixed number of
bins, and isotonic regression over the bins turns a score into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodespark.llm.common import cut

#: Random features, kernel width in standard deviations of the statistics, ridge, bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1.0, 512
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KIND = np.zeros(256, np.int8)  # 1 lower, 2 upper, 3 digit, 4 other printable ASCII, 5 part of a longer character, 0 space and control
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
_MARKS = [ord(c) for c in ".,!?$%&*#|@/:-()\"'"]
STATISTICS = 14 + len(_MARKS)


def statistics(data: bytes) -> np.ndarray:
    """Statistics of a whole text, all finite; an empty text has zeros."""
    out = np.zeros(STATISTICS)
    if not data:
        return out
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    counts = np.bincount(b, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=6) / n
    space = _SPACE[b]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    n_words = max(1, len(starts))
    lengths = ends - starts
    lines = data.split(b"\n")
    distinct_lines, distinct_words = len(set(lines)), len(set(data.split())) or 1
    capital = (_KIND[b[starts]] == 2).mean() if len(starts) else 0.0
    inner = ((_KIND[b[ends - 1]] == 4).sum() / n_words) if len(starts) else 0.0
    out[:14] = [np.log1p(n), kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], space.mean(), lengths.mean() if len(starts) else 0.0, lengths.std() if len(starts) else 0.0, distinct_lines / len(lines), np.log(distinct_words) / np.log(n_words + 1), capital, inner, np.log1p(n / len(lines))]
    out[14:] = np.minimum(1.0, 5 * np.sqrt(counts[_MARKS] / n))
    return out


class Fourier:
    """Standardised statistics to features; random but fixed by the seed."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones(len(z))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, STATISTICS)


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, stats): the statistics of every whole text as packed doubles."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t or b"").astype("<f8").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(stats, pa.binary())], ["id", "stats"])

    return rows.mapInArrow(measure, f"id {rows.schema['id'].dataType.simpleString()}, stats binary")


def _summed(rows: DataFrame, columns: list[str], share) -> dict[int, np.ndarray]:
    """Adds the vectors that ``share(batch)`` gives by key over all batches: first in each task, then in Spark by key."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for key, v in share(batch):
                    total[key] = total.get(key, 0) + v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([np.asarray(v, "<f8").tobytes() for v in total.values()], pa.binary())], ["key", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, part in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist(), strict=True):
                total[key] = total.get(key, 0) + np.frombuffer(part, "<f8")
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["key", "part"])

    kind = "key bigint, part binary"
    parts = rows.select(*columns).mapInArrow(local, kind).repartition("key").mapInArrow(add, kind)
    return {r.key: np.frombuffer(r.part, "<f8") for r in parts.collect()}  # one row for each key: a fixed number


def pool_adjacent(positive: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Isotonic means of positive / count over bins in order; bins without rows take their neighbours'."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(count):
        blocks.append([positive[k], count[k], k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, c, at = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + c, at]
    if not blocks:
        return np.full(len(count), 0.5)
    ends = np.array([x[2] for x in blocks])
    # a little smoothing keeps a block without negatives from certainty
    means = np.array([(p + 0.5) / (c + 1) for p, c, _ in blocks])
    means = np.maximum.accumulate(means)
    return means[np.minimum(np.searchsorted(ends, np.arange(len(count))), len(blocks) - 1)]


def held_out(id_col: str = "id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame):
    """A function from a matrix of statistics to probabilities, learnt from (id, label) rows that are not held out."""
    known = labels.where(F.col("label").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    rows = cut(stats.where(~held_out()).join(known, "id").select("stats", F.col("label").cast("double").alias("y"), F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("fold")))

    def moments(batch):
        x = _matrix(batch.column("stats"))
        yield 0, np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    m = _summed(rows, ["stats"], moments).get(0)
    if m is None:
        return lambda x: np.full(len(x), 0.5)
    n, s, ss = m[0], m[1 : 1 + STATISTICS], m[1 + STATISTICS :]
    fourier = Fourier(s / n, np.sqrt(np.maximum(ss / n - (s / n) ** 2, 0)))

    d = FEATURES + 1

    def normal(batch):
        z, y, fold = fourier(_matrix(batch.column("stats"))), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        for f in (0, 1):  # a key for each row of the system spreads the sums
            here = fold == f
            yield from enumerate(np.column_stack([z[here].T @ z[here], z[here].T @ y[here]]), f * d)

    g = _summed(rows, ["stats", "y", "fold"], normal)
    halves = [np.stack([g[f * d + k] for k in range(d)]) for f in (0, 1)]
    ridge = RIDGE * np.eye(d)
    ridge[-1, -1] = 1e-6
    solve = lambda system: np.linalg.solve(system[:, :d] + ridge, system[:, d])
    beta = solve(halves[0] + halves[1])
    # the curve is learnt from scores that their own labels had no part in; a half without rows has no scores to give
    other = [solve(halves[1 - f]) if halves[1 - f][-1, -2] else beta for f in (0, 1)]

    def bins(x: np.ndarray, by: np.ndarray = beta) -> np.ndarray:
        return np.clip(((fourier(x) @ by + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)

    def histogram(batch):
        x, y, fold = _matrix(batch.column("stats")), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        k = np.where(fold == 0, bins(x, other[0]), bins(x, other[1]))
        yield 0, np.concatenate([np.bincount(k, weights=y, minlength=BINS), np.bincount(k, minlength=BINS)])

    h = _summed(rows, ["stats", "y", "fold"], histogram)[0]
    curve = pool_adjacent(h[:BINS], h[BINS:])
    return lambda x: curve[bins(x)]


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", cutoff: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Only the text enters a score. Null and empty texts have statistics of zero and are scored like any other; so are
    rows with a null id, which are never learnt from. Of several labels of one document the largest counts; null labels
    are no labels. Without any label every score is 0.5. Repeated rows get equal scores.
    """
    stats = cut(with_statistics(docs, id_col, text_col))
    model = fit(stats, labels.select(F.col(label_id).alias("id"), F.col(label_col).alias("label")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model(_matrix(batch.column("stats"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(p, pa.float64())], ["id", "held_out", "score"])

    rows = stats.select("id", held_out().alias("held_out"), "stats")
    scored = rows.mapInArrow(score, f"id {stats.schema['id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
