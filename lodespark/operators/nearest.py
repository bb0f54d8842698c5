"""The best k vectors of every query, by several scores at once, in blocks of pairs.

Queries are a small part of the vectors and go to every task; a task holds its vectors against them block by block and
keeps, for each query, only what can still be among the best k. A product of matrices in single precision and a bound on
its error leave out nearly all pairs once a query has k results; the others' products are added in the order of the
components, as ``functions.vectors.dot`` does, so the scores are those of the plain expression, bit for bit. Memory is a
block of pairs, whatever the tables' sizes; the number of products is queries x vectors, as for any exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lodespark.functions import vectors as V

#: Vectors and queries of a packed block, and those of a tile of pairs that is scored at a time.
BLOCK, QUERIES, TILE, ROWS = 8192, 256, 8192, 32
#: Share of a tile's pairs from which all are scored.
MANY = 0.1
#: Scores are rounded to 9 places by the caller: what may round to the k-th best lies within this of it.
SLACK = 2e-9


def _packer(n_norms: int, most: int):
    """Rows (id, e, label, n0, ...) as blocks of vectors of one length, components first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}

        def block(dim: int, t: pa.Table) -> pa.RecordBatch:
            e = t.column("e").combine_chunks()
            flat = e.flatten() if dim > 0 else pa.array([], pa.float64())
            x = np.ascontiguousarray(flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(t), max(dim, 0)).T)
            norms = np.stack([t.column(f"n{k}").combine_chunks().to_numpy(zero_copy_only=False).astype(float) for k in range(n_norms)])
            null = np.stack([t.column(f"n{k}").combine_chunks().is_null().to_numpy(zero_copy_only=False) for k in range(n_norms)])
            label = t.column("label").combine_chunks()
            row = (
                dim, t.column("id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), label.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
                label.is_null().to_numpy(zero_copy_only=False).tobytes(), np.where(null, 0.0, norms).tobytes(), null.tobytes(), x.tobytes(),
            )
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k == 0 else pa.binary()) for k, v in enumerate(row)], names=["dim", "ids", "labels", "unlabelled", "norms", "holes", "x"])

        for b in batches:
            t = pa.Table.from_batches([b])
            sizes = np.where(t.column("e").combine_chunks().is_null().to_numpy(zero_copy_only=False), -1, pc.fill_null(pc.list_value_length(t.column("e").combine_chunks()), 0).to_numpy(zero_copy_only=False))
            for dim in np.unique(sizes):
                part = t.take(pa.array(np.flatnonzero(sizes == dim)))
                held.setdefault(int(dim), []).append(part)
                if sum(len(p) for p in held[int(dim)]) >= most:
                    whole = pa.concat_tables(held.pop(int(dim)))
                    at = 0
                    while len(whole) - at >= most:
                        yield block(int(dim), whole.slice(at, most).combine_chunks())
                        at += most
                    if at < len(whole):
                        held[int(dim)] = [whole.slice(at).combine_chunks()]
        for dim, parts in held.items():
            yield block(dim, pa.concat_tables(parts).combine_chunks())

    return pack


class _Block:
    """A packed block again as arrays."""

    def __init__(self, row: dict, p: str, n_norms: int):
        self.dim, self.ids, self.labels = row[p + "dim"], np.frombuffer(row[p + "ids"], np.int64), np.frombuffer(row[p + "labels"], np.int64)
        self.unlabelled = np.frombuffer(row[p + "unlabelled"], bool)
        self.norms, self.holes = np.frombuffer(row[p + "norms"]).reshape(n_norms, -1), np.frombuffer(row[p + "holes"], bool).reshape(n_norms, -1)
        self.x = np.frombuffer(row[p + "x"]).reshape(max(self.dim, 0), len(self.ids))


def _cosine(total: np.ndarray | None, nv: np.ndarray, nq: np.ndarray, hole: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Cosines as ``functions.vectors.cosine`` has them: 0 without a norm above 0 (NaN counts as above) or for other lengths."""
    if total is None:
        return np.zeros(np.broadcast_shapes(nv.shape, nq.shape)), None
    with np.errstate(all="ignore"):
        return np.where(~(nv <= 0) & ~(nq <= 0), total / (nv * nq), 0.0), None


def _projection(total: np.ndarray | None, nv: np.ndarray, nq: np.ndarray, hole: np.ndarray) -> tuple[np.ndarray, np.ndarray | None] | None:
    """Dot products over the query's norm; null for vectors with null components, nothing for other lengths."""
    if total is None:
        return None
    with np.errstate(all="ignore"):
        return total / nq, np.broadcast_to(hole, total.shape)


def _unit(b: _Block, s: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's first w components over their norm in single precision (0 without one), and the vectors that no bound on products holds for."""
    n = b.norms[s]
    odd = b.holes[s] | ~((n == 0) | ((n > 1e-140) & (n < 1e140)))
    x = np.divide(b.x[:w], n, out=np.zeros((w, len(n))), where=~odd & (n > 0))
    return x.astype(np.float32), odd


def best_places(key: np.ndarray, ids: np.ndarray, k: int, descending: bool, slack: float = SLACK) -> tuple[np.ndarray, float]:
    """Places of what may be among the best k after rounding, and the k-th best: of equal scores the first k by id do."""
    if len(key) <= k:
        return np.arange(len(key)), -np.inf
    least = np.partition(key, len(key) - k)[len(key) - k]
    near = np.flatnonzero(key >= least - slack)
    near = near[np.lexsort((-ids[near] if descending else ids[near], -key[near]))]
    sorted_key = key[near]
    fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(near)), 0))
    return near[np.arange(len(near)) - start < k], least


def _searcher(lengths: list[int | None], k: int, score, others: bool, descending: bool, margin: tuple[float, float] | None = None):
    searched = range(len(lengths) if margin is None else 1)  # with a margin the second system's scores only go along

    def reach(bar: np.ndarray) -> np.ndarray:
        """The least score that is kept for this k-th best."""
        if margin is None:
            return bar
        bar = np.minimum(bar, 1.0)
        return np.where(bar > margin[1], bar - margin[0], -np.inf)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[bytes, np.ndarray] = {}  # by block of queries: the k-th best so far, a bound for later blocks
        for batch in batches:
            for row in batch.to_pylist():
                v, q = _Block(row, "v_", len(lengths)), _Block(row, "q_", len(lengths))
                floor = floors.setdefault(row["q_ids"], np.full((len(lengths), len(q.ids)), -np.inf))
                yield from _block(v, q, floor)

    def _block(v: _Block, q: _Block, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
        wanted = [max(v.dim, 0) if n is None else min(max(v.dim, 0), n) for n in lengths]
        equal = [v.dim >= 0 and q.dim >= 0 and w == (q.dim if n is None else min(q.dim, n)) for n, w in zip(lengths, wanted, strict=True)]
        held: list[list[list]] = [[[] for _ in q.ids] for _ in lengths]
        sizes = np.zeros((len(lengths), len(q.ids)), np.int64)
        room = np.full((len(lengths), len(q.ids)), 4 * k)

        def settle(s: int, r: int) -> None:
            key, at, value, hole = (np.concatenate(c) for c in zip(*held[s][r], strict=True))
            if margin is None:
                keep, least = best_places(key, v.ids[at], k, descending)
            else:
                least = np.partition(key, len(key) - k)[len(key) - k] if len(key) > k else -np.inf
                keep = np.flatnonzero(key >= reach(least) - SLACK)
            floor[s, r] = max(floor[s, r], least)
            held[s][r] = [(key[keep], at[keep], value[keep], hole[keep])]
            sizes[s, r] = len(keep)
            room[s, r] = max(4 * k, 2 * len(keep))

        def products(at: slice, rows: slice, lengths: set[int]) -> dict[int, np.ndarray]:
            """All products of a tile, added in the order of components, after each of these numbers of them."""
            total = np.zeros((rows.stop - rows.start, at.stop - at.start))
            part, kept = np.empty_like(total), {0: np.zeros_like(total)}
            with np.errstate(all="ignore"):
                for d in range(max(lengths, default=0)):
                    np.multiply(q.x[d, rows, None], v.x[d, at], out=part)
                    np.add(total, part, out=total)
                    if d + 1 in lengths:
                        kept[d + 1] = total.copy()
            return kept

        def summed(w: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
            """The same for some pairs."""
            total = np.zeros(len(r))
            with np.errstate(all="ignore"):
                for d in range(w):
                    total += q.x[d, r] * v.x[d, c]
            return total

        def screened(s: int, at: slice, rows: slice) -> tuple[np.ndarray, np.ndarray] | None:
            """Pairs that can reach the bound of their query, by one product of matrices and the most that its rounding takes away; None where these are many."""
            (x, odd), (y, strange) = units[s]
            bar = floor[s, rows]
            off = (2 * wanted[s] + 8) * 2.0**-23
            loose = odd[at][None, :] | strange[rows][:, None]
            with np.errstate(all="ignore"):
                near = y[:, rows].T @ x[:, at]
                n = np.where(odd[at], 0.0, v.norms[s, at]) if score is _projection else None
                if not np.isfinite(bar).all():  # the k-th best here, at the least that it can be, is a bound as well
                    if near.shape[1] <= k:
                        return None
                    low = near - off if n is None else (near - off) * n
                    low = np.where(loose | (v.ids[at][None, :] == q.ids[rows][:, None] if others else False), -np.inf, low)
                    bar = np.maximum(bar, np.partition(low, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
                bar = reach(bar)
                if n is None:
                    ok = ~(near < (bar - 2 * SLACK - off).astype(np.float32)[:, None])
                else:
                    ok = ~((near + off) * n < (bar - 2 * SLACK)[:, None] - off * n)
            ok |= loose
            return np.nonzero(ok) if ok.mean() < MANY else None

        def add(s: int, r: np.ndarray, c: np.ndarray, found: tuple[np.ndarray, np.ndarray | None]) -> None:
            """Holds what reaches the bounds of its query."""
            value, hole = found
            hole = np.zeros(value.shape, bool) if hole is None else hole
            key = np.where(hole, -np.inf, np.where(np.isnan(value), np.inf, value))
            ok = key >= reach(floor[s, r]) - SLACK
            if others:
                ok &= v.ids[c] != q.ids[r]
            r, c, key, value, hole = r[ok], c[ok], key[ok], value[ok], hole[ok]
            ends = np.flatnonzero(np.diff(r, append=-1)) + 1  # r is sorted
            for start, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True) if len(r) else ():
                k, part = r[start], slice(start, end)
                held[s][k].append((key[part], c[part], value[part], hole[part]))
                sizes[s, k] += end - start
                if sizes[s, k] > room[s, k]:
                    settle(s, k)

        units = [(_unit(v, s, w), _unit(q, s, w)) if equal[s] else None for s, w in enumerate(wanted)]
        for a in range(0, len(v.ids), TILE):
            at = slice(a, min(a + TILE, len(v.ids)))
            for b in range(0, len(q.ids), ROWS):
                rows = slice(b, min(b + ROWS, len(q.ids)))
                close = [screened(s, at, rows) if equal[s] else None for s in searched]
                kept = products(at, rows, {wanted[s] for s in searched if equal[s] and close[s] is None})
                for s in searched:
                    w = wanted[s]
                    if close[s] is not None:
                        r, c = close[s]
                        add(s, r + b, c + a, score(summed(w, r + b, c + a), v.norms[s, c + a], q.norms[s, r + b], v.holes[s, c + a]))
                        continue
                    found = score(kept[w] if equal[s] else None, v.norms[s, at][None, :], q.norms[s, rows][:, None], v.holes[s, at][None, :])
                    if found is not None:
                        value, hole = found
                        r, c = np.indices(value.shape).reshape(2, -1)
                        add(s, r + b, c + a, (value.reshape(-1), None if hole is None else hole.reshape(-1)))
        out = []
        for s in searched:
            for r in range(len(q.ids)):
                if held[s][r]:
                    settle(s, r)
                    _, at, value, hole = held[s][r][0]
                    out.append((np.full(len(at), s, np.int32), np.full(len(at), r), at, value, hole))
        if out:
            s, r, at, value, hole = (np.concatenate(c) for c in zip(*out, strict=True))
            arrays = [pa.array(s), pa.array(q.ids[r]), pa.array(v.ids[at]), pa.array(value, mask=hole), pa.array(q.labels[r], mask=q.unlabelled[r]), pa.array(v.labels[at], mask=v.unlabelled[at])]
            if margin is None:
                arrays.append(pa.nulls(len(at), pa.float64()))
            else:
                also, hole = score(summed(wanted[1], r, at) if equal[1] else None, v.norms[1, at], q.norms[1, r], v.holes[1, at])
                arrays.append(pa.array(also, mask=hole))
            yield pa.RecordBatch.from_arrays(arrays, names=["s", "query_id", "doc_id", "score", "query_label", "label", "also"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int, lengths: dict[str, int | None], measure: str = "cosine", others: bool = True, descending_ids: bool = False, margin: tuple[float, float] | None = None) -> DataFrame:
    """(system, query_id, doc_id, score, query_label, label): what can be among a query's best k, at the score rounded to 9 places.

    Vectors and queries are (id, e array<double>, label); rows without an id are left out. A system of ``lengths`` scores
    the first so many components (None: all). ``measure`` is the cosine or the ``projection`` on the query, whose norm
    is above 0. ``others``: a query is not its own result. Take the best k with ``top_ranked``.

    With a ``margin`` (m, l) and two systems, only the first's cosines are searched: every vector within m of the k-th best
    is given, all of them while the k-th best is not above l, and the second's score goes along as ``also``.
    """
    norms = [V.norm(F.col("e") if n is None else F.slice("e", 1, n)).alias(f"n{j}") for j, n in enumerate(lengths.values())]
    ready = lambda t: t.where("id IS NOT NULL").select(F.col("id").cast("bigint").alias("id"), "e", F.col("label").cast("bigint").alias("label"), *norms)
    schema = "dim int, ids binary, labels binary, unlabelled binary, norms binary, holes binary, x binary"
    pack = lambda t, p, most: (lambda b: b.select(*(F.col(c).alias(p + c) for c in b.columns)))(t.mapInArrow(_packer(len(lengths), most), schema))
    v = pack(ready(vectors).repartition("id"), "v_", BLOCK)  # one file of vectors is still work for many tasks
    pairs = v.crossJoin(F.broadcast(pack(ready(queries), "q_", QUERIES)))
    search = _searcher(list(lengths.values()), k, {"cosine": _cosine, "projection": _projection}[measure], others, descending_ids, margin)
    found = pairs.mapInArrow(search, "s int, query_id bigint, doc_id bigint, score double, query_label bigint, label bigint, also double")
    also = [] if margin is None else [F.round("also", 9).alias("also")]
    return found.select(F.get(F.array(*map(F.lit, lengths)), "s").alias("system"), "query_id", "doc_id", F.round("score", 9).alias("score"), "query_label", "label", *also)


def top_ranked(found: DataFrame, k: int, descending_ids: bool = False) -> DataFrame:
    """The best k of each system and query with their ranks; ties by id."""
    order = Window.partitionBy("system", "query_id").orderBy(F.col("score").desc(), F.col("doc_id").desc() if descending_ids else F.col("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
