"""Vector search over a quantised index, and embeddings by signed feature hashing.

An index row holds a vector's direction in 2 or 4 bits a component, its scale, and the length of what quantising lost.
A search multiplies blocks of codes with blocks of queries inside tasks. The codes give each cosine up to an error whose
size is known, so a task sends only those rows that may still be among its best k; after one shuffle by query the exact
cosine of what is left decides.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StructField, StructType

from lodespark.functions import vectors as V

#: Queries that a task multiplies with at once (the driver holds as many), and index rows in a block.
QUERIES, BLOCK = 1024, 4096
#: Standard deviations of the quantisation error that a row's cosine may be off. 4.5 lose a neighbour once in 10^5.
SLACK = 4.5


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of vectors of equal length; null and empty ones and those with a component null or not finite are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components are not a number
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        x = values[starts[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).all(1)
        yield rows[good], x[good]


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _pack(codes: np.ndarray, bits: int) -> np.ndarray:
    each = 8 // bits
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % each)))
    shifts = (np.arange(codes.shape[1]) % each * bits).astype(np.uint8)
    return (codes << shifts).reshape(len(codes), -1, each).sum(2, dtype=np.uint8)


def _unpack(data: np.ndarray, bits: int, size: int) -> np.ndarray:
    shifts = np.arange(8 // bits, dtype=np.uint8) * bits
    return ((data[:, :, None] >> shifts) & (2**bits - 1)).reshape(len(data), -1)[:, :size]


def build_index(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", bits: int = 4) -> DataFrame:
    """(id, size, scale, lost, codes): one row for each usable vector; write it as a table to keep it.

    Vectors that are null or empty, or hold a component that is null or not finite, are not indexed. A zero vector is: its
    cosine with everything counts as 0. ``bits`` is 2 or 4.
    """
    if bits not in (2, 4):
        raise ValueError("bits must be 2 or 4")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    top = 2**bits - 1

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which, x in _matrices(batch.column("vector")):
                x = _unit(x)
                scale = np.abs(x).max(1, keepdims=True)
                codes = np.rint((np.divide(x, scale, out=np.zeros_like(x), where=scale > 0) + 1) / 2 * top).astype(np.uint8)
                lost = np.linalg.norm(x - (2 * codes / top - 1) * scale, axis=1)
                packed = _pack(codes, bits)
                data = pa.array([r.tobytes() for r in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(which)), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(scale[:, 0].astype(np.float32)), pa.array(lost.astype(np.float32)), data], ["id", "size", "scale", "lost", "codes"])

    kind = StructType([StructField("id", rows.schema["id"].dataType), StructField("size", IntegerType()), StructField("scale", FloatType()), StructField("lost", FloatType()), StructField("codes", BinaryType())])
    return rows.mapInArrow(code, kind)


def _candidates(index: DataFrame, ids: list, queries: np.ndarray, k: int, bits: int, slack: float, others_only: bool) -> DataFrame:
    """(query_id, id, low, high): rows that may be among the best k of a task, with bounds of their cosine."""
    size, top = queries.shape[1], 2**bits - 1
    kind = index.schema["id"].dataType

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.astype(np.float32).T
        own = pd.Index(ids)
        best = np.full((k, q.shape[1]), -np.inf, np.float32)  # the k largest lower bounds of each query so far
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                part = part.filter(pc.equal(part.column("size"), size))
                if not part.num_rows:
                    continue
                data = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                scale, lost = part.column("scale").to_numpy(), part.column("lost").to_numpy()
                near = ((2 * _unpack(data, bits, size).astype(np.float32) / top - 1) * scale[:, None]) @ q
                off = (slack * lost / np.sqrt(size))[:, None]
                low, high = near - off, near + off
                names = part.column("id").to_pylist()
                if others_only:
                    mine = own.get_indexer(names)
                    there = np.flatnonzero(mine >= 0)
                    low[there, mine[there]] = high[there, mine[there]] = -np.inf
                best = np.partition(np.concatenate([best, low]), len(low), axis=0)[-k:]
                row, query = np.nonzero((high >= best.min(0)) & (high > -np.inf))
                held.append((np.array(names, dtype=object)[row], query, low[row, query], high[row, query]))
        least = best.min(0)
        for names, query, low, high in held:
            keep = high >= least[query]
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array([ids[j] for j in query[keep].tolist()], type=arrow), pa.array(names[keep].tolist(), type=arrow), pa.array(low[keep].astype(float)), pa.array(high[keep].astype(float))], ["query_id", "id", "low", "high"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    return index.mapInArrow(search, StructType([StructField("query_id", kind), StructField("id", kind), StructField("low", DoubleType()), StructField("high", DoubleType())]))


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "id", vector_col: str = "vector", bits: int = 4, slack: float = SLACK, others_only: bool = False) -> DataFrame:
    """(query_id, id, cosine, rank): the ``k`` rows of the index nearest to each query by exact cosine, ties by id.

    ``queries`` is (query_id, vector) with ids of the type of the index's; the driver reads it in blocks of QUERIES, and
    each block is one pass over the index. Unusable queries find nothing. ``vectors`` is the table that the index was
    built from; only candidates' vectors are read again. With ``others_only`` a query does not find the row of its own id.
    The result is exact but for rows whose quantisation error exceeds ``slack`` standard deviations.
    """
    blocks: list[DataFrame] = []
    rows = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).toLocalIterator()
    while part := list(islice(rows, QUERIES)):
        column = pa.array([r.vector for r in part], pa.list_(pa.float64()))
        for which, x in _matrices(column):
            if len(which):
                blocks.append(_candidates(index, [part[j].query_id for j in which.tolist()], _unit(x), k, bits, slack, others_only))
    found = blocks[0] if blocks else index.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("low"), F.lit(0.0).alias("high")).limit(0)
    for b in blocks[1:]:
        found = found.unionByName(b)
    nth = F.nth_value("low", k).over(Window.partitionBy("query_id").orderBy(F.col("low").desc(), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = found.withColumn("least", nth).where("least IS NULL OR high >= least").select("query_id", "id")
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))
    cosine = F.round(V.cosine(F.col("v"), F.col("q")), 9)
    exact = near.join(own, "id").join(asked, "query_id").select("query_id", "id", cosine.alias("cosine"))
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_TOKEN = re.compile(r"[a-zA-Z0-9_]+")


def hashed_embeddings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: int = 256, normalized: bool = True) -> DataFrame:
    """(id, embedding array<double>): signed feature hashing of a text's tokens.

    Each token ``[a-zA-Z0-9_]+`` of the case-folded text adds 1 or -1 to the component that its BLAKE2b digest of 8 bytes
    names: the first four bytes, big-endian, modulo ``dimensions``; the sign is that of the fifth byte's lowest bit. Unless
    told otherwise vectors are scaled to length 1. Null texts and texts without tokens give zero vectors.
    """
    if dimensions < 1:
        raise ValueError("dimensions must be at least 1")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: dict[str, tuple[int, float]] = {}  # of the tokens of this batch
            out = np.zeros((batch.num_rows, dimensions))
            for k, text in enumerate(batch.column("text")):
                for token in _TOKEN.findall((text.as_py() or "").casefold()):
                    if (place := places.get(token)) is None:
                        digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
                        place = places[token] = int.from_bytes(digest[:4], "big") % dimensions, 1.0 - 2.0 * (digest[4] % 2)
                    out[k, place[0]] += place[1]
            if normalized:
                out = np.array([r / n if (n := math.sqrt(float(r @ r))) else r for r in out]).reshape(out.shape)
            offsets = np.arange(0, out.size + 1, dimensions, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["id", "embedding"])

    kind = StructType([StructField(id_col, rows.schema["id"].dataType), StructField("embedding", ArrayType(DoubleType()))])
    return rows.mapInArrow(lambda b: (x.rename_columns([id_col, "embedding"]) for x in embed(b)), kind)
