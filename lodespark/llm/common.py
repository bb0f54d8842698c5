"""What the operators of this subpackage share: reading, the shared folder, cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a longest run of bytes other than space and \\t..\\r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where unset (local tests), one of our own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "lodespark-checkpoints"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, so that it is computed once and survives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


#: With it, Spark removes a query's shuffle files when the query ends rather than when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from a table of its own in the shared folder: like ``cut``, but compressed and read by column.

    For wide results that are read in parts. The shuffle files that made it go at once; the table stays until the shared
    folder is cleared.
    """
    at = fresh_dir(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def keyed(rows: DataFrame, id_col: str, key: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``rows`` with a column ``key`` that is never null and orders as the ids do, rows without an id last, each its own; and how to get the id from a key.

    The key is the id itself, or (number of a row without an id or -1, id) in a struct where such rows exist. These are numbered once,
    in a table in the shared folder, so that a lost executor can't number them anew; other rows are not copied.
    """
    own = F.col(id_col)
    none = rows.where(own.isNull())
    if none.isEmpty():
        return rows.withColumn(key, own), lambda c: c
    # fields in alphabetical order: unionByName puts those of structs in that order on one side if only nullability differs
    pair = lambda n: F.struct(n.alias("at"), own.alias("id"))
    numbered = written(none.withColumn(key, pair(F.monotonically_increasing_id())), "rows-without-id")
    known = rows.where(own.isNotNull()).withColumn(key, pair(F.lit(-1).cast("bigint")))
    return known.unionByName(numbered), lambda c: c["id"]


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of rows with about ``most`` bytes together; what a task makes of one is gone before the next."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop - at
        at = stop


def binary(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


#: Bytes of a text that are split into words at a time, and where the next part may begin.
PART = 1 << 20
_BREAK = re.compile(rb"[\x20\x09-\x0d]")


def word_parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text (WORD) in order, as lists of those in about PART bytes each."""
    at = 0
    while len(text) - at > PART:
        found = _BREAK.search(text, at + PART)
        if not found:
            break
        yield text[at : found.start()].split()
        at = found.end()
    yield (text[at:] if at else text).split()
