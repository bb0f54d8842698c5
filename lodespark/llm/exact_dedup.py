"""Exact deduplication over a cuckoo-filter index of live digests.

Shape of the job: every row becomes its text's SHA-256 in the JVM; each map task folds its rows into partial
groups through a ``CuckooIndex`` (so a text that fills a third of the table leaves each task once); the partials are
shuffled by digest, folded again by the same index, and joined back to the narrow (id, digest) rows. Texts never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Slots of a filter bucket, and how many evictions an insertion may cause before the filter counts as full.
SLOTS, MAX_KICKS = 4, 200
#: Keys that a task folds before it passes their groups on; bounds its memory.
PARTIAL_KEYS = 100_000


class CuckooIndex:
    """Live digests behind a cuckoo filter of 16-bit fingerprints.

    The filter answers "surely absent" without touching the stored keys. A hit is only a maybe, so it is verified
    against the content kept in buckets of the digest's first bits. Insertions that would evict too long, and a load
    above 90 %, resize the filter: it is refilled at twice the size from the stored keys.
    """

    def __init__(self, capacity: int = 1024):
        self.content: dict[int, dict[bytes, list]] = {}
        self.size = self.resizes = 0
        self._fresh(max(8, capacity))

    def _fresh(self, capacity: int) -> None:
        self.mask = (1 << int(np.ceil(np.log2(capacity / SLOTS)))) - 1 if capacity > SLOTS else 0
        self.table: list[list[int]] = [[] for _ in range(self.mask + 1)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:8], "big") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & self.mask

    def _bucket(self, digest: bytes) -> int:
        return int.from_bytes(digest[8:11], "big")

    def maybe(self, digest: bytes) -> bool:
        """The filter's answer alone; never False for a live digest."""
        mark, a, b = self._places(digest)
        return mark in self.table[a] or mark in self.table[b]

    def get(self, digest: bytes) -> list | None:
        """The value of a live digest (verified), else None."""
        return self.content.get(self._bucket(digest), {}).get(digest) if self.maybe(digest) else None

    def insert(self, digest: bytes, value: list) -> bool:
        """Adds a digest that is not live yet; False, and no change, if it is."""
        if self.get(digest) is not None:
            return False
        self.content.setdefault(self._bucket(digest), {})[digest] = value
        self.size += 1
        if self.size > 0.9 * SLOTS * len(self.table) or not self._place(digest):
            self._resize()
        return True

    def delete(self, digest: bytes) -> bool:
        """Removes a live digest; False if it is not live."""
        if self.get(digest) is None:
            return False
        bucket = self.content[self._bucket(digest)]
        del bucket[digest]
        if not bucket:
            del self.content[self._bucket(digest)]
        mark, a, b = self._places(digest)
        self.table[a if mark in self.table[a] else b].remove(mark)
        self.size -= 1
        return True

    def _place(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for at in (a, b):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        at = b
        for kick in range(MAX_KICKS):
            slot = self.table[at]
            slot[kick % SLOTS], mark = mark, slot[kick % SLOTS]
            at = self._other(at, mark)
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        return False

    def _resize(self) -> None:
        capacity = SLOTS * len(self.table)
        while True:
            capacity *= 2
            self.resizes += 1
            self._fresh(capacity)
            if all(self._place(d) for d, _ in self.items()):
                return

    def items(self) -> Iterator[tuple[bytes, list]]:
        for bucket in self.content.values():
            yield from bucket.items()


def _schema(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("keep", id_type)])


def _flush(index: CuckooIndex, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    for at in range(0, len(rows), 20_000):
        part = rows[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], schema.field("keep").type)], schema=schema)


def _fold(keys: int, ordered: bool = False):
    """A mapInArrow function that folds (digest, n, keep) rows by digest, passing groups on whenever ``keys`` are live.

    ``ordered`` rows come sorted by digest, so a group is complete once another digest follows, and no group is passed on
    in two parts.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, schema = CuckooIndex(), None
        for batch in batches:
            schema = schema or _schema(batch.schema.field("keep").type)
            for digest, n, keep in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "keep")), strict=True):
                if (known := index.get(digest)) is None:
                    if ordered and index.size >= keys:
                        yield from _flush(index, schema)
                        index = CuckooIndex()
                    index.insert(digest, [n, keep])
                else:
                    known[0] += n
                    known[1] = keep if known[1] is None else known[1] if keep is None else max(known[1], keep)
            if not ordered and index.size >= keys:
                yield from _flush(index, schema)
                index = CuckooIndex()
        if schema:
            yield from _flush(index, schema)

    return fold


def live_index(digests: DataFrame) -> DataFrame:
    """(digest, n, keep): one row for each digest of (digest binary, n, keep), with summed n and the largest keep."""
    kind = f"digest binary, n bigint, keep {digests.schema['keep'].dataType.simpleString()}"
    partial = digests.mapInArrow(_fold(PARTIAL_KEYS), kind)
    return partial.repartition("digest").sortWithinPartitions("digest").mapInArrow(_fold(PARTIAL_KEYS, ordered=True), kind)


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The live index after ``inserted`` (digest, n, keep) rows came and the digests of ``deleted`` went.

    All three are co-partitioned by digest; deletions apply to what was live before the insertions. A digest deleted
    and inserted in the same call is live with the inserted counts. Deleting an unknown digest changes nothing.
    """
    kind = f"digest binary, n bigint, keep {index.schema['keep'].dataType.simpleString()}"
    none = F.lit(None).cast(index.schema["keep"].dataType)
    rows = (
        index.select("digest", "n", "keep", F.lit(0).alias("op"))
        .unionByName(deleted.select("digest", F.lit(0).cast("bigint").alias("n"), none.alias("keep"), F.lit(1).alias("op")))
        .unionByName(inserted.select("digest", "n", "keep", F.lit(2).alias("op")))
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, schema = CuckooIndex(), None
        for batch in batches:
            schema = schema or _schema(batch.schema.field("keep").type)
            for digest, n, keep, op in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "keep", "op")), strict=True):
                if op == 1:
                    live.delete(digest)
                elif (known := live.get(digest)) is None:
                    live.insert(digest, [n, keep])
                else:
                    known[0] += n
                    known[1] = keep if known[1] is None else known[1] if keep is None else max(known[1], keep)
        if schema:
            yield from _flush(live, schema)

    return rows.repartition("digest").sortWithinPartitions("op").mapInArrow(apply, kind)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to the id of every row.

    Texts are equal when identical; null counts as empty. Of equal texts the largest id stays (a null id only if no
    other has the text). Rows that repeat both id and text are one document: each of them is returned with the same
    decision, and each counts in group_size. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"))
    groups = live_index(rows.select("digest", F.lit(1).cast("bigint").alias("n"), F.col("id").alias("keep")))
    return rows.join(groups, "digest").select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
