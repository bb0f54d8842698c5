"""Removes byte strings that repeat anywhere in the corpus, by merged Burrows-Wheeler transforms of candidate passages.

Every start of a ``length``-byte string is dealt to an anchor: the window of ``ANCHOR`` bytes in that string whose hash
is least (the first of equals), which depends on the string alone, so equal strings have equal anchors. Runs of starts
with one anchor are a segment; anchors met once cannot repeat and are dropped. Segments that are equal as a whole are
told by their hashes. Where an anchor has different segments, one text of each is fetched, and the transforms of
shards of them are merged to find the strings they share. Spans return to their documents, which are read again.

Hot passages: segments that are equal within one batch of texts leave its task once, with their number, and their spans
apart. Anchors with very many different segments (a common line in ever new surroundings) would fill a task; their
starts are compared one by one instead, by 128-bit hashes that are counted before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from lodespark.llm.bwt import repeated_starts
from lodespark.llm.common import keyed, written

#: Bytes of an anchor; bits of the place that break ties between hashes; bytes whose transforms one call merges.
ANCHOR, PLACE_BITS, MERGE_BYTES = 64, 31, 1 << 20
#: Different segments from which an anchor counts as wide.
WIDE = 2000
_RNG = np.random.default_rng(424242)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UP, _DOWN = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)


class _Tables:
    up = down = np.ones(0, np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.up) <= n:
            cls.up, cls.down = _powers(_UP, n), _powers(_DOWN, n)


def _window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on; depends on these bytes alone."""
    n = len(data)
    _Tables.grow(max(n, 1 << 21))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _Tables.up[:n], out=sums[1:])
    h = (sums[width:] - sums[:-width]) * _Tables.down[: n - width + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_least(x: np.ndarray, t: int) -> np.ndarray:
    """The least of x[k : k + t] for each k; two running minima over blocks of t."""
    n = len(x)
    padded = np.full(-(-n // t) * t, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, t)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - t + 1], ahead[t - 1 : n])


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, start, bytes, anchor hash, segment hash) of the runs of starts that share an anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = b"".join(texts)
    empty = np.zeros(0, np.int64)
    if len(joined) < length:
        return empty, empty, empty, empty, empty
    h = _window_hashes(np.frombuffer(joined, np.uint8), ANCHOR)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = _sliding_least((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - ANCHOR + 1)
    anchor = (least & mask).astype(np.int64)
    valid = np.zeros(len(joined) - length + 2, np.int8)
    long = sizes >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[:-1][long] + sizes[long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(starts):
        return empty, empty, empty, empty, empty
    a = anchor[starts]
    text = np.searchsorted(offsets, starts, side="right") - 1
    new = np.flatnonzero((a[1:] != a[:-1]) | (text[1:] != text[:-1])) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(starts)]]) - 1
    low, high = starts[first], starts[last] + length
    a = a[first]
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(joined[x:y], k) >> 1 for x, y, k in zip(low.tolist(), high.tolist(), (a - low).tolist(), strict=True)), np.int64, len(low))
    text = text[first]
    return text, low - offsets[text], high - low, h[a].view(np.int64), hashed


def _chunks(texts: list[bytes], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _collapsed(anchor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each different segment, its number, places of the segments that are not alone)."""
    mixed = anchor ^ (whole * np.int64(0x2545F4914F6CDD1D))
    _, first, group, count = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    if (anchor[first][group] != anchor).any() or (whole[first][group] != whole).any():  # the mixture of two is one
        return np.arange(len(anchor)), np.ones(len(anchor), np.int64), np.zeros(0, np.int64)
    return first, count, np.flatnonzero(count[group] > 1)


def _found(rows: DataFrame, length: int) -> DataFrame:
    """(id, at, bytes, anchor, whole, n): the different segments of each batch of (id, text) rows and their number.

    Segments that are not alone in their batch are repeated for sure: they follow as rows with n = 0, dealt by place.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), [t or b"" for t in batch.column("text").to_pylist()]
            for a, b in _chunks(texts):
                text, at, size, anchor, whole = segments(texts[a:b], length)
                first, count, sure = _collapsed(anchor, whole)
                pick = np.concatenate([first, sure])
                n = np.concatenate([count, np.zeros(len(sure), np.int64)])
                anchor = np.concatenate([anchor[first], whole[sure] ^ (sure * np.int64(0x2545F4914F6CDD1D))])
                whole = pa.array(whole[pick], pa.int64(), mask=n == 0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text[pick] + a)), pa.array(at[pick], pa.int32()), pa.array(size[pick], pa.int32()), pa.array(anchor, pa.int64()), whole, pa.array(n, pa.int32())], ["id", "at", "bytes", "anchor", "whole", "n"])

    return rows.mapInArrow(find, f"id {rows.schema['id'].dataType.simpleString()}, at int, bytes int, anchor bigint, whole bigint, n int")


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, id, at, times, kinds, text): the bytes of the wanted segments, cut out where their documents meet them."""
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("anchor", "at", "bytes", "times", "kinds")).alias("parts"))
    joined = rows.join(lists, "id")

    def slice_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py() or b""
                parts = batch.column("parts")[k].values.flatten()
                anchor, at, size, times, kinds = parts
                cuts = [text[x : x + n] for x, n in zip(at.to_pylist(), size.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([anchor, batch.column("id").take(pa.array([k] * len(cuts), pa.int64())), at, times, kinds, pa.array(cuts, pa.binary())], ["anchor", "id", "at", "times", "kinds", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return joined.select("id", "text", "parts").mapInArrow(slice_out, f"anchor bigint, id {kind}, at int, times bigint, kinds bigint, text binary")


def _shared(parts: DataFrame, length: int) -> DataFrame:
    """(id, start, stop) of the bytes of single segments that strings of other segments of their anchor cover."""

    def spans(ids: list, at: list[int], times: list[int], texts: list[bytes]) -> pa.RecordBatch:
        hit = np.flatnonzero(repeated_starts(texts, length))
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        own = np.searchsorted(offsets, hit, side="right") - 1
        single = np.array(times)[own] == 1 if len(hit) else np.zeros(0, bool)
        hit, own = hit[single], own[single]
        new = np.flatnonzero((own[1:] != own[:-1]) | (hit[1:] > hit[:-1] + length)) + 1
        first, last = (np.concatenate([[0], new]), np.concatenate([new, [len(hit)]]) - 1) if len(hit) else (new, new)
        part = own[first]
        low = np.array(at, np.int64)[part] - offsets[part] if len(hit) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in part.tolist()], id_type), pa.array(hit[first] + low, pa.int64()), pa.array(hit[last] + low + length, pa.int64())], ["id", "start", "stop"])

    id_type = None

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        ids, at, times, texts, size, now = [], [], [], [], 0, None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for anchor, i, p, n, t in zip(*(batch.column(c).to_pylist() for c in ("anchor", "id", "at", "times", "text")), strict=True):
                if anchor != now and size >= MERGE_BYTES:  # only between anchors
                    yield spans(ids, at, times, texts)
                    ids, at, times, texts, size = [], [], [], [], 0
                now = anchor
                ids.append(i)
                at.append(p)
                times.append(n)
                texts.append(t)
                size += len(t)
        if texts:
            yield spans(ids, at, times, texts)

    kind = parts.schema["id"].dataType.simpleString()
    return parts.repartition("anchor").sortWithinPartitions("anchor", "id", "at").mapInArrow(merge, f"id {kind}, start bigint, stop bigint")


def _shared_by_start(parts: DataFrame, length: int) -> DataFrame:
    """What ``_shared`` finds, for segments of wide anchors: every start by the hash of its string, counted."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, at, times, text in zip(*(batch.column(c) for c in ("id", "at", "times", "text")), strict=True):
                text, at = text.as_py(), at.as_py()
                places = range(len(text) - length + 1)
                h = [xxhash.xxh3_128_intdigest(text[k : k + length]) for k in places]
                own = pa.array([i.as_py()] * len(h), i.type)
                yield pa.RecordBatch.from_arrays([own, pa.array([at + k for k in places], pa.int64()), pa.array([times.as_py()] * len(h), pa.int64()), pa.array([x >> 65 for x in h], pa.int64()), pa.array([x & (2**63 - 1) for x in h], pa.int64())], ["id", "start", "times", "a", "b"])

    kind = parts.schema["id"].dataType.simpleString()
    rows = parts.mapInArrow(starts, f"id {kind}, start bigint, times bigint, a bigint, b bigint")
    many = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.where("times = 1").join(many, ["a", "b"], "left_semi").select("id", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """(id, start, stop): byte ranges of (id, text) rows that repeated strings cover; they may overlap."""
    found = _found(rows, length)
    by_anchor, equal = Window.partitionBy("anchor"), Window.partitionBy("anchor", "whole")
    many = found.withColumn("total", F.sum("n").over(by_anchor)).where("n = 0 OR total > 1")
    many = many.withColumn("times", F.sum("n").over(equal)).withColumn("k", F.row_number().over(equal.orderBy("id", "at")))
    many = many.withColumn("kinds", F.sum(F.when((F.col("k") == 1) & (F.col("n") > 0), 1).otherwise(0)).over(by_anchor))
    one = (F.col("n") > 0) & (F.col("kinds") > 1) & (F.col("k") == 1)
    many = many.where((F.col("n") == 0) | (F.col("times") > 1) | (F.col("kinds") > 1)).select("id", "at", "bytes", "anchor", "n", "times", "kinds", one.alias("one"))
    many = written(many, "repeated-segments")
    whole = many.where("n = 0 OR times > 1").select("id", F.col("at").cast("bigint").alias("start"), (F.col("at") + F.col("bytes")).cast("bigint").alias("stop"))
    texts = written(_texts_of(rows, many.where("one")), "segment-texts")
    narrow = _shared(texts.where(F.col("kinds") < WIDE), length)
    return whole.union(narrow).union(_shared_by_start(texts.where(F.col("kinds") >= WIDE), length))


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover, inside 0..size."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = min(b, size)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, kept, n_bytes, n_removed, spans) for every row: ``kept`` holds the bytes that no repeated string covers.

    A string of ``length`` bytes repeats if it starts at another byte of any document too, overlaps included; it is
    judged on the input. Null texts are empty. Rows that share an id are places of their own, but what is found in one is
    removed from all of them, as far as they reach; rows with a null id do not share it.
    """
    rows, own = keyed(docs.select(F.col(id_col).alias("own"), F.col(text_col).cast("binary").alias("text")), "own", "id")
    rows = rows.select("id", "text")
    lists = repeated_spans(rows, length).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(lists, "id", "left").select("id", "text", "spans")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, runs = [], [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                cuts = merged([(s["start"], s["stop"]) for s in spans or []], len(text))
                edges = [0, *(x for c in cuts for x in c), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in cuts))
                runs.append([{"start": a, "stop": b} for a, b in cuts])
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, span)], ["id", "kept", "n_bytes", "n_removed", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(drop, f"id {kind}, kept binary, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>")
    return out.select(own(F.col("id")).alias(id_col), *out.columns[1:])


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of ``remove_repeats``."""
    out = remove_repeats(docs, id_col, text_col, length)
    return out.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
