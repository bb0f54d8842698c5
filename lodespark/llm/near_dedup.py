"""Near-duplicate groups by b-bit MinHash.

A task turns whole texts into sets of word-shingle hashes and takes 128 minima of each. Bands of four minima give
candidate buckets; of every minimum only the low four bits are kept, packed into 64 bytes, and the share of equal
groups of bits, corrected for chance, estimates the similarity of a candidate pair. Links are confirmed on the full
sets. Equal sets are collapsed first. A bucket is never expanded into pairs: its members are compared with the one of
them that meets most others. Where this leaves several components, links between these are found by the rarest shingles
of the sets, one of which two linked sets must share, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lodespark.llm.common import keyed, slices, written
from lodespark.operators.components import connected_components

#: Minima, minima of a band, bits kept of each minimum. At similarity 0.8 a pair misses every band once in 10^7.
HASHES, ROWS, BITS = 128, 4, 4
#: A pair goes on if the estimate is not this far (in standard deviations at the threshold) below it.
SLACK = 5.5
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_MULTIPLIERS = (_RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, as many as the longest buffer so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 19)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]), dtype=np.uint64)


_POWERS = Powers()


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``width`` words; fewer words are one run, none no run."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    _POWERS.grow(len(buffer) + 1)
    space = _SPACE[buffer]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[buffer] * _POWERS.up[: len(buffer)], out=total[1:])
    words = _mix((total[ends] - total[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64))
    sizes = np.array([len(t) + 1 for t in texts])
    edge = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    runs = words.copy()
    for k in range(1, width):
        n = max(0, len(runs) - k)  # a batch may have fewer words than a run
        runs[:n] = _mix(runs[:n] * np.uint64(0x2545F4914F6CDD1D) + words[k : k + n])
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            short = np.uint64(b - a)
            for w in words[a:b]:
                short = _mix(np.array([short]) * np.uint64(31) + w)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions."""
    hashes = hashes ^ _BASE  # a mixed zero is zero, which times anything would be the least
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(out, (_MULTIPLIERS * hashes[k : k + 512]).min(1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def packed_bits(m: np.ndarray) -> np.ndarray:
    """The low four bits of each minimum, sixteen to a 64-bit word."""
    low = (_mix(m.astype(np.uint64)) & np.uint64(15)).reshape(-1, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    bands = m.reshape(-1, ROWS).astype(np.uint64)
    key = _mix(np.arange(len(bands), dtype=np.uint64) + np.uint64(1))
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x2545F4914F6CDD1D) + bands[:, k])
    return key.view(np.int64)


def _chunks(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) of runs with about ``most`` bytes; null is empty."""
    for at, n in slices(texts, most):
        yield at, [t or b"" for t in texts.slice(at, n).to_pylist()]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """(id, text), where ``id`` is the key of ``keyed``, and how to get the id from it."""
    rows, own = keyed(docs.select(F.col(id_col).alias("own"), F.col(text_col).cast("binary").alias("text")), "own", "id")
    return rows.select("id", "text"), own


def sketches(rows: DataFrame, width: int, least: int) -> DataFrame:
    """(id, n, set_a, set_b, bits, bands) of (id, text) rows; sets below ``least`` get no bands: only equal ones can link."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _chunks(batch.column("text")):
                n, sa, sb, bits, bands = [], [], [], [], []
                for s in shingle_sets(texts, width):
                    whole = xxhash.xxh3_128_intdigest(s.tobytes())
                    n.append(len(s))
                    sa.append(whole >> 65)
                    sb.append(whole & (2**63 - 1))
                    m = minima(s) if len(s) >= least else None
                    bits.append(packed_bits(m).tolist() if m is not None else None)
                    bands.append(band_keys(m).tolist() if m is not None else None)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(sa, pa.int64()), pa.array(sb, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "set_a", "set_b", "bits", "bands"])

    return rows.mapInArrow(sketch, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, set_a bigint, set_b bigint, bits array<bigint>, bands array<bigint>")


def full_sets(rows: DataFrame, width: int) -> DataFrame:
    """(id, hashes): the sorted distinct shingle hashes of every (id, text) row as packed 64-bit integers."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _chunks(batch.column("text")):
                found = [s.tobytes() for s in shingle_sets(texts, width)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array(found, pa.binary())], ["id", "hashes"])

    return rows.mapInArrow(sets, f"id {rows.schema['id'].dataType.simpleString()}, hashes binary")


def equal_minima(a: Column, b: Column) -> Column:
    """How many of the packed groups of four bits are equal."""

    def differ(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        return F.bit_count(x)

    return F.lit(HASHES) - sum((differ(k) for k in range(1, HASHES // 16)), differ(0))


def enough_equal(threshold: float) -> int:
    """Equal groups from which a pair goes on: the share expected at the threshold, chance hits included, less the slack."""
    share = threshold + (1 - threshold) / 2**BITS
    return int(HASHES * (share - SLACK * (share * (1 - share) / HASHES) ** 0.5))


def estimated_similarity(a: Column, b: Column) -> Column:
    """Similarity from the share of equal groups of bits, corrected for those that are equal by chance."""
    chance = 1 / 2**BITS
    return F.greatest(F.lit(0.0), (equal_minima(a, b) / F.lit(HASHES) - chance) / (1 - chance))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs with 100 * intersection >= percent * union of their full sets."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b").join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return joined.select("a", "b", "ha", "hb").mapInArrow(check, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents link when their sets of ``width``-word shingles have ``100 * intersection >= percent * union``; words are
    compared with A-Z as a-z. Documents without words link with nothing. component_id is the smallest id reachable, and
    that document is kept. Rows that share an id are one document: it links through any of its texts. Rows with a null
    id are documents of their own and come after all others: a group of nothing else has a null component, and one of it
    is kept. Whole texts count, of any length.
    """
    rows, own = _rows(docs, id_col, text_col)
    least = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1)) if percent < 100 else 1 << 60
    base = written(sketches(rows, width, least), "sketches")
    known = base.where("n > 0")
    groups = known.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"))
    reps = known.where("bands IS NOT NULL").select("id", "set_a", "set_b", "bits", "bands").join(groups, ["set_a", "set_b"]).where("id = rep")
    reps = written(reps.select("rep", "bits", "bands").dropDuplicates(["rep", "bands"]), "set-bands")
    members = reps.select("rep", F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last")
    members = written(_headed(members.join(buckets.select("band"), "band")), "bucket-members")
    bits = reps.select("rep", "bits")
    enough = enough_equal(percent / 100)
    stars = members.where("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = _likely(stars, bits, enough)
    wanted = members.select(F.col("rep").alias("id")).distinct()
    sets = written(full_sets(rows.join(wanted, "id", "left_semi"), width), "full-sets")
    links = written(confirmed(pairs, sets, percent), "links")
    found = connected_components(links, "a", "b")
    more = written(confirmed(_likely(_strays(members, found, sets, percent), bits, enough), sets, percent), "more-links")
    if not more.isEmpty():
        found = connected_components(links.union(more), "a", "b")
    # every set's component, then every document's
    places = groups.join(found, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    shared = known.select("id", "set_a", "set_b").join(places, ["set_a", "set_b"]).groupBy("id").agg(F.min("component").alias("component"))
    out = base.select("id", "n").join(shared, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(own(F.col("id")).alias(id_col), F.col("n").alias("n_shingles"), own(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def _headed(members: DataFrame) -> DataFrame:
    """(band, rep, first) of (band, rep): ``first`` is the bucket's member that meets most others in all of its buckets, ties by id.

    Among copies with changes of their own that is the text they were made from, which is nearer to each of them than they
    are to each other.
    """
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    degrees = members.join(sizes, "band").groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked = members.join(degrees, "rep")
    most = ranked.groupBy("band").agg(F.max("degree").alias("degree"))
    heads = ranked.join(most, ["band", "degree"]).groupBy("band").agg(F.min("rep").alias("first"))
    return members.join(heads, "band").select("band", "rep", "first")


def _likely(pairs: DataFrame, bits: DataFrame, enough: int) -> DataFrame:
    """The (a, b) pairs whose packed bits agree often enough."""
    both = pairs.join(bits.select(F.col("rep").alias("b"), F.col("bits").alias("vb")), "b").join(bits.select(F.col("rep").alias("a"), F.col("bits").alias("va")), "a")
    return both.where(equal_minima(F.col("va"), F.col("vb")) >= enough).select("a", "b").distinct()


def _strays(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may still link: they share one of their rarest shingles.

    Of the shingles of two linked sets, in one order, the first ``n - ceil(percent * n / 100) + 1`` of either must meet.
    Rare shingles come first in that order, so a near copy with changes enough of its own to link with nothing meets
    nobody. Only sets of open buckets (those with members of several components) take part. Where a shingle's sets meet,
    those of its commonest component are never compared with each other.
    """
    labels = found.select(F.col("node").alias("rep"), "component")
    rows = members.select("band", "rep").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_bands = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    open_reps = written(rows.join(open_bands, "band", "left_semi").select("rep", "component").distinct(), "open-sets")
    shingles = _shingles(sets.join(open_reps.select(F.col("rep").alias("id")), "id", "left_semi"))
    common = shingles.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shingles of one set alone come first in its order and meet nothing: their number is enough
    ranked = shingles.join(common, "hash").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("order"))
    alone = F.col("n") - F.size("order")
    take = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    first = ranked.where(take > 0).select("rep", "n", alone.alias("alone"), F.slice("order", 1, take.cast("int")).alias("order"))
    first = first.select("rep", "n", "alone", F.posexplode("order").alias("at", "s")).select("rep", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("s.hash").alias("hash"))
    first = written(first.join(open_reps, "rep"), "rarest-shingles")
    kinds = first.groupBy("hash", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("hash").agg(F.max_by("component", F.struct("k", "component")).alias("home"), F.count(F.lit(1)).alias("kinds"))
    first = first.join(kinds.where("kinds > 1").select("hash", "home"), "hash")
    left = first.where("component != home").select("hash", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("at").alias("i"), F.col("component").alias("cx"))
    right = first.select("hash", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("at").alias("j"), F.col("component").alias("cy"), (F.col("component") == F.col("home")).alias("in_home"))
    rest = F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j"))  # the most they can share from here on
    met = left.join(right, "hash").where((F.col("cx") != F.col("cy")) & (F.col("in_home") | (F.col("x") < F.col("y"))) & ((100 + percent) * rest >= percent * (F.col("nx") + F.col("ny"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _shingles(sets: DataFrame) -> DataFrame:
    """(rep, n, hash): a row for each shingle of the sets."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                hashes = np.frombuffer(batch.column("hashes")[k].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.full(len(hashes), k))), pa.array(np.full(len(hashes), len(hashes))), pa.array(hashes)], ["rep", "n", "hash"])

    return sets.select("id", "hashes").mapInArrow(spread, f"rep {sets.schema['id'].dataType.simpleString()}, n bigint, hash bigint")
