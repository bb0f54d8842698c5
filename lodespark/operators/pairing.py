"""Features of pairs of records, in blocks of pairs.

The left records go to every task, which holds its own against them block by block: the numbers of shared values are
products of two 0/1 matrices over the values of a left block. No row is made for a pair before it is known to be wanted,
so memory is a block of pairs; the work is left x right, as for any scores of all pairs. Records with equal values are one
class: classes are held against each other, and pairs of their members come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lodespark.operators.nearest import best_places

#: Sets whose values make candidates, and all sets.
MEETING = ("tasks", "modalities", "regions", "events", "affordances")
SETS = (*MEETING, "species")
#: Records of a packed block on either side; values of a set in one product.
LEFT, RIGHT, VALUES = 128, 4096, 1024
#: Members of a class that stand in one row, and members of a batch of pairs of classes.
MEMBERS, BATCH = 512, 1 << 18
#: Scores are rounded to 6 places by the caller: what may round to a bound lies within this of it.
SLACK = 2e-6
FEATURES = ("task", "modality", "species", "region", "event", "affordance")


def _packer(most: int):
    """Rows as blocks of at most so many, each an Arrow stream of its own."""

    def block(t: pa.Table) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t.combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = b.slice(at, most)
                if n + part.num_rows > most:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield block(pa.Table.from_batches(held))

    return pack


class _Records:
    """A packed block again as arrays."""

    def __init__(self, rows: bytes):
        t = pa.ipc.open_stream(rows).read_all().combine_chunks()
        whole = lambda c: t.column(c).combine_chunks()
        self.id_column, self.source, self.n = whole("id"), whole("source"), len(t)
        self.members = whole("members") if "members" in t.column_names else None
        self.ids = self.id_column.to_numpy(zero_copy_only=False)
        self.sizes = {c: whole(f"n_{c}").to_numpy(zero_copy_only=False).astype(float) for c in SETS}
        self.no_species = whole("no_species").to_numpy(zero_copy_only=False)
        self.flat, self.row = {}, {}
        for c in SETS:
            lists = whole(c)
            self.flat[c], self.row[c] = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        self.null = {c: np.isin(np.arange(self.n), self.row[c][self.flat[c].is_null().to_numpy(zero_copy_only=False)]) for c in SETS}


def _shared(a: _Records, b: _Records, c: str) -> np.ndarray:
    """How many values each pair's sets share, a null being a value."""
    values = pc.unique(a.flat[c])
    out = np.zeros((a.n, b.n), np.float32)
    for at in range(0, len(values), VALUES):
        some = values.slice(at, VALUES)
        sides = []
        for r in (a, b):
            k = pc.index_in(r.flat[c], value_set=some)
            has = k.is_valid().to_numpy(zero_copy_only=False)
            x = np.zeros((r.n, len(some)), np.float32)
            x[r.row[c][has], k.drop_null().to_numpy()] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    return out.astype(float)


def _scores(f: dict[str, np.ndarray], far: np.ndarray, clash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the kind and score as ``catalog.pair_type`` has them, before rounding."""
    rules = [(f["task"] > 0.5) & (f["region"] < 0.3), (f["task"] > 0.5) & (f["species"] < 0.3), (f["modality"] > 0.5) & (f["task"] < 0.3), f["affordance"] > 0.3, (f["task"] > 0.3) & (f["modality"] < 0.3)]
    score = 0.25 * f["task"] + 0.15 * f["modality"] + 0.10 * f["species"] + 0.15 * f["region"] + 0.10 * f["event"] + 0.15 * f["affordance"] + 0.05 + np.where(far, 0.1, 0.0) - np.where(clash, 0.1, 0.0)
    return np.select(rules, range(5), 5), np.minimum(1.0, np.maximum(0.0, score))


def _batches(n: np.ndarray) -> Iterator[slice]:
    """Rows with so many members each, cut where these fill a batch."""
    full = np.cumsum(n) // BATCH
    starts = np.concatenate([[0], 1 + np.flatnonzero(full[1:] != full[:-1])])
    yield from map(slice, starts, [*starts[1:], len(n)])


def _pairs(ordered: bool, least: float | None, best: int | None):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts: dict[bytes, tuple[_Records, np.ndarray]] = {}  # with the best-th score of each record and kind so far
        seen: tuple[bytes, _Records] | None = None
        for batch in batches:
            for mine, others in zip(batch.column(0), batch.column(1), strict=True):
                mine, others = mine.as_py(), others.as_py()
                if mine not in lefts:
                    r = _Records(mine)
                    lefts[mine] = r, np.full((r.n, 6), -np.inf)
                if seen is None or seen[0] != others:
                    seen = others, _Records(others)
                yield from _block(*lefts[mine], seen[1])

    def _block(a: _Records, floor: np.ndarray, b: _Records) -> Iterator[pa.RecordBatch]:
        shared = {c: _shared(a, b, c) for c in SETS}
        real = {c: shared[c] - (a.null[c][:, None] & b.null[c][None, :]) if a.null[c].any() else shared[c] for c in SETS}
        if a.members is not None:
            ok = np.ones((a.n, b.n), bool)  # a class meets itself
        else:
            ok = (a.ids[:, None] < b.ids[None, :]) if ordered else (a.ids[:, None] != b.ids[None, :])
        ok &= sum(real[c] for c in MEETING) > 0
        if not ok.any():
            return
        size = lambda c: (a.sizes[c][:, None], b.sizes[c][None, :])

        def share(c: str, of: np.ndarray) -> np.ndarray:
            return np.divide(shared[c], of, out=np.zeros_like(shared[c]), where=of > 0)

        jaccard = lambda c: share(c, sum(size(c)) - shared[c])
        f = {"task": jaccard("tasks"), "modality": jaccard("modalities"), "species": jaccard("species"), "region": share("regions", np.minimum(*size("regions"))), "event": jaccard("events"), "affordance": jaccard("affordances")}
        names = pc.unique(a.source)
        code = lambda r: pc.fill_null(pc.index_in(r.source, value_set=names), -1).to_numpy(zero_copy_only=False)
        unknown = a.source.is_null().to_numpy(zero_copy_only=False)[:, None] | b.source.is_null().to_numpy(zero_copy_only=False)[None, :]
        far = (code(a)[:, None] != code(b)[None, :]) & ~unknown
        apart = (a.sizes["species"] > 0)[:, None] & (b.sizes["species"] > 0)[None, :] & (real["species"] == 0)
        unsure = a.no_species[:, None] | b.no_species[None, :] | (apart & (a.null["species"][:, None] | b.null["species"][None, :]))
        clash = apart & ~unsure
        if least is not None or best is not None:
            kind, score = _scores(f, far, clash)
            ok &= score >= (-np.inf if least is None else least) - SLACK
        if best is None:
            x, y = np.nonzero(ok)
        else:
            ok &= score >= np.take_along_axis(floor, kind, 1) - SLACK
            found = []
            for r in np.flatnonzero(ok.any(1)):
                hit = np.flatnonzero(ok[r])
                for k in np.unique(kind[r, hit]):
                    of = hit[kind[r, hit] == k]
                    keep, bound = best_places(score[r, of], b.ids[of], best, False, SLACK)
                    floor[r, k] = max(floor[r, k], bound)
                    found.append((np.full(len(keep), r), of[keep]))
            if not found:
                return
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(x):
            return
        ends = [r.id_column if r.members is None else r.members for r in (a, b)]
        sizes = [np.full(r.n, 2) if r.members is None else r.members.value_lengths().to_numpy() for r in (a, b)]
        for part in _batches(sizes[0][x] + sizes[1][y]):
            i, j = x[part], y[part]
            columns = [ends[0].take(pa.array(i)), ends[1].take(pa.array(j)), *(pa.array(f[c][i, j]) for c in FEATURES)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(far[i, j], mask=unknown[i, j]), pa.array(clash[i, j], mask=unsure[i, j])], names=["a", "b", *FEATURES, "far", "clash"])

    return pairs


def pair_features(left: DataFrame, right: DataFrame, ordered: bool = False, least: float | None = None, best: int | None = None) -> DataFrame:
    """(a, b, task, modality, species, region, event, affordance, far, clash) of records that share at least one value.

    Records are (id, source, tasks, modalities, species, regions, events, affordances), ids being unique numbers; the left
    ones go to every task. Records meet by shared tasks, modalities, regions, events or affordances; one without such a
    set (null) meets none. ``far``: of different sources; ``clash``: both have species, and none in common. With
    ``least``, pairs whose score is surely below it are left out; with ``best``, those surely not among the best so many
    of a's kind, too.
    """
    return _met(_ready(left), _ready(right).repartition("id"), _pairs(ordered, least, best), "bigint")


def class_features(left: DataFrame, right: DataFrame, least: float | None = None, best: int | None = None) -> DataFrame:
    """As ``pair_features``, but a and b are lists of records that are equal in all but their ids: a row stands for all pairs of theirs.

    ``members_met`` makes these pairs. The matrices grow with the classes, only the pairs with the records. With ``best``,
    only members that can be among the best so many of an a are listed; one more than that, as a record is no partner
    of itself.
    """

    def classes(t: DataFrame) -> DataFrame:
        t = _ready(t)
        return t.groupBy(*(c for c in t.columns if c != "id")).agg(F.sort_array(F.collect_list("id")).alias("members")).withColumn("id", F.get("members", F.lit(0)))

    def cut(t: DataFrame) -> DataFrame:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("members") - 1) / MEMBERS).cast("int")), lambda k: F.slice("members", k * MEMBERS + 1, F.lit(MEMBERS)))
        return t.withColumn("members", F.explode(parts))

    mine, others = cut(classes(left)), classes(right)
    others = cut(others) if best is None else others.withColumn("members", F.slice("members", 1, best + 1))
    n = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few classes may have many members: their tasks are not to be merged
    return _met(mine, others.repartition(n, "id", F.get("members", F.lit(0))), _pairs(False, least, None if best is None else best + 1), "array<bigint>")


def members_met(rows: DataFrame) -> DataFrame:
    """A row for each pair of a member of a with a member of b, a record with itself left out."""
    rest = [c for c in rows.columns if c not in ("a", "b")]
    each = rows.select("a", F.explode("b").alias("b"), *rest).select(F.explode("a").alias("a"), "b", *rest)
    return each.where("a <> b")


def _ready(t: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    t = t.where(" AND ".join(f"{c} IS NOT NULL" for c in ("id", *MEETING))).withColumn("id", F.col("id").cast("bigint"))
    sets = [F.coalesce(F.col(c), empty).alias(c) for c in SETS]
    return t.select("id", "source", *sets, *(F.size(F.array_distinct(F.coalesce(F.col(c), empty))).alias(f"n_{c}") for c in SETS), F.col("species").isNull().alias("no_species"))


def _met(left: DataFrame, right: DataFrame, pairs, end: str) -> DataFrame:
    """Every block of the right held against every one of the left."""
    mine = left.mapInArrow(_packer(LEFT), "rows binary")
    others = right.mapInArrow(_packer(RIGHT), "rows binary")
    both = others.withColumnRenamed("rows", "others").crossJoin(F.broadcast(mine)).select("rows", "others")
    return both.mapInArrow(pairs, f"a {end}, b {end}, " + ", ".join(f"{c} double" for c in FEATURES) + ", far boolean, clash boolean")
