"""Exact threshold pairs of vectors by dual traversal of cover trees.

Unit vectors of one label are dealt to cells around pivots (a bounded net of a sample) and cells to blocks of bounded
size. A block visits another only if the pivots' covering radii allow a pair within reach. For each pair of blocks a
task builds cover trees - nested levels whose radii halve - and walks both at once: a pair of nodes is dropped when its
centres are farther apart than both covering radii and the reach together, taken whole when even its farthest points
are within reach, and opened otherwise. Counts are summed and only enough edges to join each group leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodespark.llm.common import cut, keyed
from lodespark.operators.components import connected_components

#: Vectors of a block, most pivots, and vectors of the sample that pivots are chosen from.
BLOCK, PIVOTS, SAMPLE = 2048, 1024, 4096
#: Distances are rounded; bounds give way by this much, and the pairs left are decided by their cosine.
SLACK = 1e-7


class Node:
    __slots__ = ("center", "children", "members", "radius")

    def __init__(self, center: int, members: np.ndarray, radius: float):
        self.center, self.members, self.radius, self.children = center, members, radius, None


class CoverTree:
    """Cover tree of unit vectors; levels are opened as a traversal needs them."""

    def __init__(self, x: np.ndarray):
        self.x = x
        members = np.arange(len(x))
        self.root = self._node(0, members, self.distance(0, members)) if len(x) else None

    def distance(self, center: int, members: np.ndarray) -> np.ndarray:
        d = self.x[members] @ self.x[center]
        return np.sqrt(np.maximum(0.0, 2 - 2 * d))

    def _node(self, center: int, members: np.ndarray, distances: np.ndarray) -> Node:
        return Node(center, members, float(distances.max()))

    def children(self, node: Node) -> list[Node]:
        """Nodes of a finer level: every member goes to the first center within half the radius; the center comes first."""
        if node.children is None:
            node.children = []
            rest = node.members
            if node.radius < 1e-7:
                node.children = [Node(int(m), rest[k : k + 1], 0.0) for k, m in enumerate(rest)]
                return node.children
            reach, center = 2.0 ** (np.ceil(np.log2(node.radius)) - 1), node.center
            reach = reach if reach < node.radius else reach / 2
            while len(rest):
                d = self.distance(center, rest)
                near = d <= reach
                near |= rest == center
                node.children.append(Node(center, rest[near], float(d[near].max()) if near.sum() > 1 else 0.0))
                rest = rest[~near]
                center = int(rest[0]) if len(rest) else -1
        return node.children


class Links:
    """What a traversal finds: weighted counts for the points of both sides, and edges that join groups."""

    def __init__(self, weights: tuple[np.ndarray, np.ndarray], same: bool):
        self.weights, self.same = weights, same
        self.counts = [np.zeros(len(w), np.int64) for w in weights]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def whole(self, a: Node, b: Node) -> None:
        """Every point of a links with every point of b."""
        self.counts[0][a.members] += self.weights[1][b.members].sum()
        self.counts[1][b.members] += self.weights[0][a.members].sum()
        self.edges.append((np.full(len(b.members), a.members[0]), b.members))
        self.edges.append((a.members, np.full(len(a.members), b.members[0])))

    def within(self, a: Node) -> None:
        """All points of a link with each other."""
        w = self.weights[0][a.members]
        self.counts[0][a.members] += w.sum() - w
        self.edges.append((np.full(len(a.members), a.members[0]), a.members))

    def points(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.counts[0], i, self.weights[1][j])
        np.add.at(self.counts[1], j, self.weights[0][i])
        self.edges.append((i, j))


def dual_traversal(ta: CoverTree, tb: CoverTree | None, weights: tuple[np.ndarray, np.ndarray], cosine: float) -> Links:
    """All pairs with at least ``cosine`` between two trees, or within one (``tb`` None)."""
    reach = (2 - 2 * cosine) ** 0.5
    same = tb is None
    tb = tb or ta
    found = Links((weights[0], weights[0]) if same else weights, same)
    if ta.root is None or tb.root is None:
        return found
    todo: list[tuple[Node, Node]] = [(ta.root, tb.root)]
    while todo:
        a, b = todo.pop()
        if same and a is b:
            if len(a.members) < 2:
                continue
            if 2 * a.radius <= reach - SLACK:
                found.within(a)
                continue
            kids_a = kids_b = ta.children(a)
        else:
            open_a = len(a.members) > 1 and (a.radius >= b.radius or len(b.members) == 1)
            open_b = len(b.members) > 1 and (b.radius >= a.radius / 2 or not open_a)
            kids_a, kids_b = ta.children(a) if open_a else [a], tb.children(b) if open_b else [b]
        ca, cb = (np.array([k.center for k in kids]) for kids in (kids_a, kids_b))
        ra, rb = (np.array([k.radius for k in kids]) for kids in (kids_a, kids_b))
        sa, sb = (np.array([len(k.members) for k in kids]) == 1 for kids in (kids_a, kids_b))
        for at in range(0, len(ca), 1024):  # bounds the matrix
            part = slice(at, at + 1024)
            dots = ta.x[ca[part]] @ tb.x[cb].T
            span = ra[part, None] + rb[None, :]
            gap = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
            alive = gap <= reach + span + SLACK
            if same and kids_a is kids_b:
                alive &= np.arange(at, at + len(dots))[:, None] < np.arange(len(cb))[None, :]
            single = sa[part, None] & sb[None, :]
            i, j = np.nonzero(alive & single & (dots >= cosine))
            if len(i):
                found.points(ca[part][i], cb[j])
            i, j = np.nonzero(alive & ~single)
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                x, y = kids_a[at + p], kids_b[q]
                if gap[p, q] + span[p, q] <= reach - SLACK:
                    found.whole(x, y)
                else:
                    todo.append((x, y))
        if same and kids_a is kids_b:
            todo += [(k, k) for k in kids_a if len(k.members) > 1]
    if same:
        found.counts = [found.counts[0] + found.counts[1]]
    return found


def joining(n: int, edges: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, root) that join the same groups as ``edges``, one at most for each point."""
    label = np.arange(n)
    if edges:
        i, j = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
        while True:
            before = label.copy()
            least = np.minimum(label[i], label[j])
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
            label = label[label]
            if (label == before).all():
                break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _pack(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, dim, unit): unit vectors as packed doubles; vectors that link with nothing are left out."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v")).where("label IS NOT NULL AND size(v) > 0")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, dims = [], []
            for v in batch.column("v"):
                x = v.values.to_numpy(zero_copy_only=False).astype(float)  # null components become nan
                big = np.abs(x).max()
                ok = np.isfinite(x).all() and big > 0
                if ok:
                    x = x / big  # no overflow of squares
                    x = x / np.sqrt(x @ x)
                units.append(x.astype("<f8").tobytes() if ok else None)
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], ["id", "label", "dim", "unit"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(pack, f"id {kinds['id']}, label {kinds['label']}, dim int, unit binary").where("unit IS NOT NULL")


def _pivots(units: DataFrame, wanted: int) -> dict[int, np.ndarray]:
    """By dimension: a farthest-first net of at most SAMPLE vectors; nested, so fewer pivots are a prefix of more."""
    n = units.count()
    share = min(1.0, SAMPLE / max(1, n))
    rows = units.where(F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20)))).select("dim", "unit").limit(2 * SAMPLE).collect()
    out = {}
    for dim in {r.dim for r in rows}:
        x = np.stack([np.frombuffer(r.unit, "<f8") for r in sorted(rows, key=lambda r: r.unit) if r.dim == dim])
        chosen, least = [0], np.full(len(x), np.inf)
        while len(chosen) < min(wanted, len(x)):
            least = np.minimum(least, 2 - 2 * (x @ x[chosen[-1]]))
            if least.max() < 1e-12:
                break
            chosen.append(int(least.argmax()))
        out[dim] = x[chosen]
    return out


def _placed(units: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds each vector's home pivot (the nearest) and its distance."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            home, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                if (p := pivots.get(dim)) is not None:
                    at = np.flatnonzero(dims == dim)
                    x = np.frombuffer(b"".join(batch.column("unit").take(pa.array(at)).to_pylist()), "<f8").reshape(len(at), dim)
                    d = x @ p.T
                    home[at] = d.argmax(1)
                    far[at] = np.sqrt(np.maximum(0.0, 2 - 2 * d.max(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(far)], [*batch.schema.names, "home", "far"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema.fields)
    return units.mapInArrow(place, f"{kinds}, home int, far double")


def _visits(placed: DataFrame, pivots: dict[int, np.ndarray], radius: dict[tuple[int, int], float], reach: float) -> DataFrame:
    """Adds the later pivots whose cells may hold a vector within reach (array ``cells``)."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, home, far = (batch.column(c).to_numpy() for c in ("dim", "home", "far"))
            cells: list[list[int]] = [[] for _ in dims]
            for dim in np.unique(dims).tolist():
                if (p := pivots.get(dim)) is not None:
                    at = np.flatnonzero(dims == dim)
                    x = np.frombuffer(b"".join(batch.column("unit").take(pa.array(at)).to_pylist()), "<f8").reshape(len(at), dim)
                    gap = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ p.T)))
                    r = np.array([radius.get((dim, k), -10.0) for k in range(len(p))])
                    ok = (gap <= r + reach + SLACK) & (gap <= far[at, None] + 2 * reach + SLACK) & (np.arange(len(p)) > home[at, None])
                    for k, row in zip(at.tolist(), ok, strict=True):
                        cells[k] = np.flatnonzero(row).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    return placed.mapInArrow(visit, f"{kinds}, cells array<int>")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors link when their labels are equal and not null and their cosine in double precision is at least ``cosine``.
    Null, empty and zero vectors, and those with null or non-finite components, link with nothing, nor do vectors of
    different lengths. n_links counts the other rows linked directly, equal vectors included; rows that share an id count
    as one place: its links are added up and its components joined. Rows with a null id are places of their own after all
    others: a group of nothing else has a null component, and one of it is kept.
    """
    vectors = vectors.select(F.col(id_col).alias("own"), F.col(vec_col).alias("vector"), F.col(label_col).alias("label"))
    vectors, id_of = keyed(vectors, "own", "key")
    packed = cut(_pack(vectors, "key", "vector", "label"))
    units = cut(packed.groupBy("label", "dim", "unit").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    most = units.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    pivots = _pivots(units, max(1, min(PIVOTS, -(-most // BLOCK))))
    placed = _placed(units, pivots)
    cells = cut(placed.groupBy("label", "dim", "home").agg(F.count(F.lit(1)).alias("size"), F.max("far").alias("radius")))
    cells = cells.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    radius = {(r.dim, r.home): r.radius for r in cells.groupBy("dim", "home").agg(F.max("radius").alias("radius")).collect()}  # a row for each pivot
    reach = (2 - 2 * cosine) ** 0.5
    own = _visits(placed, pivots, radius, reach).join(cells.select("label", "dim", "home", "blocks"), ["label", "dim", "home"])
    own = cut(own.withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int")).select("label", "dim", "home", "block", "blocks", "rep", "n", "unit", "cells"))
    # blocks that a vector visits: later blocks of its own cell, all blocks of later cells
    later = own.where("block + 1 < blocks").select("label", "dim", "home", "block", "rep", "n", "unit", F.col("home").alias("cell"), F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("at"))
    away = own.select("label", "dim", "home", "block", "rep", "n", "unit", F.explode("cells").alias("cell"))
    away = away.join(cells.select("label", "dim", F.col("home").alias("cell"), F.col("blocks").alias("there")), ["label", "dim", "cell"])
    away = away.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("there") - 1))).select(*later.columns)
    visits = later.unionByName(away)
    pairs = visits.select("label", "dim", "home", "block", "cell", "at").distinct()
    hosts = own.select("label", "dim", F.col("home").alias("cell"), F.col("block").alias("at"), "rep", "n", "unit").join(pairs, ["label", "dim", "cell", "at"])
    key = ["label", "dim", "home", "block", "cell", "at"]
    alone = own.select("label", "dim", "home", "block", F.col("home").alias("cell"), F.col("block").alias("at"), "rep", "n", "unit", F.lit(0).alias("side"))
    rows = alone.unionByName(visits.withColumn("side", F.lit(1))).unionByName(hosts.withColumn("side", F.lit(2)))
    kind = units.schema["rep"].dataType.simpleString()

    def pair(table: pa.Table) -> pa.Table:
        side, dim = table.column("side").to_numpy(), table.column("dim")[0].as_py()
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), "<f8").reshape(len(side), dim)
        n = table.column("n").to_numpy()
        first, second = np.flatnonzero(side < 2), np.flatnonzero(side == 2)
        if side.min() == 0:
            found = dual_traversal(CoverTree(x), None, (n, n), cosine)
            counts, edges, order = found.counts[0], found.edges, np.arange(len(side))
        else:
            found = dual_traversal(CoverTree(x[first]), CoverTree(x[second]), (n[first], n[second]), cosine)
            counts, order = np.concatenate(found.counts), np.concatenate([first, second])
            edges = [(i, j + len(first)) for i, j in found.edges]
        linked = np.flatnonzero(counts)
        i, j = joining(len(order), edges)
        reps = table.column("rep").combine_chunks()
        a = pa.concat_arrays([reps.take(pa.array(order[linked])), reps.take(pa.array(order[i]))])
        b = pa.concat_arrays([pa.nulls(len(linked), reps.type), reps.take(pa.array(order[j]))])
        return pa.table({"a": a, "b": b, "links": pa.array(np.concatenate([counts[linked], np.zeros(len(i), np.int64)]), pa.int64())})

    found = cut(rows.groupBy(*key).applyInArrow(pair, f"a {kind}, b {kind}, links bigint"))
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    joined = connected_components(found.where("b IS NOT NULL"), "a", "b")
    groups = units.select("label", "dim", "unit", "rep", "n").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    groups = groups.select("label", "dim", "unit", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    by_id = packed.join(groups, ["label", "dim", "unit"]).groupBy("id").agg(F.sum("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select(F.col("key").alias("id")).join(by_id, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(id_of(F.col("id")).alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), id_of(component).alias("component_id"), (F.col("id") == component).alias("kept"))
