"""Graph queries over typed edges (src, dst, etype, confidence).

Walks are joins of a frontier with the edges, one hop at a time and for all start nodes together; what has been reached
is anti-joined away, so a round's size is that of its new frontier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, self-loops dropped."""
    e = edges.where("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "etype", "confidence"))


def neighbors(edges: DataFrame, starts: DataFrame, etypes: list[str] | None = None, direction: str = "both") -> DataFrame:
    """(node, neighbor, etype) of every start (node)."""
    e = edges.where(F.col("etype").isin(*etypes)) if etypes else edges
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), "etype")
    into = e.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), "etype")
    rows = out if direction == "out" else into if direction == "in" else out.unionByName(into)
    return rows.join(starts, "node", "left_semi").distinct()


def related(edges: DataFrame, weights: dict[str, float], starts: DataFrame, top: int, hubs: tuple[str, ...] = ()) -> DataFrame:
    """(node, other, score): nodes that share targets with a start, by the weighted number of shared targets.

    The start side keeps only the wanted starts, so the join has at most (starts' edges) x (edges of their targets) rows,
    and these are counted before they are ranked. Targets of the types ``hubs`` are shared by many and would square:
    nodes with the same such targets are one class, and only its first top + 1 members meet the starts. Any other that
    shares nothing else with a start has as many before it with its score and a smaller id.
    """
    weights = {t: float(x) for t, x in weights.items()}
    if hubs:
        return _related_by_hubs(edges, weights, starts, top, hubs)
    e = edges.where(F.col("etype").isin(*weights)).select("src", "dst", "etype").distinct()
    mine = e.join(starts.select(F.col("node").alias("src")), "src", "left_semi")
    w = F.coalesce(*(F.when(F.col("etype") == t, F.lit(float(x))) for t, x in weights.items()))
    shared = mine.select(F.col("src").alias("node"), "dst", "etype").join(e.select(F.col("src").alias("other"), "dst", "etype"), ["dst", "etype"]).where("node <> other")
    scores = shared.groupBy("node", "other").agg(F.round(F.sum(w), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("score").desc(), "other"))
    return scores.withColumn("rank", place).where(F.col("rank") <= top)


def _related_by_hubs(edges: DataFrame, weights: dict[str, float], starts: DataFrame, top: int, hubs: tuple[str, ...]) -> DataFrame:
    e = edges.where(F.col("etype").isin(*weights)).select("src", "dst", "etype").where("src IS NOT NULL AND dst IS NOT NULL")
    asked = starts.select(F.col("node").alias("src")).distinct()
    weight = lambda t: F.coalesce(*(F.when(t == n, F.lit(x)) for n, x in weights.items()))
    light = e.where(~F.col("etype").isin(*hubs)).distinct()
    mine = light.join(asked, "src", "left_semi").select(F.col("src").alias("node"), "dst", "etype")
    met = mine.join(light.select(F.col("src").alias("other"), "dst", "etype"), ["dst", "etype"]).where("node <> other")
    met = met.groupBy("node", "other").agg(F.sum(weight(F.col("etype"))).alias("score"))
    of = e.where(F.col("etype").isin(*hubs)).groupBy("src").agg(F.sort_array(F.collect_set(F.struct("etype", "dst"))).alias("to"))
    own = of.join(asked, "src", "left_semi").select(F.col("src").alias("node"), "to")
    nth = F.row_number().over(Window.partitionBy("to").orderBy("src"))
    first = of.withColumn("nth", nth).where(F.col("nth") <= top + 1).groupBy("to").agg(F.collect_list("src").alias("members"))
    classes = own.select("node", F.explode("to").alias("t")).join(first.select("members", F.explode("to").alias("t")), "t").select("node", F.explode("members").alias("other"))
    pairs = met.unionByName(classes.where("node <> other").distinct().select("node", "other", F.lit(0.0).alias("score"))).groupBy("node", "other").agg(F.sum("score").alias("score"))
    both = pairs.join(own, "node", "left").join(of.select(F.col("src").alias("other"), F.col("to").alias("its")), "other", "left")
    shared = F.aggregate(F.array_intersect("to", "its"), F.lit(0.0), lambda s, t: s + weight(t["etype"]))
    scores = both.select("node", "other", F.round(F.col("score") + F.coalesce(shared, F.lit(0.0)), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("score").desc(), "other"))
    return scores.withColumn("rank", place).where(F.col("rank") <= top)


def bfs(edges: DataFrame, starts: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """(start, node, hops): nodes within ``depth`` hops of each start at their least distance, the start itself at 0."""
    e = (edges if directed else both_ways(edges)).select("src", "dst").distinct()
    seen = frontier = starts.select(F.col("node").alias("start"), "node").withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        step = frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(path, hops): simple undirected paths from starts to targets; a path ends at the first target.

    A hop only follows edges to nodes that are near enough to a target for the hops that are left, so hubs do not fan out
    into what leads nowhere. Paths are made distinct, not the edges, of which there are more.
    """
    both = both_ways(edges).select("src", "dst")
    goal = targets.select(F.col("node").alias("end")).distinct()
    steps, near = [], goal
    for left in range(depth):  # from the last hop on: edges into what is so many hops from a target
        steps.append(both if left == depth - 1 else both.join(near, F.col("dst") == F.col("end"), "left_semi"))
        if left < depth - 2:
            near = near.union(steps[-1].select("src")).distinct()
    live = starts.select(F.array("node").alias("path")).distinct()
    found = None
    for e in reversed(steps):
        live = live.withColumn("src", F.element_at("path", -1)).join(e, "src").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")).distinct()
        end = F.element_at("path", -1)
        hit = live.join(goal, end == F.col("end"), "left_semi")
        found = hit if found is None else found.unionByName(hit)
        live = live.join(goal, end == F.col("end"), "left_anti")
    each = found.join(starts.select(F.col("node").alias("start")), F.get("path", F.lit(0)) == F.col("start"))  # a start that stands there twice has its paths twice
    return each.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))


def metapath(edges: DataFrame, steps: list[tuple[str, bool]], least: float = 0.1, weight: float = 1.0, backward: bool = False) -> DataFrame:
    """(start, target, n_paths, best) of a chain of edge types (True: along the edge, False: against it).

    best is the highest product of confidences times the weight; products below ``least`` are cut as they arise, and
    partial paths are merged by (start, node) after every step, so hubs cost their degree, not the number of paths. With
    ``backward``, for chains with fewer targets than starts, they are merged by (node, target) from the last step on, so
    no node on the way has more rows than there are targets, and only whole products below ``least`` are cut.
    """
    rows = None
    for etype, forward in reversed(steps) if backward else steps:
        e = edges.where(F.col("etype") == etype)
        e = e.select(F.col("src" if forward else "dst").alias("a"), F.col("dst" if forward else "src").alias("b"), "confidence")
        if rows is None:
            rows = e.select(F.col("a").alias("start"), F.col("b").alias("node"), F.lit(1).cast("bigint").alias("n"), F.col("confidence").alias("c"))
        elif backward:
            rows = rows.join(e, F.col("start") == F.col("b")).select(F.col("a").alias("start"), "node", "n", (F.col("c") * F.col("confidence")).alias("c"))
        else:
            rows = rows.join(e, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), "n", (F.col("c") * F.col("confidence")).alias("c"))
        rows = (rows if backward else rows.where(F.col("c") >= least)).groupBy("start", "node").agg(F.sum("n").alias("n"), F.max("c").alias("c"))
    rows = rows.where(F.col("c") >= least)
    return rows.select("start", F.col("node").alias("target"), F.col("n").alias("n_paths"), F.round(F.col("c") * weight, 6).alias("best"))


def pathsim(edges: DataFrame, steps: list[tuple[str, bool]]) -> DataFrame:
    """PathSim of node pairs under a symmetric metapath given by its first half: 2 |ij| / (|ii| + |jj|)."""
    half = metapath(edges, steps, least=0.0).select("start", "target", "n_paths")
    own = half.groupBy("start").agg(F.sum(F.col("n_paths") * F.col("n_paths")).alias("self"))
    pairs = half.select(F.col("start").alias("a"), "target", F.col("n_paths").alias("na")).join(half.select(F.col("start").alias("b"), "target", F.col("n_paths").alias("nb")), "target").where("a < b")
    pairs = pairs.groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
    j = pairs.join(own.select(F.col("start").alias("a"), F.col("self").alias("sa")), "a").join(own.select(F.col("start").alias("b"), F.col("self").alias("sb")), "b")
    return j.select("a", "b", F.round(2 * F.col("n") / (F.col("sa") + F.col("sb")), 6).alias("pathsim"))


def shared_neighborhood(edges: DataFrame, starts: DataFrame, etype: str) -> DataFrame:
    """(a, b, score): 2 |N(a) & N(b)| / (|N(a)| + |N(b)|) of each start a with all nodes that share a neighbour of the type."""
    e = both_ways(edges.where(F.col("etype") == etype)).select("src", "dst").distinct()
    degree = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    mine = e.join(starts.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("a"), "dst")
    both = mine.join(e.select(F.col("src").alias("b"), "dst"), "dst").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    j = both.join(degree.select(F.col("src").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("src").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", F.round(2 * F.col("both") / (F.col("na") + F.col("nb")), 6).alias("score"))


def division(edges: DataFrame, etype: str, required: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Sources (node) with an edge to every required target (dst) and to no excluded one."""
    e = edges.where(F.col("etype") == etype).select("src", "dst").distinct()
    need = required.select("dst").distinct()
    n = need.agg(F.count(F.lit(1)).alias("need"))
    out = e.join(need, "dst").groupBy("src").agg(F.count(F.lit(1)).alias("n")).crossJoin(n).where("n = need").select(F.col("src").alias("node"))
    if excluded is not None:
        bad = e.join(excluded.select("dst"), "dst", "left_semi").select(F.col("src").alias("node"))
        out = out.join(bad, "node", "left_anti")
    return out


def authority(edges: DataFrame, etype: str, cap: int) -> DataFrame:
    """(node, score): in-degree over the cap, at most 1."""
    g = edges.where(F.col("etype") == etype).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("node", F.round(F.least(F.col("n"), F.lit(cap)) / cap, 6).alias("score"))


def quality_report(edges: DataFrame, nodes: DataFrame, weak: float) -> DataFrame:
    """(issue, n): dangling ends, weak edges, self-loops and nodes without an edge."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    checks = {
        "dangling": ends.join(nodes, "node", "left_anti"), "weak_confidence": edges.where(F.col("confidence") < weak),
        "self_loop": edges.where("src = dst"), "orphan": nodes.join(ends, "node", "left_anti"),
    }
    out = None
    for name, rows in checks.items():
        row = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("issue"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def provenance(edges: DataFrame) -> DataFrame:
    """Per edge type: edges, share and mean confidence, and the balance of all types (normalised entropy; one type: 0)."""
    g = edges.groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
    whole = Window.partitionBy(F.lit(1))
    g = g.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("kinds", F.count(F.lit(1)).over(whole))
    balance = F.when(F.col("kinds") > 1, -F.sum(F.col("share") * F.ln("share")).over(whole) / F.ln("kinds")).otherwise(F.lit(0.0))
    return g.select("etype", "n", F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"), F.round(balance, 6).alias("balance"))


def merge_layers(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of layers; of rows with one key the earliest layer's stays."""
    rows = None
    for k, layer in enumerate(layers):
        layer = layer.withColumn("layer", F.lit(k))
        rows = layer if rows is None else rows.unionByName(layer)
    first = Window.partitionBy(*key).orderBy("layer", *[c for c in rows.columns if c not in (*key, "layer")])
    return rows.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def siblings(edges: DataFrame, etype: str) -> DataFrame:
    """Unordered pairs of nodes under the same parent."""
    e = edges.where(F.col("etype") == etype).select("src", "dst").distinct()
    return e.select(F.col("src").alias("a"), "dst").join(e.select(F.col("src").alias("b"), "dst"), "dst").where("a < b").select("a", "b", F.col("dst").alias("parent"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Per edge type: edges, distinct sources and targets, highest out- and in-degree."""
    o = edges.groupBy("etype", "src").agg(F.count(F.lit(1)).alias("n")).groupBy("etype").agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("max_out"), F.sum("n").alias("n_edges"))
    i = edges.groupBy("etype", "dst").agg(F.count(F.lit(1)).alias("n")).groupBy("etype").agg(F.count(F.lit(1)).alias("targets"), F.max("n").alias("max_in"))
    return o.join(i, "etype")


def descendants(parents: DataFrame, depth: int = 16) -> DataFrame:
    """Closure (ancestor, node, hops) of (child, parent) rows, of at most ``depth`` levels; a cycle ends where it closes."""
    e = parents.select(F.col("parent").alias("src"), F.col("child").alias("dst")).withColumns({"etype": F.lit("child"), "confidence": F.lit(1.0)})
    roots = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return bfs(e, roots, depth).where("hops > 0").withColumnRenamed("start", "ancestor")


def transitive(edges: DataFrame, starts: DataFrame, target: str, decay: tuple[float, ...] = (0.8, 0.6, 0.4)) -> DataFrame:
    """(start, node, hops, weight): targets (nodes whose id starts with ``target``) along the edges; a walk does not go on through one.

    The weight is that of the hop at which a target is first met; as many hops as ``decay`` has.
    """
    e = edges.select("src", "dst").distinct()
    seen = front = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    for hop in range(1, len(decay) + 1):
        go = front.where(~F.col("node").startswith(target)) if hop > 1 else front
        step = go.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(front)
    weight = F.get(F.array(*map(F.lit, decay)), F.col("hops") - 1)
    return seen.where((F.col("hops") > 0) & F.col("node").startswith(target)).select("start", "node", "hops", weight.alias("weight"))


def transitive_boost(matches: DataFrame, each: float = 0.05, most: float = 0.15) -> DataFrame:
    """(start, boost): so much for each match, up to a limit."""
    return matches.groupBy("start").agg(F.round(F.least(F.lit(most), F.count(F.lit(1)) * each), 6).alias("boost"))


def nodes_by_name(names: DataFrame, wanted: list[str]) -> DataFrame:
    """Nodes of (node, name), one row for each label or alias, that go by one of the wanted names, case and punctuation ignored."""
    from lodespark.functions import text as T

    return names.where(T.normalize(F.col("name")).isin(*(T.normalize(F.lit(w)) for w in wanted))).select("node").distinct()


def hierarchy_score(have: DataFrame, asked: list[str], closure: DataFrame) -> DataFrame:
    """(id, score): how well a record's regions (id, region) meet the asked ones in a hierarchy (ancestor, node).

    The best of all pairs: 1 if equal, 0.7 if an asked region is above one of the record's, 0.5 if below, 0.4 if only
    the part of the name before the first underscore (of four letters or more) is the same, else 0.
    """
    want = F.array(*map(F.lit, asked))
    up = closure.where(F.col("ancestor").isin(*asked)).select(F.col("node").alias("region"), F.lit(0.7).alias("s"))
    down = closure.where(F.col("node").isin(*asked)).select(F.col("ancestor").alias("region"), F.lit(0.5).alias("s"))
    near = up.unionByName(down).groupBy("region").agg(F.max("s").alias("s"))
    stem = lambda c: F.substring_index(c, "_", 1)
    same_stem = (F.length("region") >= 4) & F.array_contains(F.transform(want, stem), stem(F.col("region")))
    own = F.when(F.col("region").isin(*asked), 1.0).when(F.col("s").isNotNull(), F.col("s")).when(same_stem, 0.4).otherwise(0.0)
    return have.join(near, "region", "left").groupBy("id").agg(F.max(own).alias("score"))


def shortest_paths(paths: DataFrame) -> DataFrame:
    """(start, end, path, hops): of each pair's paths (path joined by >, hops) the shortest, ties by text."""
    p = paths.select(F.substring_index("path", ">", 1).alias("start"), F.substring_index("path", ">", -1).alias("end"), "path", "hops")
    return p.groupBy("start", "end").agg(F.min(F.struct("hops", "path")).alias("x")).select("start", "end", "x.path", "x.hops")


def induced(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges between the seeds (node) and their neighbours, all of them."""
    near = both_ways(edges).join(seeds, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node"))
    nodes = seeds.select("node").union(near).distinct()
    return edges.join(nodes, F.col("src") == F.col("node"), "left_semi").join(nodes, F.col("dst") == F.col("node"), "left_semi")


def strongest_out(edges: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight, rank): of each source the k targets of greatest confidence, several edges to one counted once."""
    w = edges.groupBy("src", "dst").agg(F.max("confidence").alias("weight"))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst"))).where(F.col("rank") <= k)


#: Greatest weight of a contracted edge, and edges for each step of it.
MOST_WEIGHT, STEP = 5, 3


def contracted(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(source, target, relation, n, weight): the (a, b, relation) edges between (node, cluster) clusters, one for each unordered pair.

    Edges of one direction and relation are counted; of a pair's counts the greatest stays, ties to the smallest source,
    target and relation. Edges inside a cluster, with a null relation or with an end in none are left out; of several
    clusters a node has the greatest. Counting needs no window, so a pair of hubs is added up before the shuffle.
    """
    of = clusters.where("node IS NOT NULL AND cluster IS NOT NULL").groupBy("node").agg(F.max("cluster").alias("cluster"))
    rows = edges.select("a", "b", "relation").where("relation IS NOT NULL")
    rows = rows.join(of.select(F.col("node").alias("a"), F.col("cluster").alias("source")), "a").join(of.select(F.col("node").alias("b"), F.col("cluster").alias("target")), "b")
    counts = rows.where("source <> target").groupBy("source", "target", "relation").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("less"), "source", "target", "relation", "n")).alias("x")
    kept = counts.groupBy(F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")).agg(first)
    return kept.select("x.source", "x.target", "x.relation", "x.n", F.least(F.lit(MOST_WEIGHT).cast("bigint"), 1 + F.floor(F.col("x.n") / STEP)).alias("weight"))
