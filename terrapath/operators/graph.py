"""Road graphs: components, contraction, flow, typing and integrity."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written
from .algebra import flow_type
from .recap import convert_until


#: Graphs of at most this many edges are one task's work.
LOCAL = 200_000


def united(pdf: pd.DataFrame) -> pd.DataFrame:
    """Components of a few edges in one task."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
        x, y = top(x), top(y)
        above[max(x, y)] = min(x, y)
    ids = list(above)
    return pd.DataFrame({"id": ids, "component": [top(x) for x in ids]}, dtype="int64")


def components(edges: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """(id, component) of undirected edges of longs; the component is its smallest id.

    Up to `local` edges are united in one task, be it at once or after some rounds."""
    e = written(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")), "edges")
    if e.limit(local + 1).count() <= local:
        return e.groupBy(F.lit(0).alias("k")).applyInPandas(united, "id long, component long")
    # each round every node points to the node around it, itself included, whose hash is smallest, and then to that
    # one's own; the edges are drawn anew between the nodes pointed to. Hashes change with the round, so a chain in any
    # order of ids shrinks by a share each round
    ids = written(e.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    e = written(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label, turn = ids.select("id", F.col("id").alias("mark")), 0
    while left := e.limit(local + 1).count():
        if left <= local:
            rest = e.groupBy(F.lit(0).alias("k")).applyInPandas(united, "id long, component long").withColumnRenamed("id", "mark")
            label = written(label.join(rest, "mark", "left").select("id", F.coalesce("component", "mark").alias("mark")), "labels")
            break
        around = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), "b"))
        up = F.when(F.col("m.h") < F.xxhash64("a", F.lit(turn)), F.col("m.b")).otherwise(F.col("a"))
        hook = written(around.groupBy("a").agg(least.alias("m")).select(F.col("a").alias("id"), up.alias("up")), "hook")
        jump = written(hook.join(hook.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up")), "jump")
        x, y = jump.select(F.col("id").alias("a"), F.col("up").alias("x")), jump.select(F.col("id").alias("b"), F.col("up").alias("y"))
        met = e.join(x, "a").join(y, "b").where("x <> y")
        e = written(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        moved = jump.select(F.col("id").alias("mark"), "up")
        label = written(label.join(moved, "mark", "left").select("id", F.coalesce("up", "mark").alias("mark")), "labels")
        turn += 1
    smallest = label.groupBy("mark").agg(F.min("id").alias("component"))
    return label.join(smallest, "mark").select("id", "component")


def fine_edges(cells: DataFrame, network: Column, res: float = 5.0) -> DataFrame:
    """(a, b, length_m): undirected edges a < b between 8-adjacent network cells."""
    net = cells.where(F.coalesce(network, F.lit(False))).select("cell", "r", "c")
    half = F.array(*[F.struct(F.lit(x).alias("dr"), F.lit(y).alias("dc")) for x, y in ((0, 1), (1, -1), (1, 0), (1, 1))])
    out = net.select("cell", F.explode(half).alias("d"), "r", "c").select("cell", (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"), F.when((F.col("d.dr") != 0) & (F.col("d.dc") != 0), F.lit(res * 2**0.5)).otherwise(F.lit(float(res))).alias("length_m"))
    met = out.join(net.select(F.col("cell").alias("other"), "r", "c"), ["r", "c"])
    return met.select(F.least("cell", "other").alias("a"), F.greatest("cell", "other").alias("b"), "length_m")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def node_types(edges: DataFrame, outlets: DataFrame) -> DataFrame:
    """(node, degree, type): outlet, junction (3 or more), leaf (1) or passage."""
    d = degrees(edges).join(outlets.select(F.col("node"), F.lit(True).alias("__o")), "node", "left")
    kind = F.when(F.coalesce("__o", F.lit(False)), "outlet").when(F.col("degree") >= 3, "junction").when(F.col("degree") == 1, "leaf").otherwise("passage")
    return d.select("node", "degree", kind.alias("type"))


def contract(edges: DataFrame, outlets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with chains of passages made one edge (a, b, length_m, pieces). Rings of passages alone vanish.

    A chain is a component of its passages; its ends are the marked nodes its edges touch."""
    kinds = written(node_types(edges, outlets), "nodes")
    kind = kinds.select("node", (F.col("type") == "passage").alias("p"))
    e = edges.withColumn("edge", F.xxhash64("a", "b")).join(kind.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(kind.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
    e = written(e, "edges")
    chain = components(e.where("pa and pb"))
    own = F.when(F.col("pa"), F.col("a")).when(F.col("pb"), F.col("b"))
    keyed = e.withColumn("__n", own).join(chain.select(F.col("id").alias("__n"), "component"), "__n", "left")
    # a passage alone between two marked nodes is a chain of its own; an edge between marked nodes stays
    keyed = keyed.withColumn("chain", F.when(F.col("__n").isNull(), F.concat(F.lit("e"), F.col("edge").cast("string"))).otherwise(F.concat(F.lit("c"), F.coalesce("component", "__n").cast("string"))))
    ends = F.flatten(F.collect_list(F.filter(F.array(F.when(~F.col("pa"), F.col("a")), F.when(~F.col("pb"), F.col("b"))), lambda x: x.isNotNull())))
    out = keyed.groupBy("chain").agg(F.sum("length_m").alias("length_m"), F.count("*").alias("pieces"), F.sort_array(ends).alias("ends"))
    out = out.where(F.size("ends") == 2).select(F.col("ends")[0].alias("a"), F.col("ends")[1].alias("b"), "length_m", "pieces")
    return kinds.where("type <> 'passage'"), out


def shortest_here(edges: pd.DataFrame, outlets: pd.DataFrame) -> pd.DataFrame:
    """Shortest ways over a few edges in one task."""
    near: dict[int, list[tuple[int, float]]] = {}
    for x, y, length in zip(edges["a"].tolist(), edges["b"].tolist(), edges["length_m"].tolist(), strict=True):
        near.setdefault(x, []).append((y, length))
        near.setdefault(y, []).append((x, length))
    best: dict[int, tuple[float, int]] = {int(x): (0.0, -1) for x in outlets["node"]}
    heap = [(0.0, x) for x in best]
    heapq.heapify(heap)
    while heap:
        d, x = heapq.heappop(heap)
        if d > best[x][0]:
            continue
        for y, length in near.get(x, ()):
            if y not in best or (d + length, x) < best[y]:
                shorter = y not in best or d + length < best[y][0]
                best[y] = (d + length, x)
                if shorter:
                    heapq.heappush(heap, (d + length, y))
    rows = [(n, d, p if p >= 0 else None) for n, (d, p) in best.items()]
    return pd.DataFrame(rows, columns=["node", "distance", "parent"]).astype({"node": "int64", "distance": "float64", "parent": "Int64"})


def relaxed(arcs: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, distance, parent) by rounds until nothing gets shorter; a round joins only what the last one moved."""
    state = written(ends.select("node", F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("parent"), F.lit(True).alias("moved")), "paths")
    while state.where("moved").limit(1).count():
        front = state.where("moved").select(F.col("node").alias("a"), "distance")
        step = front.join(arcs, "a").groupBy("b").agg(F.min(F.struct((F.col("distance") + F.col("length_m")).alias("d"), F.col("a").alias("p"))).alias("m"))
        j = state.drop("moved").join(step.select(F.col("b").alias("node"), "m"), "node", "full")
        shorter = F.col("m").isNotNull() & (F.col("distance").isNull() | (F.col("m.d") < F.col("distance")))
        tied = F.col("m").isNotNull() & (F.col("m.d") == F.col("distance")) & (F.col("m.p") < F.col("parent"))
        pick = lambda new, old: F.when(shorter | tied, F.col(new)).otherwise(F.col(old))
        state = written(j.select("node", pick("m.d", "distance").alias("distance"), pick("m.p", "parent").alias("parent"), F.coalesce(shorter, F.lit(False)).alias("moved")), "paths")
    return state.drop("moved")


def shortest_to_outlets(edges: DataFrame, outlets: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, distance, parent): shortest way along edges (a, b, length_m) to any outlet; ties to the smaller parent.

    Up to `local` edges one task solves. Beyond, chains between junctions, leaves and outlets are first made one edge
    each; the contracted graph settles in as many rounds as a way has junctions, however long the chains are, and the
    nodes within a chain take the nearer of its ends. Nodes are not negative."""
    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("length_m").cast("double").alias("length_m")), "edges")
    ends = outlets.select(F.col("node").cast("long").alias("node")).distinct()
    if edges.limit(local + 1).count() <= local:
        return edges.groupBy(F.lit(0).alias("k")).cogroup(ends.groupBy(F.lit(0).alias("k"))).applyInPandas(shortest_here, "node long, distance double, parent long")
    arcs = lambda e: written(e.select("a", "b", "length_m").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "length_m")), "arcs")
    kept = node_types(edges.where("a <> b"), ends).where("type <> 'passage'").select("node")
    inner = written(degrees(edges).select("node").join(kept, "node", "left_anti"), "inner")
    if not inner.limit(1).count():
        return relaxed(arcs(edges), ends)
    # distances of the nodes that chains run between
    _, chains = contract(edges.where("a <> b"), ends)
    far = written(relaxed(arcs(chains.where("a <> b")), ends), "far")
    # along a chain the distance is that of its end plus the way there: doubling finds both ends of every inner node
    both = arcs(edges.where("a <> b"))
    hop = both.join(inner.select(F.col("node").alias("a")), "a", "left_semi")
    walk = written(hop.select(F.col("a").alias("node"), F.col("b").alias("first"), F.col("b").alias("at"), F.col("a").alias("back"), "length_m").withColumn("open", F.lit(True)).join(inner.select(F.col("node").alias("at"), F.lit(True).alias("in")), "at", "left").withColumn("open", F.coalesce("in", F.lit(False))).drop("in"), "walk")
    for _ in range(inner.count().bit_length()):  # no chain has more nodes; what is open then runs round a ring
        # a walk that came to `at` from `back` goes on as the walk of `at` whose first step is not back there
        on = walk.select(F.col("node").alias("at"), F.col("first").alias("f2"), F.col("at").alias("at2"), F.col("back").alias("back2"), F.col("length_m").alias("l2"), F.col("open").alias("open2"))
        moved = walk.where("open").join(on, "at").where("f2 <> back")
        moved = moved.where("at2 <> node").select("node", "first", F.col("at2").alias("at"), F.col("back2").alias("back"), (F.col("length_m") + F.col("l2")).alias("length_m"), F.col("open2").alias("open"))
        walk = written(walk.where("not open").unionByName(moved), "walk")
        if not walk.where("open").limit(1).count():
            break
    best = walk.where("not open").join(far.select(F.col("node").alias("at"), "distance"), "at").groupBy("node").agg(F.min((F.col("distance") + F.col("length_m"))).alias("distance"))
    dist = written(far.select("node", "distance").unionByName(best), "distance")
    # the parent is the smallest neighbour on a shortest way
    up = both.join(dist.select(F.col("node").alias("b"), F.col("distance").alias("d")), "b").join(dist.select(F.col("node").alias("a"), "distance"), "a")
    up = up.where(F.abs(F.col("d") + F.col("length_m") - F.col("distance")) <= 1e-9 * (1 + F.col("distance"))).groupBy("a").agg(F.min("b").alias("parent"))
    roots = ends.select(F.col("node"), F.lit(True).alias("end"))
    return dist.join(up.withColumnRenamed("a", "node"), "node", "left").join(roots, "node", "left").select("node", "distance", F.when(F.col("end").isNull(), F.col("parent")).alias("parent"))


def accumulate(paths: DataFrame, amounts: DataFrame) -> DataFrame:
    """(node, parent, flow): what passes from each node to its parent, all amounts (node, amount) running to an outlet.

    Ancestors are found by doubling: a round's jumps are twice as long as the last's."""
    jump = written(paths.where("parent is not null").select(F.col("node").alias("a"), F.col("parent").alias("b")), "jump")
    at = written(amounts.join(paths.select("node"), "node", "left_semi").groupBy("node").agg(F.sum("amount").alias("amount")).select(F.col("node").alias("at"), "amount"), "flow")
    while True:
        moved = written(at.join(jump, at["at"] == jump["a"]).select(F.col("b").alias("at"), "amount"), "flow")
        if not moved.limit(1).count():
            break
        at = written(at.unionByName(moved).groupBy("at").agg(F.sum("amount").alias("amount")), "flow")
        jump = written(jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")), "jump")
    return paths.select("node", "parent").join(at.select(F.col("at").alias("node"), F.col("amount").alias("flow")), "node", "left").select("node", "parent", F.coalesce("flow", F.lit(0.0)).alias("flow"))


def type_roads(edges: DataFrame, thresholds: Sequence[float], budget_m: float | None = None, in_zone: Column | None = None) -> DataFrame:
    """edges (id, flow, length_m) plus type by flow, and which of the last type turn temporary within a length budget."""
    typed = edges.withColumn("type", flow_type(F.col("flow"), thresholds))
    if budget_m is None:
        return typed
    top = typed.where(F.col("type") == 1)
    done = convert_until(top, budget_m, in_zone if in_zone is not None else F.lit(False))
    return typed.where(F.col("type") != 1).withColumn("converted", F.lit(False)).unionByName(done)


def snapped_nodes(segments: DataFrame, tolerance: float) -> DataFrame:
    """segments plus node keys a and b of their ends (x0, y0, x1, y1), rounded to the tolerance."""
    at = lambda x, y: F.xxhash64(F.round(F.col(x) / tolerance).cast("long"), F.round(F.col(y) / tolerance).cast("long"))
    return segments.withColumns({"a": at("x0", "y0"), "b": at("x1", "y1")})


def integrity(segments: DataFrame, classes: str = "class") -> DataFrame:
    """segments (id, class, a, b) plus component, reaches_public and violates.

    A track's component must hold a main or public road, a main road's a public one; null class stays unknown."""
    comp = components(segments)
    c = segments.join(comp.select(F.col("id").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    w = Window.partitionBy("component")
    has = lambda *k: F.coalesce(F.bool_or(F.col(classes).isin(*k)).over(w), F.lit(False))
    out = c.withColumns({"reaches_public": has("public"), "__served": has("public", "main")})
    violates = F.when(F.col(classes) == "track", ~F.col("__served")).when(F.col(classes) == "main", ~F.col("reaches_public")).when(F.col(classes).isNotNull(), F.lit(False))
    return out.withColumn("violates", violates).drop("__served")


def violation_causes(checked: DataFrame, loose: DataFrame, near_border: str = "near_border") -> DataFrame:
    """checked violations plus cause: the component touches the border, or a looser tolerance mends it, or it is real."""
    w = Window.partitionBy("component")
    edge = F.bool_or(F.coalesce(near_border, F.lit(False))).over(w)
    j = checked.withColumn("__edge", edge).join(loose.select("id", F.col("violates").alias("__still")), "id", "left")
    cause = F.when(~F.coalesce("violates", F.lit(False)), F.lit(None).cast("string")).when(F.col("__edge"), "border").when(~F.coalesce("__still", F.lit(True)), "topology").otherwise("real")
    return j.withColumn("cause", cause).drop("__edge", "__still")
