"""Least-cost propagation over a grid of any size.

A step to a cell costs that cell's price times its length (res, or res * sqrt(2) diagonally); sources cost 0
whether passable or not. Labels are (cost, source), the smaller first, so ties go to the smaller source id and
the result does not depend on any order of work.

Tiles of `tile` x `tile` cells are solved by a heap each, from their own labels and those of the ring of cells
around them; tiles whose surroundings changed are solved again until nothing changes. A tile's cells are all
that a task holds, and only a flag per round reaches the driver."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .neighbours import with_halo

TILE = 256
SQRT2 = math.sqrt(2.0)
STEPS = tuple((a, b, SQRT2 if a and b else 1.0) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
SOLVED = "cell long, r long, c long, price double, cost double, alloc long, pred long, moved boolean"


def solve_tile(r: np.ndarray, c: np.ndarray, cell: np.ndarray, price: np.ndarray, dist: np.ndarray, alloc: np.ndarray, res: float, cap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost, alloc, pred) of cells from the labels they have; price nan is impassable, alloc -1 unlabelled."""
    at = {(a, b): i for i, (a, b) in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
    d, s, p = dist.tolist(), alloc.tolist(), price.tolist()
    heap = [(d[i], s[i], i) for i in range(len(d)) if s[i] >= 0]
    heapq.heapify(heap)
    rows, cols = r.tolist(), c.tolist()
    while heap:
        du, su, u = heapq.heappop(heap)
        if (du, su) != (d[u], s[u]):
            continue
        for a, b, length in STEPS:
            v = at.get((rows[u] + a, cols[u] + b))
            if v is None or p[v] != p[v]:
                continue
            dv = du + p[v] * (res * length)
            if dv <= cap and (s[v] < 0 or (dv, su) < (d[v], s[v])):
                d[v], s[v] = dv, su
                heapq.heappush(heap, (dv, su, v))
    pred = [-1] * len(d)
    cells = cell.tolist()
    for v in range(len(d)):
        if s[v] < 0 or s[v] == cells[v] and d[v] == 0:
            continue
        best = None
        for a, b, length in STEPS:
            u = at.get((rows[v] + a, cols[v] + b))
            if u is not None and s[u] == s[v] and d[u] + p[v] * (res * length) == d[v] and (best is None or cells[u] < best):
                best = cells[u]
        if best is not None:
            pred[v] = best
    return np.array(d), np.array(s), np.array(pred)


def propagate(cells: DataFrame, price: Column, source: Column, zone: Column | None = None, cap: float = math.inf, res: float = 5.0, tile: int = TILE, start: Column | None = None) -> DataFrame:
    """(cell, r, c, cost, alloc, pred) of the cells reached.

    source is a row's own source id (0 or null: none), usually its cell; price null is impassable, and so is what
    lies outside zone. cap is the largest cost, itself included. `start` gives sources a cost to begin with."""
    if not 0 <= cap:
        raise ValueError("cap must not be negative")
    usable = price if zone is None else F.when(F.coalesce(zone, F.lit(False)), price)
    is_source = source.isNotNull() & (source != 0)
    base = cells.select(
        "cell", "r", "c", usable.cast("double").alias("price"), F.when(is_source, F.coalesce(start, F.lit(0.0)) if start is not None else F.lit(0.0)).otherwise(F.lit(math.inf)).alias("cost"),
        F.when(is_source, source.cast("long")).otherwise(F.lit(-1)).cast("long").alias("alloc"), F.lit(-1).cast("long").alias("pred"),
    )
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d, s, p = solve_tile(pdf["r"].to_numpy(), pdf["c"].to_numpy(), pdf["cell"].to_numpy(), pdf["price"].to_numpy(np.float64, na_value=np.nan), pdf["cost"].to_numpy(), pdf["alloc"].to_numpy(), res, cap)
        out = pdf[["cell", "r", "c", "price"]].assign(cost=d, alloc=s, pred=p, moved=(d != pdf["cost"].to_numpy()) | (s != pdf["alloc"].to_numpy()))
        return out[pdf["own"].to_numpy()]

    if base.select(F.floor(F.col("r") / tile), F.floor(F.col("c") / tile)).distinct().limit(2).count() <= 1:
        # one tile settles at once, as part of the caller's plan
        one = base.withColumns({"own": F.lit(True), "__t": F.lit(0)}).groupBy("__t").applyInPandas(solve, SOLVED)
        return reached_cells(one)
    state, first = base, True
    while True:
        wide = with_halo(state.select("cell", "r", "c", "price", "cost", "alloc", "pred"), tile)
        if not first:  # only tiles that a moved label lies in or next to
            woken = with_halo(state.where("moved").select("r", "c"), tile).select("tr", "tc").distinct()
            live = wide.join(woken, ["tr", "tc"], "left_semi")
            still = wide.where("own").join(woken, ["tr", "tc"], "left_anti").select("cell", "r", "c", "price", "cost", "alloc", "pred", F.lit(False).alias("moved"))
        else:
            live, still = wide, None
        out = live.groupBy("tr", "tc").applyInPandas(solve, SOLVED)
        state = written(out if still is None else out.unionByName(still), "propagation")
        if not state.where("moved").limit(1).count():
            return reached_cells(state)
        first = False


def reached_cells(state: DataFrame) -> DataFrame:
    return state.where("alloc >= 0").select("cell", "r", "c", "cost", "alloc", F.when(F.col("pred") >= 0, F.col("pred")).alias("pred"))


def label_components(cells: DataFrame, mask: Column, tile: int = TILE) -> DataFrame:
    """(cell, component): 8-connected parts of a mask, named by their smallest cell."""
    m = cells.withColumn("__m", F.coalesce(mask, F.lit(False)))
    # ids are shifted by one, as source 0 means none
    got = propagate(m, F.lit(0.0), F.when(F.col("__m"), F.col("cell") + 1), F.col("__m"), tile=tile)
    return got.select("cell", (F.col("alloc") - 1).alias("component"))


def reached(cells: DataFrame, mask: Column, seeds: Column, tile: int = TILE) -> DataFrame:
    """(cell): the parts of a mask that hold a seed; seeds outside the mask do not count."""
    m = cells.withColumns({"__m": F.coalesce(mask, F.lit(False)), "__s": F.coalesce(seeds, F.lit(False))})
    return propagate(m, F.lit(0.0), F.when(F.col("__m") & F.col("__s"), F.lit(1)), F.col("__m"), tile=tile).select("cell")


def trace(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, hop, cell): the cells from each target (column cell) back to its source, by doubling of jumps.

    Targets that were not reached give no rows."""
    jump = written(labels.where("pred is not null").select(F.col("cell").alias("a"), F.col("pred").alias("b")), "jump")
    path = targets.select("cell").distinct().join(labels.select("cell"), "cell", "left_semi").select(F.col("cell").alias("target"), F.lit(0).cast("long").alias("hop"), "cell")
    path = written(path, "path")
    size = 1
    while True:
        step = path.join(jump, path["cell"] == jump["a"]).select("target", (F.col("hop") + size).alias("hop"), F.col("b").alias("cell"))
        more = written(step, "path")
        if not more.limit(1).count():
            return path
        path = written(path.unionByName(more), "path")
        two = jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        jump = written(two, "jump")
        size *= 2


def certificate(cells: DataFrame, labels: DataFrame, price: Column, zone: Column, border: Column, cap: float = math.inf, res: float = 5.0, strict: bool = False, tile: int = TILE) -> DataFrame:
    """(cell, certified, certified_alloc): whether a label stays true when the window's open border is let in.

    A second propagation starts at 0 from the open border cells within the (upper bound) zone; what it can't
    undercut is certain. Equal costs leave the distance certain but not the source."""
    enter = F.coalesce(border, F.lit(False)) & F.coalesce(zone, F.lit(False))
    outer = propagate(cells.withColumn("__e", enter), price, F.when(F.col("__e"), F.col("cell") + 1), zone, cap, res, tile)
    inf = F.lit(math.inf)
    both = cells.select("cell").join(labels.select("cell", F.col("cost").alias("inner")), "cell", "left").join(outer.select("cell", F.col("cost").alias("outer")), "cell", "left")
    a, b = F.coalesce("inner", inf), F.coalesce("outer", inf)
    sure = (a < b) | ((a == inf) & (b == inf))
    return both.select("cell", (sure if strict else a <= b).alias("certified"), sure.alias("certified_alloc"))


def zone_connected(cells: DataFrame, ground: Column, forest: Column, road: Column, price: Column, jump_m: float, res: float = 5.0, tile: int = TILE) -> DataFrame:
    """(cell): forest ground joined to the road: connected forest, then a capped jump over open ground, then the
    forest that the jump lets in. Road cells always belong."""
    from .neighbours import inner_contour

    base = written(cells.select("cell", "r", "c", F.coalesce(ground, F.lit(False)).alias("ground"), F.coalesce(forest, F.lit(False)).alias("forest"), F.coalesce(road, F.lit(False)).alias("road"), price.alias("price")), "zone")
    g, f, d = F.col("ground"), F.col("forest"), F.col("road")
    one = reached(base, g & f | d, d, tile).withColumn("a1", F.lit(True))
    step = written(base.join(one, "cell", "left").withColumn("a1", F.coalesce("a1", F.lit(False))), "zone")
    edge = inner_contour(step, "a1", "edge")
    over = propagate(edge, F.col("price"), F.when(F.col("edge"), F.col("cell") + 1), g & ~F.col("a1"), jump_m, res, tile).select("cell", F.lit(True).alias("over"))
    step = written(step.join(over, "cell", "left").withColumn("a2", F.col("a1") | F.coalesce("over", F.lit(False))), "zone")
    three = reached(step, g & f | F.col("a2"), F.col("a2"), tile)
    return three.unionByName(base.where(d).select("cell")).distinct()


def network_distance(cells: DataFrame, price: Column, res: float = 5.0, tile: int = TILE) -> DataFrame:
    """(cell, distance, unreachable) of road cells: along the network to the nearest cell that is not a track.

    price is that of slope alone; an unreachable cell has distance 0 and is flagged."""
    road = F.col("road").isNotNull()
    net = cells.where(road)
    got = propagate(net, price, F.when(F.col("road") != 2, F.col("cell") + 1), road, res=res, tile=tile)
    return net.select("cell").join(got.select("cell", "cost"), "cell", "left").select("cell", F.coalesce("cost", F.lit(0.0)).alias("distance"), F.col("cost").isNull().alias("unreachable"))


def track_aware(pdf_cols: str = "cell long, r long, c long, cost double, alloc long, track double"):
    """Veto propagation of one window as an applyInPandas function; see `veto_labels`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, s, t = veto_labels(pdf["r"].to_numpy(), pdf["c"].to_numpy(), pdf["price"].to_numpy(np.float64, na_value=np.nan), pdf["source"].fillna(-1).to_numpy(np.int64), pdf["track"].fillna(0).to_numpy(np.float64), float(pdf["res"].iloc[0]), float(pdf["weight"].iloc[0]))
        out = pdf[["cell", "r", "c"]].assign(cost=d, alloc=s, track=t)
        return out[out["alloc"] >= 0]

    return run, pdf_cols


def veto_labels(r: np.ndarray, c: np.ndarray, price: np.ndarray, source: np.ndarray, track: np.ndarray, res: float, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels by forest cost that carry their source's track distance: a strictly cheaper forest cost is taken
    unless it makes forest plus weighted track dearer. Nothing is final, so the order matters: cost, then row.

    Such labels are no minimum of anything; never below plain least cost."""
    at = {(a, b): i for i, (a, b) in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
    n = len(r)
    d = np.where(source >= 0, 0.0, math.inf)
    s, t = source.copy(), np.where(source >= 0, track, 0.0)
    heap = [(0.0, i) for i in range(n) if source[i] >= 0]
    heapq.heapify(heap)
    while heap:
        du, u = heapq.heappop(heap)
        if du != d[u]:
            continue
        for a, b, length in STEPS:
            v = at.get((r[u] + a, c[u] + b))
            if v is None or price[v] != price[v]:
                continue
            dv = du + price[v] * (res * length)
            if dv < d[v] and (s[v] < 0 or d[v] + weight * t[v] > dv + weight * t[u]):
                d[v], s[v], t[v] = dv, s[u], t[u]
                heapq.heappush(heap, (dv, v))
    return d, s, t
