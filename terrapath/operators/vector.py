"""Lines, polygons and points against the grid and each other.

Lines and rings are arrays of struct<x, y>. Spatial joins are bucketed: both sides get the grid buckets they can
meet in, join on bucket equality and test exactly; a bucket is as wide as the largest distance asked for."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import few, written


def segments(lines: DataFrame, vertices: str = "vertices") -> DataFrame:
    """lines with a row per segment: k, x0, y0, x1, y1, length_m and start_m along the line."""
    v = F.col(vertices)
    pairs = F.posexplode(F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("p"), F.slice(v, F.lit(2), F.size(v) - 1).alias("q")))
    out = lines.where(F.size(v) >= 2).select("*", pairs.alias("k", "__s"))
    out = out.withColumns({"x0": F.col("__s.p.x"), "y0": F.col("__s.p.y"), "x1": F.col("__s.q.x"), "y1": F.col("__s.q.y")}).drop("__s")
    return out.withColumn("length_m", F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)))


def line_length(v: Column) -> Column:
    """Length of an array of points."""
    steps = F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def point_at(lines: DataFrame, at: Column, vertices: str = "vertices") -> DataFrame:
    """lines plus (x, y) at a distance along each line, clamped to its ends; lines of one point are left out.

    One pass over each line's vertices: the last segment that starts within the distance holds the point."""
    v = F.col(vertices)
    d = F.least(F.greatest(at, F.lit(0.0)), line_length(v))
    pairs = F.arrays_zip(F.slice(v, F.lit(1), F.size(v) - 1).alias("p"), F.slice(v, F.lit(2), F.size(v) - 1).alias("q"))

    def walk(state: Column, s: Column) -> Column:
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        length = F.sqrt(F.pow(dx, 2) + F.pow(dy, 2))
        t = F.when(length > 0, F.least((F.col("__d") - state["m"]) / length, F.lit(1.0))).otherwise(0.0)
        here = state["m"] <= F.col("__d")
        place = [F.when(here, s["p"][k] + t * step).otherwise(state[k]).alias(k) for k, step in (("x", dx), ("y", dy))]
        return F.struct((state["m"] + length).alias("m"), *place)

    none = F.lit(None).cast("double")
    found = F.aggregate(pairs, F.struct(F.lit(0.0).alias("m"), none.alias("x"), none.alias("y")), walk)
    long_enough = lines.where(F.size(v) >= 2).withColumn("__d", d).withColumn("__p", found)
    return long_enough.select(*lines.columns, F.col("__p.x").alias("x"), F.col("__p.y").alias("y"))


def numbered(df: DataFrame, name: str = "__id") -> DataFrame:
    """df with a number per row. It is written, as numbers that two branches of a plan make anew may differ."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def crosses_box(x0: Column, y0: Column, x1: Column, y1: Column, left: Column, bottom: Column, size: float) -> Column:
    """Whether a segment touches a closed square, by clipping its parameter range."""
    low, high, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, b, edge in ((x0, x1, left), (y0, y1, bottom)):
        d = b - a
        p, q = (edge - a) / d, (edge + size - a) / d
        low = F.when(d == 0, low).otherwise(F.greatest(low, F.least(p, q)))
        high = F.when(d == 0, high).otherwise(F.least(high, F.greatest(p, q)))
        ok = ok & ((d != 0) | ((a >= edge) & (a <= edge + size)))
    return ok & (low <= high)


def touched_cells(lines: DataFrame, res: float, vertices: str = "vertices") -> DataFrame:
    """lines with a row per grid cell (r, c) that any of their segments touches; x grows with c and y with r."""
    s = segments(lines, vertices)
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / res).cast("long"), F.floor(F.greatest(a, b) / res).cast("long"))
    cand = s.withColumn("r", F.explode(span(F.col("y0"), F.col("y1")))).withColumn("c", F.explode(span(F.col("x0"), F.col("x1"))))
    hit = cand.where(crosses_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("c") * res, F.col("r") * res, res))
    return hit.select(*[c for c in lines.columns if c != vertices], "r", "c").distinct()


def length_in_cells(lines: DataFrame, res: float, vertices: str = "vertices") -> DataFrame:
    """(r, c, length_m): line length within each cell."""
    s = segments(lines, vertices)
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / res).cast("long"), F.floor(F.greatest(a, b) / res).cast("long"))
    t = s.withColumn("r", F.explode(span(F.col("y0"), F.col("y1")))).withColumn("c", F.explode(span(F.col("x0"), F.col("x1"))))
    low, high = F.lit(0.0), F.lit(1.0)
    for a, b, k in (("x0", "x1", "c"), ("y0", "y1", "r")):
        d = F.col(b) - F.col(a)
        p, q = (F.col(k) * res - F.col(a)) / d, ((F.col(k) + 1) * res - F.col(a)) / d
        low = F.when(d == 0, low).otherwise(F.greatest(low, F.least(p, q)))
        high = F.when(d == 0, high).otherwise(F.least(high, F.greatest(p, q)))
    return t.withColumn("__l", F.greatest(high - low, F.lit(0.0)) * F.col("length_m")).groupBy("r", "c").agg(F.sum("__l").alias("length_m")).where("length_m > 0")


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule for a point and a closed or open ring."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, F.lit(2), F.size(ring) - 1), F.slice(ring, F.lit(1), F.lit(1))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    cross = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])
    return F.aggregate(edges, F.lit(False), lambda a, e: a != F.coalesce(cross(e), F.lit(False)))


def cells_in_polygons(cells: DataFrame, polygons: DataFrame, res: float, ring: str = "ring", bucket: int = 64) -> DataFrame:
    """cells joined to the polygons whose ring holds their centre; a cell may have several."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    side = bucket * res
    span = lambda a: F.sequence(F.floor(F.array_min(a) / side).cast("long"), F.floor(F.array_max(a) / side).cast("long"))
    p = polygons.withColumn("__br", F.explode(span(ys))).withColumn("__bc", F.explode(span(xs)))
    t = cells.withColumns({"__x": (F.col("c") + 0.5) * res, "__y": (F.col("r") + 0.5) * res, "__br": F.floor(F.col("r") / bucket), "__bc": F.floor(F.col("c") / bucket)})
    return t.join(p, ["__br", "__bc"]).where(inside(F.col(ring), F.col("__x"), F.col("__y"))).drop("__br", "__bc", "__x", "__y", ring)


RING = "array<struct<x:double,y:double>>"


def half_plane(ring: Column, edge: Column) -> Column:
    """The part of a ring (open, array of points) beyond an edge: a struct of `along` (whether it bounds x), `bound` and
    `above`."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.least(F.size(ring), F.lit(1))))
    own = lambda p: F.when(edge["along"], p["x"]).otherwise(p["y"])
    other = lambda p: F.when(edge["along"], p["y"]).otherwise(p["x"])
    within = lambda p: F.when(edge["above"], own(p) >= edge["bound"]).otherwise(own(p) <= edge["bound"])

    def step(p: Column, q: Column) -> Column:
        met = other(p) + (edge["bound"] - own(p)) / (own(q) - own(p)) * (other(q) - other(p))
        cut = F.struct(F.when(edge["along"], edge["bound"]).otherwise(met).alias("x"), F.when(edge["along"], met).otherwise(edge["bound"]).alias("y"))
        return F.filter(F.array(F.when(within(p), p), F.when(within(p) != within(q), cut)), lambda x: x.isNotNull())

    return F.flatten(F.zip_with(ring, after, step)).cast(RING)


def ring_area(ring: Column) -> Column:
    """Area of a ring, by the sum of its edges' cross products."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
    return F.abs(F.aggregate(F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda a, x: a + x)) / 2


def clip(polygons: DataFrame, x0: float, y0: float, x1: float, y1: float, ring: str = "ring") -> DataFrame:
    """polygons with their rings cut to a box, and `area`; those without area inside are left out, as are rings of fewer
    than three different points. A last point that repeats the first is dropped."""
    r = F.col(ring)
    r = F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)
    out = polygons.withColumn(ring, r).where(F.size(F.array_distinct(ring)) >= 3)
    # one expression that is handed the ring four times, as four columns would be multiplied out into each other
    edge = lambda along, bound, above: F.struct(F.lit(along).alias("along"), F.lit(float(bound)).alias("bound"), F.lit(above).alias("above"))
    box = F.array(edge(True, x0, True), edge(True, x1, False), edge(False, y0, True), edge(False, y1, False))
    out = out.withColumn(ring, F.aggregate(box, F.col(ring).cast(RING), half_plane))
    return out.where(F.size(ring) >= 3).withColumn("area", ring_area(F.col(ring))).where("area > 0")


def lambert_conic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of degrees on the GRS80 ellipsoid, in the conformal conic of two standard parallels that the
    French grid uses."""
    # fixed values: axis and flattening of the ellipsoid, parallels, origin and false origin of the grid
    a, e2 = 6378137.0, (2 - 1 / 298.257222101) / 298.257222101
    south, north, lat0, lon0, x0, y0 = 44.0, 49.0, 46.5, 3.0, 700000.0, 6600000.0
    e = math.sqrt(e2)

    def radius(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    def iso(phi: float) -> float:
        return math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi))

    lo, hi = math.radians(south), math.radians(north)
    n = math.log(radius(lo) / radius(hi)) / (iso(hi) - iso(lo))
    scale = a * radius(lo) / n * math.exp(n * iso(lo))
    top = scale * math.exp(-n * iso(math.radians(lat0)))
    sin = F.sin(F.radians(lat))
    rho = F.exp(-n * (F.atanh(sin) - e * F.atanh(e * sin))) * scale
    turn = n * F.radians(lon - lon0)
    return x0 + rho * F.sin(turn), y0 + top - rho * F.cos(turn)


def last_zone(cells: DataFrame, polygons: DataFrame, res: float, rank: str = "rank", ring: str = "ring") -> DataFrame:
    """(cell, zone): each cell's zone, the one of the highest rank where zones overlap."""
    return cells_in_polygons(cells.select("cell", "r", "c"), polygons, res, ring).groupBy("cell").agg(F.max(rank).alias("zone"))


def mean_of_polygons(cells: DataFrame, polygons: DataFrame, res: float, value: str, ring: str = "ring") -> DataFrame:
    """cells plus the mean value of the polygons over their centre, null outside."""
    m = cells_in_polygons(cells.select("cell", "r", "c"), polygons, res, ring).groupBy("cell").agg(F.avg(value).alias(value))
    return cells.join(m, "cell", "left")


def strongest_class(touched: DataFrame, code: str = "code") -> DataFrame:
    """(r, c, code): the largest class code among the lines that touch a cell."""
    return touched.groupBy("r", "c").agg(F.max(code).alias(code))


def point_segment(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = x1 - x0, y1 - y0
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((px - x0) * dx + (py - y0) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.sqrt(F.pow(px - (x0 + t * dx), 2) + F.pow(py - (y0 + t * dy), 2))


def spread_buckets(df: DataFrame, x_low: Column, x_high: Column, y_low: Column, y_high: Column, side: float) -> DataFrame:
    at = lambda v: F.floor(v / side).cast("long")
    return df.withColumn("__bx", F.explode(F.sequence(at(x_low), at(x_high)))).withColumn("__by", F.explode(F.sequence(at(y_low), at(y_high))))


def stepping(segs: DataFrame, side: float, *keep: str) -> DataFrame:
    """keep plus (__cx, __cy): squares of a side that segments (x0, y0, x1, y1) pass, by points on them at most a side
    apart. A square may be left out, but none is given that the segment does not touch."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    n = F.ceil(length / side).cast("int") + 1
    t = segs.where(length < math.inf).select(*keep, "x0", "y0", "x1", "y1", n.alias("__n"))
    t = t.select(*keep, "x0", "y0", "x1", "y1", "__n", F.explode(F.sequence(F.lit(0), F.col("__n"))).alias("__i"))
    at = lambda a, b: F.floor((F.col(a) + F.col("__i") / F.col("__n") * (F.col(b) - F.col(a))) / side)
    return t.select(*keep, at("x0", "x1").alias("__cx"), at("y0", "y1").alias("__cy"))


#: A square's side as share of a distance: its diagonal is 0.99 of it, so what is in a square that a segment touches is near.
SURE = 0.7


def within(points: DataFrame, segs: DataFrame, distance: float, squared: bool = False) -> DataFrame:
    """points (x, y, ...) that lie within a distance of any segment; `squared` compares squares, as nearest_within does.

    Points in a square that a segment passes, or in one that is near enough to such a square, are near without a
    comparison, so crowded places cost no pairs; only the others meet the segments around them."""
    sure = SURE * distance
    passed = few(written(stepping(segs, sure).distinct(), "passed"))
    p = points.withColumns({"__cx": F.floor(F.col("x") / sure), "__cy": F.floor(F.col("y") / sure)})
    p = p.where(~F.isnan("x") & ~F.isnan("y"))
    known = p.join(passed, ["__cx", "__cy"], "left_semi").select(*points.columns)
    rest = numbered(p.join(passed, ["__cx", "__cy"], "left_anti").select(*points.columns))
    if not rest.limit(1).count():
        return known
    # the same by squares of an eighth: all of one is near to all of the other if their middles and half diagonals say so
    fine = distance / 8
    ring = [(i, j) for i in range(-8, 9) for j in range(-8, 9) if math.hypot(i, j) + math.sqrt(2) <= 0.99 * 8]
    square = {"__qx": F.floor(F.col("x") / fine), "__qy": F.floor(F.col("y") / fine)}
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ring]))
    around = rest.select(*[c.alias(k) for k, c in square.items()]).distinct().withColumn("__o", offsets)
    around = around.select("__qx", "__qy", (F.col("__qx") + F.col("__o.i")).alias("__cx"), (F.col("__qy") + F.col("__o.j")).alias("__cy"))
    passed = few(written(stepping(segs, fine).distinct(), "passed"))
    sure = few(written(around.join(passed, ["__cx", "__cy"], "left_semi").select("__qx", "__qy").distinct(), "near"))
    q = rest.withColumns(square)
    known = known.unionByName(q.join(sure, ["__qx", "__qy"], "left_semi").select(*points.columns))
    rest = written(q.join(sure, ["__qx", "__qy"], "left_anti").drop("__qx", "__qy"), "rest")
    a = rest.withColumns({"__bx": F.floor(F.col("x") / distance).cast("long"), "__by": F.floor(F.col("y") / distance).cast("long")})
    places = few(written(a.select("__bx", "__by").distinct(), "places"))
    low, high = lambda u, v: F.least(F.col(u), F.col(v)) - distance, lambda u, v: F.greatest(F.col(u), F.col(v)) + distance
    b = spread_buckets(segs.select("x0", "y0", "x1", "y1"), low("x0", "x1"), high("x0", "x1"), low("y0", "y1"), high("y0", "y1"), distance)
    b = b.join(places, ["__bx", "__by"], "left_semi")
    gap = point_segment(F.col("x"), F.col("y"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    near = F.pow(F.col("x") - F.col("x0"), 2) + F.pow(F.col("y") - F.col("y0"), 2) <= distance * distance if squared else gap <= distance
    hit = a.join(b, ["__bx", "__by"]).where(near).select("__id").distinct()
    return known.unionByName(rest.join(hit, "__id", "left_semi").select(*points.columns))


def near_points(points: DataFrame, targets: DataFrame, distance: float) -> DataFrame:
    """points (x, y, ...) with a target (tx, ty) within a distance."""
    spots = targets.select(F.col("tx").alias("x0"), F.col("ty").alias("y0"), F.col("tx").alias("x1"), F.col("ty").alias("y1"))
    return within(points, spots, distance, squared=True)


def nearest_within(points: DataFrame, targets: DataFrame, distance: float, key: str = "node") -> DataFrame:
    """points (x, y, ...) plus the key of the nearest target (key, tx, ty) within a distance, ties to the smaller key."""
    p = numbered(points)
    a = spread_buckets(p, F.col("x") - distance, F.col("x") + distance, F.col("y") - distance, F.col("y") + distance, distance)
    b = targets.withColumns({"__bx": F.floor(F.col("tx") / distance).cast("long"), "__by": F.floor(F.col("ty") / distance).cast("long")})
    d2 = F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)
    hit = a.join(b, ["__bx", "__by"]).where(d2 <= distance * distance).groupBy("__id").agg(F.min(F.struct(d2.alias("d2"), key)).alias("b"))
    return p.join(hit, "__id", "left").select(*points.columns, F.col(f"b.{key}").alias(key), F.sqrt("b.d2").alias("distance"))


def nearest_of(points: np.ndarray, targets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, squared distance) of the nearest target to each point, ties to the smaller key.

    Points are halved until few are left; at each halving only targets that can be the nearest to a point in their box
    stay."""
    key, square = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    todo = [(np.arange(len(points)), np.arange(len(targets)))]
    while todo:
        own, near = todo.pop()
        p, t = points[own], targets[near]
        low, high = p.min(axis=0), p.max(axis=0)
        least = (np.maximum(np.maximum(low - t, t - high), 0) ** 2).sum(axis=1)
        most = (np.maximum(np.abs(t - low), np.abs(t - high)) ** 2).sum(axis=1).min()
        near = near[least <= most * (1 + 1e-9)]
        if len(own) > 32 and len(own) * len(near) > 4096 and (high > low).any():
            axis = int(np.argmax(high - low))
            half = len(own) // 2
            parts = np.argpartition(p[:, axis], half)
            todo += [(own[parts[:half]], near), (own[parts[half:]], near)]
            continue
        near = near[np.argsort(keys[near], kind="stable")]
        t = targets[near]
        block = max(1, (1 << 20) // len(near))
        for i in range(0, len(own), block):
            some = own[i : i + block]
            d2 = (points[some, 0][:, None] - t[:, 0]) ** 2 + (points[some, 1][:, None] - t[:, 1]) ** 2
            first = d2.argmin(axis=1)
            key[some], square[some] = keys[near][first], d2[np.arange(len(some)), first]
    return key, square


def nearest_any(points: DataFrame, targets: DataFrame, first: float, key: str = "node", most: int = 48 << 20) -> DataFrame:
    """points plus the key of the nearest target and its distance, ties to the smaller key; null without any target.

    Targets at one place count once, as the smallest key. If their bytes (at most `most`) let each task hold them, each
    batch of points meets those that can be nearest; else nearest_within runs with a radius that doubles for the points
    still without a target, until all have one."""
    spots = written(targets.where("tx is not null and ty is not null and not isnan(tx) and not isnan(ty)").groupBy("tx", "ty").agg(F.min(key).cast("long").alias(key)), "spots")
    n = spots.count()
    none = {key: F.lit(None).cast("long"), "distance": F.lit(None).cast("double")}
    placed = "x is not null and y is not null and not isnan(x) and not isnan(y)"
    if not n:
        return points.withColumns(none)
    lost = points.where(f"not ({placed})").withColumns(none)
    if 24 * n <= most:
        held = spots.toPandas()
        near = spots.sparkSession.sparkContext.broadcast((held[["tx", "ty"]].to_numpy(float), held[key].to_numpy(np.int64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, keys = near.value
            for b in batches:
                if len(b):
                    k, d2 = nearest_of(b[["x", "y"]].to_numpy(float), at, keys)
                    yield b.assign(**{key: k, "distance": np.sqrt(d2)})

        kind = T.StructType([*points.schema.fields, T.StructField(key, T.LongType()), T.StructField("distance", T.DoubleType())])
        return points.where(placed).mapInPandas(run, kind).unionByName(lost)
    done, left, radius = lost, points.where(placed), first
    while True:
        got = written(nearest_within(left, spots, radius, key), "nearest")
        done = done.unionByName(got.where(F.col("distance").isNotNull()))
        left = got.where(F.col("distance").isNull()).select(*points.columns)
        if not left.limit(1).count():
            return done
        radius *= 2


def end_degrees(lines: DataFrame, tolerance: float = 1.0, vertices: str = "vertices") -> DataFrame:
    """lines plus start_degree and end_degree: how many line ends meet at their ends, rounded half to even to the tolerance."""
    v = F.col(vertices)
    key = lambda p: F.struct(F.rint(p["x"] / tolerance).alias("x"), F.rint(p["y"] / tolerance).alias("y"))
    t = lines.withColumns({"__a": key(F.element_at(v, 1)), "__b": key(F.element_at(v, -1))})
    n = t.select(F.explode(F.array("__a", "__b")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    out = t.join(n.select(F.col("k").alias("__a"), F.col("n").alias("start_degree")), "__a").join(n.select(F.col("k").alias("__b"), F.col("n").alias("end_degree")), "__b")
    return out.select(*lines.columns, "start_degree", "end_degree")


def fire_flags(tracks: DataFrame, turning: DataFrame | None, width_min: float, turning_m: float, vertices: str = "vertices") -> DataFrame:
    """tracks (id, class, width, vertices) plus fire: a track joined at both ends and wide enough, or a dead end with a
    turning place (x, y) in reach of a loose end."""
    t = end_degrees(tracks, vertices=vertices)
    through = (F.col("start_degree") >= 2) & (F.col("end_degree") >= 2)
    wide = F.coalesce(F.col("width") >= width_min, F.lit(False))
    v = F.col(vertices)
    loose = F.filter(F.array(F.when(F.col("start_degree") == 1, F.element_at(v, 1)), F.when(F.col("end_degree") == 1, F.element_at(v, -1))), lambda p: p.isNotNull())
    if turning is None:
        return t.withColumn("fire", F.coalesce((F.col("class") == "track") & through & wide, F.lit(False))).select(*tracks.columns, "fire")
    ends = t.select("id", F.explode(loose).alias("p")).select("id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    spots = turning.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.lit(1).cast("long").alias("spot"))
    near = nearest_within(ends, spots, turning_m, "spot").where("spot is not null").select("id", F.lit(True).alias("__t")).distinct()
    j = t.join(near, "id", "left")
    fire = (F.col("class") == "track") & (through & wide | F.coalesce("__t", F.lit(False)))
    return j.withColumn("fire", F.coalesce(fire, F.lit(False))).select(*tracks.columns, "fire")


def length_outside(lines: DataFrame, others: DataFrame, corridor: float, step: float, group: str = "class", vertices: str = "vertices") -> DataFrame:
    """(group, length_m, outside_m): length of lines further than the corridor from all other lines.

    Lines are cut into pieces of at most `step` metres; a piece counts by its middle."""
    s = segments(lines, vertices).where("length_m > 0")
    n = F.ceil(F.col("length_m") / step).cast("int")
    p = s.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    t = (F.col("__i") + 0.5) / F.col("__n")
    p = p.select(group, (F.col("length_m") / F.col("__n")).alias("piece"), (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))
    near = within(p, segments(others, vertices), corridor).groupBy(group).agg(F.sum("piece").alias("near_m"))
    total = p.groupBy(group).agg(F.sum("piece").alias("length_m"))
    return total.join(near, group, "left").select(group, "length_m", F.greatest(F.col("length_m") - F.coalesce("near_m", F.lit(0.0)), F.lit(0.0)).alias("outside_m"))


def points_along(lines: DataFrame, spacing: float, vertices: str = "vertices") -> DataFrame:
    """lines with a row per point: at equal distances of at most `spacing`, in the middle of each share; one at least."""
    t = lines.withColumn("line_m", line_length(F.col(vertices)))
    n = F.greatest(F.ceil(F.col("line_m") / spacing).cast("int"), F.lit(1))
    t = t.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return t.withColumn("at_m", F.col("line_m") * (F.col("__i") + 0.5) / F.col("__n")).drop("__n", "__i")


def places_along(lines: DataFrame, spacing: float, around: float, vertices: str = "vertices") -> DataFrame:
    """lines without their vertices, a row per point of points_along: at_m with x_m, y_m there, and a_m, b_m, a_x, a_y,
    b_x, b_y a distance before and after, clamped to the line. Lines of one point are left out.

    A line's lengths are summed up once and its places looked up in them; its vertices are in no row."""
    names = [c for c in lines.columns if c != vertices]
    made = ["at_m", "x_m", "y_m", "a_m", "a_x", "a_y", "b_m", "b_x", "b_y"]
    kind = T.StructType([*[lines.schema[c] for c in names], *[T.StructField(c, T.DoubleType()) for c in made]])
    block = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(b.schema.get_field_index(vertices))
            xs, ys = (pc.struct_field(v.values, k).to_numpy(zero_copy_only=False).astype(float) for k in ("x", "y"))
            offsets, valid = v.offsets.to_numpy(), v.is_valid().to_numpy(zero_copy_only=False)
            plain = b.select(names)
            for i in np.flatnonzero(valid & (np.diff(offsets) >= 2)).tolist():
                x, y = xs[offsets[i] : offsets[i + 1]], ys[offsets[i] : offsets[i + 1]]
                dx, dy = np.diff(x), np.diff(y)
                step = np.sqrt(dx * dx + dy * dy)
                ends = np.cumsum(step)
                starts, line = np.concatenate([[0.0], ends[:-1]]), float(ends[-1])
                if not math.isfinite(line):
                    continue
                n = max(math.ceil(line / spacing), 1)
                for first in range(0, n, block):
                    at = line * (np.arange(first, min(n, first + block)) + 0.5) / n
                    cols = []
                    for d in (at, np.maximum(at - around, 0.0), np.minimum(at + around, line)):
                        here = np.minimum(np.maximum(d, 0.0), line)
                        k = np.searchsorted(starts, here, side="right") - 1
                        t = np.where(step[k] > 0, np.minimum((here - starts[k]) / np.where(step[k] > 0, step[k], 1.0), 1.0), 0.0)
                        cols += [d, x[k] + t * dx[k], y[k] + t * dy[k]]
                    own = plain.take(pa.array(np.full(len(at), i)))
                    yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c) for c in cols]], names=[*names, *made])

    return lines.mapInArrow(run, kind)


def lines_within(lines: DataFrame, others: DataFrame, distance: float, vertices: str = "vertices") -> DataFrame:
    """lines that come within a distance of any of the others, or cross one.

    Lines that pass a square another one passes are near without a comparison, as in `within`; only the rest are
    compared."""
    own, sure = numbered(lines), SURE * distance
    a = segments(own, vertices).select("__id", "x0", "y0", "x1", "y1")
    passed = few(written(stepping(segments(others, vertices), sure).distinct(), "passed"))
    known = written(stepping(a, sure, "__id").join(passed, ["__cx", "__cy"], "left_semi").select("__id").distinct(), "known")
    a = a.join(few(known), "__id", "left_anti")
    b = segments(others, vertices).select(*[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")])
    low, high = lambda u, v, d: F.least(F.col(u), F.col(v)) - d, lambda u, v, d: F.greatest(F.col(u), F.col(v)) + d

    def buckets(df: DataFrame, names: tuple[str, ...], d: float) -> DataFrame:
        x0, y0, x1, y1 = names
        t = spread_buckets(df, low(x0, x1, d), high(x0, x1, d), low(y0, y1, d), high(y0, y1, d), distance)
        return t.where(crosses_box(*[F.col(k) for k in names], F.col("__bx") * distance - d, F.col("__by") * distance - d, distance + 2 * d))

    # a hair's breadth for each line's own squares, against rounding on their borders
    q = buckets(b, ("ox0", "oy0", "ox1", "oy1"), 1.01 * distance)
    places = few(written(q.select("__bx", "__by").distinct(), "places"))
    p = buckets(a, ("x0", "y0", "x1", "y1"), 0.01 * distance).join(places, ["__bx", "__by"], "left_semi")
    c = {k: F.col(k) for k in ("x0", "y0", "x1", "y1", "ox0", "oy0", "ox1", "oy1")}

    def turns(ax, ay, bx, by, px, py):
        return (c[bx] - c[ax]) * (c[py] - c[ay]) - (c[by] - c[ay]) * (c[px] - c[ax])

    crosses = (turns("x0", "y0", "x1", "y1", "ox0", "oy0") * turns("x0", "y0", "x1", "y1", "ox1", "oy1") < 0) & (turns("ox0", "oy0", "ox1", "oy1", "x0", "y0") * turns("ox0", "oy0", "ox1", "oy1", "x1", "y1") < 0)
    mine, other = [c[k] for k in ("x0", "y0", "x1", "y1")], [c[k] for k in ("ox0", "oy0", "ox1", "oy1")]
    gap = F.least(point_segment(c["x0"], c["y0"], *other), point_segment(c["x1"], c["y1"], *other), point_segment(c["ox0"], c["oy0"], *mine), point_segment(c["ox1"], c["oy1"], *mine))
    apart = lambda u0, u1, v0, v1: (F.greatest(u0, u1) + 1.01 * distance < F.least(v0, v1)) | (F.greatest(v0, v1) + 1.01 * distance < F.least(u0, u1))
    met = ~apart("x0", "x1", "ox0", "ox1") & ~apart("y0", "y1", "oy0", "oy1")
    hit = p.join(q, ["__bx", "__by"]).where(F.when(met, crosses | (gap <= distance)).otherwise(False)).select("__id").union(known).distinct()
    return own.join(hit, "__id", "left_semi").drop("__id")


def flag_fire(tracks: DataFrame, fire_lines: DataFrame | None, turning: DataFrame | None, match_m: float = 10, width_min: float = 10, turning_m: float = 20) -> DataFrame:
    """tracks (id, class, width, vertices) plus fire: by mapped fire roads near them, or, where none are given, by shape."""
    if fire_lines is None or not fire_lines.limit(1).count():
        return fire_flags(tracks, turning, width_min, turning_m)
    near = lines_within(tracks, fire_lines, match_m).select("id", F.lit(True).alias("__f"))
    return tracks.join(near, "id", "left").withColumn("fire", F.coalesce("__f", F.lit(False))).select(*tracks.columns, "fire")


def near_border(lines: DataFrame, x0: float, y0: float, x1: float, y1: float, margin: float, vertices: str = "vertices") -> DataFrame:
    """lines plus near_border: whether a point of theirs lies within the margin of a box's border, or outside it."""
    near = F.exists(vertices, lambda p: (p["x"] <= x0 + margin) | (p["x"] >= x1 - margin) | (p["y"] <= y0 + margin) | (p["y"] >= y1 - margin))
    return lines.withColumn("near_border", near)
