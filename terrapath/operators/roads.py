"""Road networks, landings and cross-sections as plans around the alignment kernel."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import Alignment
from ..sources.scratch import written
from . import alignment, algebra, vector
from .neighbours import sample
from .rays import straight_rays, template

WINDOW = "r long, c long, z double, blocked boolean, slope double, price double, road boolean"
PIECES = "parcel long, built long, length_m double, cost double, cells array<long>"


def window(cells: DataFrame, price=None) -> DataFrame:
    """What the kernel needs of one window of cells. A window's size bounds the memory of a route's task."""
    return cells.select("r", "c", F.coalesce("z", F.lit(float("nan"))).alias("z"), (algebra.truth("obstacle") | F.col("z").isNull()).alias("blocked"), F.coalesce("slope_pct", F.lit(0.0)).alias("slope"), (price if price is not None else F.lit(1.0)).alias("price"), algebra.delivers().alias("road"))


def ground_of(pdf: pd.DataFrame, res: float) -> tuple[alignment.Ground, tuple[int, int], list[tuple[int, int]]]:
    r0, c0 = int(pdf["r"].min()), int(pdf["c"].min())
    shape = int(pdf["r"].max()) - r0 + 1, int(pdf["c"].max()) - c0 + 1
    at = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0

    def layer(name: str, fill, kind):
        out = np.full(shape, fill, kind)
        out[at] = pdf[name].to_numpy()
        return out

    g = alignment.Ground(layer("z", np.nan, float), layer("blocked", True, bool), layer("slope", 0.0, float), layer("price", 1.0, float), res)
    road = pdf["road"].to_numpy(bool)
    return g, (r0, c0), list(zip(at[0][road].tolist(), at[1][road].tolist(), strict=True))


def solve_windows(cells: DataFrame, parcels: DataFrame, work: DataFrame, task, out: str) -> DataFrame:
    """One task per row of `work` (key, ...): task(window, parcels, work row)."""
    w = window(cells).withColumn("kind", F.lit(0)).select("kind", "r", "c", "z", "blocked", "slope", "price", "road", F.lit(None).cast("long").alias("parcel"), F.lit(None).cast("double").alias("volume"))
    p = parcels.select(F.lit(1).alias("kind"), "r", "c", F.lit(None).cast("double").alias("z"), F.lit(False).alias("blocked"), F.lit(0.0).alias("slope"), F.lit(1.0).alias("price"), F.lit(False).alias("road"), "parcel", "volume")
    both = w.unionByName(p).crossJoin(F.broadcast(work))  # a copy of the window per task; work has few rows

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return task(pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1].sort_values("parcel"), key[0])

    return both.groupBy("key").applyInPandas(run, out)


def rows_of(n: alignment.Network, ids: list[int], columns: int, origin: tuple[int, int]) -> list[tuple]:
    return [(ids[i], k, r.length, r.cost, [(a + origin[0]) * columns + b + origin[1] for a, b in alignment.dense(r)]) for k, (i, r) in enumerate(n.routes, 1)]


def local(parcels: pd.DataFrame, origin: tuple[int, int]) -> tuple[list[int], list[tuple[int, int]], list[float]]:
    return parcels["parcel"].astype(int).tolist(), [(int(r) - origin[0], int(c) - origin[1]) for r, c in zip(parcels["r"], parcels["c"], strict=True)], parcels["volume"].tolist()


def network(cells: DataFrame, parcels: DataFrame, p: Alignment, res: float = 5.0, how: str = "nearest", skidding_m: float = 0.0, seed: int = 1, columns: int = 50) -> DataFrame:
    """(parcel, built, length_m, cost, cells): roads in the order built, each parcel joined to the network so far."""
    work = cells.sparkSession.createDataFrame([(0,)], "key long")

    def task(win, parc, _):
        g, origin, roads = ground_of(win, res)
        ids, at, volume = local(parc, origin)
        n = alignment.greedy(g, at, roads, p, alignment.order_by(g, at, roads, how, volume, seed), skidding_m)
        return pd.DataFrame(rows_of(n, ids, columns, origin), columns=["parcel", "built", "length_m", "cost", "cells"])

    return solve_windows(cells, parcels, work, task, PIECES)


def multistart(cells: DataFrame, parcels: DataFrame, p: Alignment, res: float = 5.0, starts: int = 16, seed: int = 1, skidding_m: float = 0.0, columns: int = 50) -> DataFrame:
    """The best of several orders, a task each: fewest parcels unserved, then cheapest, then first."""
    work = cells.sparkSession.createDataFrame([(i,) for i in range(starts)], "key long")

    def task(win, parc, trial):
        g, origin, roads = ground_of(win, res)
        ids, at, volume = local(parc, origin)
        base = alignment.order_by(g, at, roads, "nearest", volume)
        n = alignment.greedy(g, at, roads, p, alignment.start_order(base, int(trial), seed), skidding_m)
        return pd.DataFrame([(int(trial), len(n.unserved), n.cost, rows_of(n, ids, columns, origin))], columns=["trial", "unserved", "total", "pieces"])

    made = solve_windows(cells, parcels, work, task, f"trial long, unserved long, total double, pieces array<struct<{PIECES.replace(' ', ':').replace(',:', ',')}>>")
    best = made.groupBy().agg(F.min(F.struct("unserved", "total", "trial", "pieces")).alias("b"))
    return best.select(F.explode("b.pieces").alias("x")).select("x.*")


def improve(cells: DataFrame, parcels: DataFrame, p: Alignment, how: str, res: float = 5.0, steps: int = 200, passes: int = 6, heat: float = 0.0, cooling: float = 0.95, seed: int = 1, skidding_m: float = 0.0, columns: int = 50) -> DataFrame:
    """anneal or rip_up: one after another by nature, so a single task."""
    work = cells.sparkSession.createDataFrame([(0,)], "key long")

    def task(win, parc, _):
        g, origin, roads = ground_of(win, res)
        ids, at, volume = local(parc, origin)
        base = alignment.order_by(g, at, roads, "nearest", volume)
        build = alignment.Builder(g, at, roads, p, skidding_m)
        n, _journal = alignment.anneal(build, base, steps, heat, cooling, seed) if how == "anneal" else alignment.rip_up(build, base, passes)
        return pd.DataFrame(rows_of(n, ids, columns, origin), columns=["parcel", "built", "length_m", "cost", "cells"])

    return solve_windows(cells, parcels, work, task, PIECES)


def steiner(cells: DataFrame, parcels: DataFrame, p: Alignment, res: float = 5.0, columns: int = 50) -> DataFrame:
    """The order of a minimum spanning tree of the terminals (the road network is one); then each terminal joined to the
    growing network in that order. Terminals out of reach stay out. One pair after another by nature, so a single task."""
    work = cells.sparkSession.createDataFrame([(0,)], "key long")

    def task(win, parc, _):
        g, origin, roads = ground_of(win, res)
        ids, at, _ = local(parc, origin)
        b = alignment.Builder(g, at, roads, p)
        net = b.build(alignment.spanning_order(g, at, roads, p, b))
        return pd.DataFrame(rows_of(net, ids, columns, origin), columns=["parcel", "built", "length_m", "cost", "cells"])

    return solve_windows(cells, parcels, work, task, PIECES)


def line_footprint(cells: DataFrame, lines: DataFrame, res: float) -> DataFrame:
    """(depart, azimuth, cell): cells under each line (depart, azimuth, length_m), by its ray."""
    az = [r.azimuth for r in lines.select("azimuth").distinct().collect()]  # 360 at most
    reach = lines.agg(F.max("length_m")).first()[0] or 0.0
    ray = template(cells.sparkSession, straight_rays(res, reach, sorted(az))) if az else None
    if ray is None:
        return lines.select("depart", "azimuth", F.lit(0).cast("long").alias("cell")).limit(0)
    at = lines.join(cells.select(F.col("cell").alias("depart"), F.col("r").alias("r0"), F.col("c").alias("c0")), "depart")
    t = at.join(ray, at["azimuth"] == ray["az"]).where(F.col("hd") <= F.col("length_m"))
    t = t.select("depart", "azimuth", (F.col("r0") + F.col("dr")).alias("r"), (F.col("c0") + F.col("dc")).alias("c"))
    return t.join(cells.select("cell", "r", "c"), ["r", "c"]).select("depart", "azimuth", "cell")


def landings(tracks: DataFrame, cells: DataFrame, res: float, width_min: float = 4, grade_max_pct: float = 6, window: float = 50, forest_max_m: float | None = 100, spacing: float = 200, width_names: tuple[str, ...] = ("width_measured_m", "width_m", "carriageway_m"), check: bool = False) -> DataFrame:
    """Points along the tracks where wood may be stacked: trucks get there, the road is level and forest is near.

    tracks: id, class, fire, vertices and any of the width columns. A criterion that leaves nothing is an error
    if `check` is set (that counts rows after each)."""
    width = algebra.first_column(tracks, width_names)
    w = F.col(width) if width else F.lit(None).cast("double")
    t = tracks.withColumn("__w", w).where(F.col("__w").isNull() | (F.col("__w") >= width_min))
    access = F.when(F.col("__w").isNotNull(), "width").when(F.coalesce("fire", F.lit(False)), "fire").when(F.col("class").isNotNull(), F.concat(F.lit("class:"), "class")).otherwise("unknown")
    p = vector.places_along(t.select("id", access.alias("access"), "vertices"), spacing, window / 2)
    for end in ("a", "b"):
        p = sample(cells, p.withColumnsRenamed({f"{end}_x": "x", f"{end}_y": "y"}), "z", res).withColumnRenamed("z", f"z_{end}").drop("x", "y")
    d = F.col("b_m") - F.col("a_m")
    p = p.withColumn("grade_pct", F.when(d > 0, 100 * F.abs(F.col("z_b") - F.col("z_a")) / d)).where(F.col("grade_pct") <= grade_max_pct)
    out = p.select("id", "at_m", "access", "grade_pct", "x_m", "y_m")
    if forest_max_m is not None:
        trees = cells.where("forest").select(((F.col("c") + 0.5) * res).alias("tx"), ((F.col("r") + 0.5) * res).alias("ty"))
        out = vector.near_points(written(out.withColumnsRenamed({"x_m": "x", "y_m": "y"}), "places"), trees, forest_max_m)
    out = out.select("id", "at_m", "access", "grade_pct")
    if check and not out.limit(1).count():
        raise ValueError("no place is left: loosen the width, the grade or the distance to forest")
    return out


def cross_sections(points: DataFrame, half_width: float = 20, step: float = 0.25, slope_max: float = 0.20, road_tol: float = 0.15, drive_tol: float = 0.05, least: int = 5) -> DataFrame:
    """(station, road_m, drivable_m, rescue_m, crown_rmse) of ground points (station, across, height).

    From the centre outward: the road while heights stay near the plane through its middle, what is drivable while
    they stay near a parabola, the rescue width while the ground is gentle. Too few points give nulls."""

    def section(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.dropna(subset=["across", "height"]).sort_values("across")
        p = p[p["across"].abs() <= half_width]
        station = pdf["station"].iloc[0]
        none = pd.DataFrame([(station, None, None, None, None)], columns=["station", "road_m", "drivable_m", "rescue_m", "crown_rmse"])
        if len(p) < least:
            return none
        x, z = p["across"].to_numpy(), p["height"].to_numpy()
        grid = np.arange(-half_width, half_width + step / 2, step)
        ground = np.interp(grid, x, z)
        mid = np.abs(x) <= 1.5
        if mid.sum() < 2:
            return none
        plane = np.polyval(np.polyfit(x[mid], z[mid], 1), grid)
        curve_fit = np.polyfit(x[mid], z[mid], 2 if mid.sum() >= 3 else 1)
        curve = np.polyval(curve_fit, grid)
        road = outward(np.abs(ground - plane) <= road_tol)
        drive = outward(np.abs(ground - curve) <= drive_tol)
        rescue = outward(np.abs(np.gradient(ground, step)) <= slope_max)
        rmse = float(np.sqrt(np.mean((np.polyval(curve_fit, x[mid]) - z[mid]) ** 2)))
        # drivable lies within the road, the road within the rescue width
        rescue = max(rescue, road)
        return pd.DataFrame([(station, road * step, min(drive, road) * step, rescue * step, round(rmse, 9))], columns=["station", "road_m", "drivable_m", "rescue_m", "crown_rmse"])

    return points.groupBy("station").applyInPandas(section, "station long, road_m double, drivable_m double, rescue_m double, crown_rmse double")


def outward(ok: np.ndarray) -> int:
    """Steps around the middle that pass without a gap."""
    c = len(ok) // 2
    if not ok[c]:
        return 0
    a = next((k for k in range(c, -1, -1) if not ok[k]), -1)
    b = next((k for k in range(c, len(ok)) if not ok[k]), len(ok))
    return b - a - 2 if b - a > 1 else 0


