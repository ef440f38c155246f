"""Ray sweeps: what a winch, a forwarder, a fire hose or a cable reaches in straight lines.

A ray is an ordered list of cell offsets; it ends at the first cell that fails a test, and each target keeps its
best ray. Sources are dealt to square tiles and cells to every tile within reach of theirs, so cells are shuffled
once. A task holds one tile's window as arrays and takes each azimuth step by step for all sources whose ray is
still alive; it gives its best ray per cell, and one aggregate picks the best of all tiles. Rays are cut where no
cell is."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.config import Config
from ..functions.scalars import percent_to_degrees, winch_law

RAYS = "az int, step int, dr int, dc int, hd double"


def straight_rays(res: float, reach: float, azimuths: list[int] | None = None) -> list[tuple[int, int, int, int, float]]:
    """Cells met every third of a cell along each azimuth, rounded half to even, each once in a row."""
    limit, out = reach + 1.5 * res, []
    t = np.arange(1, int(limit / (res / 3)) + 2) * (res / 3)
    t = t[t <= limit + 1e-9]
    for az in azimuths if azimuths is not None else range(360):
        rad = math.radians(az)
        dc, dr = np.rint(t * math.sin(rad) / res).astype(int), np.rint(-t * math.cos(rad) / res).astype(int)
        before, step = (0, 0), 0
        for a, b in zip(dr.tolist(), dc.tolist(), strict=True):
            hd = res * math.sqrt(a * a + b * b)
            if (a, b) != before and (a, b) != (0, 0):
                before = (a, b)
                if hd <= limit:
                    step += 1
                    out.append((az, step, a, b, hd))
    return out


def connected_rays(res: float, reach: float, azimuths: list[int] | None = None) -> list[tuple[int, int, int, int, float]]:
    """Every cell that each azimuth's line crosses, border by border; on a corner the row moves first."""
    limit, out = reach + 1.5 * res, []
    for az in azimuths if azimuths is not None else range(360):
        x, y = math.sin(math.radians(az)), -math.cos(math.radians(az))
        per_c, per_r = (1 / abs(v) if v else math.inf for v in (x, y))
        next_c, next_r = 0.5 * per_c, 0.5 * per_r
        r = c = step = 0
        while True:
            if next_c < next_r:
                c, next_c = c + (1 if x > 0 else -1), next_c + per_c
            else:
                r, next_r = r + (1 if y > 0 else -1), next_r + per_r
            hd = res * math.sqrt(r * r + c * c)
            if hd > limit:
                break
            step += 1
            out.append((az, step, r, c, hd))
    return out


def template(spark: SparkSession, rays: list[tuple[int, int, int, int, float]]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rays, RAYS))


def along_rays(cells: DataFrame, sources: DataFrame, rays: DataFrame, layers: list[str]) -> DataFrame:
    """(src, r0, c0, z0, start, az, step, hd, cell, layers...) for each source, ray and cell met.

    sources: (src, r0, c0, z0, start). Rays are cut at the grid's edge, as no cell answers beyond it."""
    spread = sources.join(rays).select("src", "z0", "start", "az", "step", "hd", (F.col("r0") + F.col("dr")).alias("r"), (F.col("c0") + F.col("dc")).alias("c"))
    return spread.join(cells.select("r", "c", "cell", *layers), ["r", "c"]).drop("r", "c")


def ray() -> WindowSpec:
    return Window.partitionBy("src", "az").orderBy("step")


def so_far() -> WindowSpec:
    return ray().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return ray().rowsBetween(Window.unboundedPreceding, -1)


def alive(ok: Column) -> Column:
    """Whether this and all cells before it on the ray pass."""
    return F.min(F.coalesce(ok, F.lit(False)).cast("int")).over(so_far()) == 1


#: The least side of a tile of sources, in cells.
SPAN = 64
SWEPT = "cell long, total double, az int, step int, src long, extra double"


class Sweep:
    """What a tile's rays do at each step. `begin` gives the state of a ray at its source, `go` whether it lives on at
    a cell, the total to compare by, one more number to carry, and its new state; all are arrays over sources."""

    def __init__(self, layers: list[str], begin: Callable, go: Callable, ties_to_smallest: bool = False, own: bool = False):
        """On ties the smallest source stays, or else the first ray; with `own`, a source that reaches any cell reaches
        itself at 0."""
        self.layers, self.begin, self.go, self.ties_to_smallest, self.own = layers, begin, go, ties_to_smallest, own


def sweep_window(sweep: Sweep, rays: list, window: dict[str, np.ndarray], src: dict[str, np.ndarray], size: int) -> pd.DataFrame:
    """The best ray to each place of a window (flat arrays of `size` places). rays: (az, offsets, distances, steps)."""
    total, az_of, step_of = np.full(size, math.inf), np.zeros(size, np.int32), np.zeros(size, np.int32)
    from_, extra = np.zeros(size, np.int64), np.zeros(size)
    for az, offsets, hds, steps in rays:
        alive, state, before = np.arange(len(src["at"])), sweep.begin(src), 0.0
        for offset, hd, step in zip(offsets, hds, steps, strict=True):
            at = src["at"][alive] + offset
            cell = {k: v[at] for k, v in window.items()}
            ok, cost, more, state = sweep.go(az, hd, before, cell, {k: v[alive] for k, v in src.items()}, state)
            ok &= cell["there"]
            before = hd
            if not ok.all():
                alive, at, cost, more, state = alive[ok], at[ok], cost[ok], more[ok], [x[ok] for x in state]
            if not len(alive):
                break
            if sweep.own and step == 1:
                own = src["at"][alive]
                total[own], az_of[own], step_of[own], from_[own], extra[own] = 0, 0, 0, src["src"][alive], 0
            # azimuths and steps come in order, and one step has no target twice: on ties the first stays
            better = cost < total[at]
            if sweep.ties_to_smallest:
                better |= (cost == total[at]) & (src["src"][alive] < from_[at])
            at, own = at[better], alive[better]
            total[at], az_of[at], step_of[at], from_[at], extra[at] = cost[better], az, step, src["src"][own], more[better]
    hit = np.flatnonzero(total < math.inf)
    return pd.DataFrame({"cell": window["cell"][hit], "total": total[hit], "az": az_of[hit], "step": step_of[hit], "src": from_[hit], "extra": extra[hit]})


def swept(cells: DataFrame, sources: DataFrame, found: list[tuple[int, int, int, int, float]], sweep: Sweep, span: int = SPAN) -> DataFrame:
    """SWEPT: the best ray of each tile to each cell."""
    pad = max((max(abs(a), abs(b)) for _, _, a, b, _ in found), default=0)
    span = max(span, 2 * pad)
    wide = span + 2 * pad
    rays = []
    for az, some in groupby(sorted(found), key=lambda x: x[0]):
        some = list(some)
        rays.append((az, [a * wide + b for _, _, a, b, _ in some], [x[4] for x in some], [x[1] for x in some]))
    layers = sweep.layers
    tile = lambda x: F.floor(x / span).cast("int")
    near = lambda x: F.explode(F.sequence(tile(F.col(x) - pad), tile(F.col(x) + pad)))
    dealt = cells.select("cell", "r", "c", *[F.col(x).cast("double").alias(x) for x in layers]).withColumn("tr", near("r")).withColumn("tc", near("c"))
    asked = sources.select(F.col("src").cast("long").alias("src"), "r0", "c0", F.col("z0").cast("double").alias("z0"), F.col("start").cast("double").alias("start"), tile(F.col("r0")).alias("tr"), tile(F.col("c0")).alias("tc"))
    dealt = dealt.join(asked.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")

    def run(key: tuple, here: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        place = lambda r, c: (r.to_numpy(np.int64) - key[0] * span + pad) * wide + c.to_numpy(np.int64) - key[1] * span + pad
        at, size = place(here["r"], here["c"]), wide * wide
        window = {"cell": np.zeros(size, np.int64), "there": np.zeros(size, bool)}
        window["cell"][at], window["there"][at] = here["cell"], True
        for x in layers:
            window[x] = np.full(size, np.nan)
            window[x][at] = here[x]
        src = {x: ask[x].to_numpy() for x in ("src", "z0", "start")} | {"at": place(ask["r0"], ask["c0"])}
        with np.errstate(invalid="ignore", divide="ignore"):
            return sweep_window(sweep, rays, window, src, size)

    return asked.groupBy("tr", "tc").cogroup(dealt.groupBy("tr", "tc")).applyInPandas(lambda key, a, b: run(key, b, a), SWEPT)


def nearest(found: DataFrame) -> DataFrame:
    """Per target the smallest total; ties to the first azimuth, then step, then the largest source."""
    key = F.struct("total", "az", "step", (-F.col("src")).alias("back"))
    best = found.groupBy("cell").agg(F.min(F.struct(key.alias("k"), "src", "extra")).alias("b"))
    return best.select("cell", F.col("b.extra").alias("distance"), F.col("b.src").alias("alloc"), F.col("b.k.total").alias("total"))


def with_sources(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources reach themselves at distance 0."""
    own = sources.select(F.col("src").alias("cell"), F.lit(0.0).alias("distance"), F.col("src").alias("alloc"), F.col("start").alias("total"))
    return found.join(own.select("cell"), "cell", "left_anti").unionByName(own)


def winch(cells: DataFrame, sources: DataFrame, config: Config, res: float = 5.0, azimuths: list[int] | None = None) -> DataFrame:
    """(cell, distance, alloc, total) winched from sources. cells: cell, r, c, z, winchable.

    The chord, hung at the anchor's height, must clear the ground and stay below the clearance over every cell
    before the target; the 3D distance must be within the winch law's reach for the ray's slope."""
    law, s = winch_law(config), config.skidder

    def begin(src: dict) -> list[np.ndarray]:
        n = len(src["src"])
        return [np.full(n, -math.inf), np.full(n, math.inf)]

    def go(az: int, hd: float, before: float, cell: dict, src: dict, state: list) -> tuple:
        low, high = state
        dz = cell["z"] - src["z0"]
        slope, d3 = dz / hd, np.sqrt(hd * hd + dz * dz)
        between = law.base / (1 - law.coeff * slope / np.sqrt(1 + slope**2))
        most = np.where(slope <= law.down, law.downhill_m, np.where(slope > law.up, law.uphill_m, between))
        ok = (cell["winchable"] == 1) & (slope >= low) & (slope <= high) & ((d3 <= law.always_m) | (d3 <= most))
        return ok, src["start"] + d3, d3, [np.fmax(low, (dz - s.winch_anchor_m) / hd), np.fmin(high, (dz - s.winch_anchor_m + s.clearance_max_m) / hd)]

    found = straight_rays(res, max(law.uphill_m, law.downhill_m), azimuths)
    return with_sources(nearest(swept(cells, sources, found, Sweep(["z", "winchable"], begin, go))), sources)


def forward(cells: DataFrame, sources: DataFrame, config: Config, res: float = 5.0, azimuths: list[int] | None = None) -> DataFrame:
    """(cell, distance, alloc, total) driven straight from sources. cells: cell, r, c, z, slope_pct, aspect_deg, drivable.

    Along the ray the loaded machine goes down from cells above the road and up from cells below; across it the
    slope limit depends on the angle to the fall line; distance on ground steeper than the cross limit adds up."""
    f = config.forwarder
    up, down, across = (math.degrees(math.atan(p / 100)) for p in (f.up_slope_max_pct, f.down_slope_max_pct, f.cross_slope_max_pct))
    half = math.pi / 180

    def begin(src: dict) -> list[np.ndarray]:
        return [np.zeros(len(src["src"])), np.zeros(len(src["src"]))]

    def go(az: int, hd: float, before: float, cell: dict, src: dict, state: list) -> tuple:
        last, steep = state
        dz = cell["z"] - src["z0"]
        d3, deg, aspect = np.sqrt(hd * hd + dz * dz), cell["deg"], cell["aspect_deg"]
        cos = np.cos((90 - (az - aspect) % 180.0) * half)
        side = np.isnan(aspect) | (cos == 0) | (deg <= np.abs(across / cos))
        steep = steep + np.where(deg > across, d3 - last, 0.0)
        ok = (cell["drivable"] == 1) & (deg <= np.where(cell["z"] > src["z0"], down, up)) & side & (steep <= f.steep_max_m)
        return ok, src["start"] + d3, d3, [d3, steep]

    found = straight_rays(res, f.steep_max_m, azimuths)
    ready = cells.withColumn("deg", percent_to_degrees(F.col("slope_pct")))
    return with_sources(nearest(swept(ready, sources, found, Sweep(["z", "deg", "aspect_deg", "drivable"], begin, go))), sources)


def hose(cells: DataFrame, sources: DataFrame, reach: float, res: float = 5.0, azimuths: list[int] | None = None) -> DataFrame:
    """(cell, distance, alloc, rise) of laying hose along the ground. cells: cell, r, c, z, forest, usable.

    Lengths are whole centimetres, so ties are true ties: the smallest source, then azimuth, wins. Distances are
    whole metres and only forest cells have them; a source that reaches any cell reaches itself at 0."""

    def begin(src: dict) -> list[np.ndarray]:
        return [src["z0"], np.zeros(len(src["src"]))]

    def go(az: int, hd: float, before: float, cell: dict, src: dict, state: list) -> tuple:
        z, laid = state
        laid = laid + np.sqrt((cell["z"] - z) ** 2 + (hd - before) ** 2)
        rise = cell["z"] - src["z0"]
        rise = np.where(rise < 0, np.ceil(rise - 0.5), np.floor(rise + 0.5))
        return (cell["usable"] == 1) & (laid <= reach), np.floor(laid * 100 + 0.5), rise, [cell["z"], laid]

    found = swept(cells, sources.where("z0 is not null"), connected_rays(res, reach, azimuths), Sweep(["z", "usable"], begin, go, ties_to_smallest=True, own=True))
    best = found.groupBy("cell").agg(F.min(F.struct(F.col("total").alias("cm"), "src", "az", "step", F.col("extra").alias("rise"))).alias("b"))
    wooded = cells.where(F.coalesce("forest", F.lit(False))).select("cell")
    return best.join(wooded, "cell", "left_semi").select("cell", F.floor(F.col("b.cm") / 100 + 0.5).cast("double").alias("distance"), F.col("b.src").alias("alloc"), F.col("b.rise").alias("rise"))


def check_lines(profile: DataFrame, config: Config) -> DataFrame:
    """(src, az, cells, length_m) of straight profiles that may carry a cable.

    profile: (src, az, step from 0, hd, z, forest, aspect_deg, slope_pct). A line goes on while its 3D length, its
    length across steep ground and its length without forest allow, and ends at its last forest cell or, if
    nearer, its last cell with a small enough share of cross-slope."""
    c = config.cable
    gap = math.inf if c.no_forest_max_m is None and c.length_max_m == math.inf else (min(0.1 * c.length_max_m, c.length_min_m) if c.no_forest_max_m is None else c.no_forest_max_m)
    t = profile
    step = F.col("hd") - F.lag("hd").over(ray())
    z_first = F.first("z").over(so_far())
    far = F.sqrt(F.col("hd") * F.col("hd") + (F.col("z") - z_first) * (F.col("z") - z_first)) > c.length_max_m
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    angle = F.abs(F.pmod(F.col("az") - whole(F.col("aspect_deg")) + 180, F.lit(360)) - 180)
    aligned = F.col("aspect_deg").isNull() | (angle > 90 + c.cross_angle_deg) | (angle < 90 - c.cross_angle_deg)
    gentle = F.coalesce(whole(F.col("slope_pct")) < c.cross_slope_max_pct, F.lit(False))
    t = t.withColumns({"__far": far, "__cross": F.when((F.col("step") > 0) & ~aligned & ~gentle, step).otherwise(0.0), "__bare": F.when(~F.col("forest") & (F.col("step") > 0), step).otherwise(0.0)})
    t = t.withColumns({"__crossed": F.sum("__cross").over(so_far()), "__trees": F.sum(F.col("forest").cast("int")).over(so_far()), "__all_bare": F.sum("__bare").over(so_far())})
    # bare length since the last forest cell: each forest cell restarts the count
    t = t.withColumn("__since", F.col("__all_bare") - F.coalesce(F.max(F.when(F.col("forest"), F.col("__all_bare"))).over(so_far()), F.lit(0.0)))
    stop_forest = F.col("__far") | (F.col("__crossed") > c.cross_length_max_m)
    t = t.withColumns({"__stop": stop_forest, "__out": ~F.col("forest") & (F.col("__since") >= gap)})
    t = t.withColumns({"__stopped": F.max(F.col("__stop").cast("int")).over(so_far()), "__ended": F.coalesce(F.max(F.col("__out").cast("int")).over(before()), F.lit(0))})
    live = t.where("__stopped = 0 and __ended = 0")
    share = (F.col("step") > 0) & (F.col("__crossed") / F.col("hd") < c.cross_share_max)
    ends = live.groupBy("src", "az").agg(F.coalesce(F.max(F.when(F.col("forest"), F.col("step"))), F.lit(0)).alias("a"), F.coalesce(F.max(F.when(share, F.col("step"))), F.lit(0)).alias("b"))
    last = ends.select("src", "az", F.least("a", "b").alias("step"))
    return profile.join(last, ["src", "az", "step"]).where(F.col("hd") > c.length_min_m).select("src", "az", (F.col("step") + 1).alias("cells"), F.col("hd").alias("length_m"))


def to_front(keep: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """values (rows of one shape) with what is kept of each row moved to its front, in order."""
    if not (keep[:, 1:] & ~keep[:, :-1]).any():
        return list(values)
    order = np.argsort(~keep, axis=1, kind="stable")
    return [np.take_along_axis(v, order, axis=1) for v in values]


def check_rows(az: np.ndarray, hd: np.ndarray, z: np.ndarray, forest: np.ndarray, aspect_deg: np.ndarray, slope_pct: np.ndarray, config: Config) -> np.ndarray:
    """check_lines for profiles as rows, a column per step (not a number: null, or no cell): the last step, -1 for no line."""
    c = config.cable
    gap = math.inf if c.no_forest_max_m is None and c.length_max_m == math.inf else (min(0.1 * c.length_max_m, c.length_min_m) if c.no_forest_max_m is None else c.no_forest_max_m)
    own, all_hd = ~np.isnan(z), hd
    step = np.broadcast_to(np.arange(hd.shape[1]), hd.shape)
    step, hd, z, forest, aspect_deg, slope_pct, own = to_front(own, step, hd, z, forest, aspect_deg, slope_pct, own)
    on = step > 0
    with np.errstate(invalid="ignore", divide="ignore"):
        move = np.diff(hd, axis=1, prepend=hd[:, :1])
        far = np.sqrt(hd * hd + (z - z[:, :1]) * (z - z[:, :1])) > c.length_max_m
        angle = np.abs((az[:, None] - np.trunc(aspect_deg) + 180) % 360 - 180)
        aligned = np.isnan(aspect_deg) | (angle > 90 + c.cross_angle_deg) | (angle < 90 - c.cross_angle_deg)
        across = on & ~aligned & ~(np.trunc(slope_pct) < c.cross_slope_max_pct) & own
        crossed = np.cumsum(np.where(across, move, 0.0), axis=1)
        trees, none = (forest == 1) & own, (forest == 0) & own
        bare = np.cumsum(np.where(none & on, move, 0.0), axis=1)
        since = bare - np.maximum(np.maximum.accumulate(np.where(trees, bare, -np.inf), axis=1), 0.0)
        stop, out = far | (crossed > c.cross_length_max_m), none & (since >= gap)
        live = own & ~np.logical_or.accumulate(stop, axis=1)
        live[:, 1:] &= ~np.logical_or.accumulate(out, axis=1)[:, :-1]
        live[:, 0] &= ~across[:, 0]  # a first cell beyond the start has no length before it
        share = on & (crossed / hd < c.cross_share_max)
    most = lambda ok: np.where(ok & live, step, 0).max(axis=1)
    last = np.minimum(most(trees), most(share))
    return np.where(np.take_along_axis(all_hd, last[:, None], axis=1)[:, 0] > c.length_min_m, last, -1)
