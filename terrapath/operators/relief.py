"""Sky view, openness and blended relief pictures."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terrain import hillshade


def half_away(x: float) -> int:
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def horizon_shifts(directions: int, radius: float, least: float = 1.0) -> list[tuple[int, int, int, float]]:
    """(direction, row shift, column shift, distance in cells): distinct cells at every third of a cell per direction."""
    out = []
    for i in range(directions):
        a = 2 * math.pi / directions * i
        n = max(0, math.floor((radius - least) * 3 + 1))
        seen = dict.fromkeys((half_away(math.cos(a) * (k / 3 + least)), half_away(math.sin(a) * (k / 3 + least))) for k in range(n))
        out += [(i, r, c, math.hypot(r, c)) for r, c in sorted(seen, key=lambda x: math.hypot(*x))]
    return out


def reflect(x: Column, n: Column) -> Column:
    """An index beyond 0..n-1 mirrored back, the edge not repeated."""
    m = F.pmod(x, F.greatest(2 * (n - 1), F.lit(1)))
    return F.when(n == 1, F.lit(0)).otherwise(F.when(m >= n, 2 * (n - 1) - m).otherwise(m)).cast("long")


def horizon(cells: DataFrame, z: str = "z", res: float = 5.0, radius_m: float = 10, least_m: float | None = None, directions: int = 16, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """cells plus svf, openness_pos and openness_neg (degrees).

    Per direction the steepest slope to any cell within the radius; openness averages the zenith angles, sky view
    1 - sin of horizons above level. Negative openness looks at the ground upside down. Cells beyond the edge are
    mirrored. One join on shifted places, then a maximum per direction and a mean per cell."""
    if rows is None or columns is None:
        n = cells.agg(F.max("r"), F.max("c")).first()
        rows, columns = n[0] + 1, n[1] + 1
    spark = cells.sparkSession
    shifts = horizon_shifts(directions, radius_m / res, (least_m / res) if least_m else 1.0)
    table = F.broadcast(spark.createDataFrame([s for s in shifts if s[1] or s[2]], "dir int, dr int, dc int, dist double"))
    own = cells.where(F.col(z).isNotNull()).select("cell", "r", "c", F.col(z).alias("z0"))
    seen = own.join(table).select("cell", "dir", "dist", "z0", reflect(F.col("r") - F.col("dr"), F.lit(rows)).alias("r"), reflect(F.col("c") - F.col("dc"), F.lit(columns)).alias("c"))
    met = seen.join(cells.select("r", "c", F.col(z).alias("z1")), ["r", "c"])
    rise = (F.col("z1") - F.col("z0")) / F.col("dist") / res
    per = met.groupBy("cell", "dir").agg(F.coalesce(F.max(rise), F.lit(-1000.0)).alias("up"), F.coalesce(F.max(-rise), F.lit(-1000.0)).alias("down"))
    up, down = F.atan("up"), F.atan("down")
    mean = per.groupBy("cell").agg(
        F.avg(1 - F.sin(F.greatest(up, F.lit(0.0)))).alias("svf"), F.avg(F.degrees(F.lit(math.pi / 2) - up)).alias("openness_pos"), F.avg(F.degrees(F.lit(math.pi / 2) - down)).alias("openness_neg")
    )
    return cells.join(mean, "cell", "left")


def normalise(x: Column, low: float, high: float, invert: bool = False) -> Column:
    v = F.when(x.isNotNull(), F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)))
    return 1 - v if invert else v


def blend(mode: str, top: Column, below: Column, opacity: float) -> Column:
    """One layer over another. Overlay and soft light take no opacity."""
    if mode == "overlay":
        return F.when(below > 0.5, 1 - (1 - 2 * (below - 0.5)) * (1 - top)).otherwise(2 * below * top)
    if mode == "soft_light":
        return F.when(top < 0.5, 2 * below * top + below * below * (1 - 2 * top)).otherwise(2 * below * (1 - top) + F.sqrt(below) * (2 * top - 1))
    mixed = {"normal": top, "luminosity": top, "multiply": top * below, "screen": 1 - (1 - top) * (1 - below)}[mode]
    return mixed * opacity + below * (1 - opacity)


# fixed values: layers from the top down as (column, low, high, inverted, mode, opacity)
ARCHAEOLOGY = (("svf", 0.7, 1.0, False, "multiply", 0.25), ("openness_pos", 68, 93, False, "overlay", 0.5), ("slope_deg", 0, 50, True, "luminosity", 0.5), ("hillshade", 0, 1, False, "normal", 1.0))


def blend_stack(layers: tuple = ARCHAEOLOGY) -> Column:
    """Layers folded from the bottom up."""
    ready = [(mode, normalise(F.col(x), low, high, inv), opacity) for x, low, high, inv, mode, opacity in layers]
    return reduce(lambda below, layer: blend(layer[0], layer[1], below, layer[2]), reversed(ready[:-1]), ready[-1][1])


def as_byte(x: Column) -> Column:
    """0..1 as 0..255, truncated; null is 255."""
    return F.coalesce(F.when(x.isNotNull(), F.least(F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255.9999), F.lit(255))), F.lit(255)).cast("smallint")


def relief_picture(cells: DataFrame, z: str = "z", res: float = 5.0, radius_m: float = 10, directions: int = 16, azimuth: float = 315, elevation: float = 35, layers: tuple = ARCHAEOLOGY, name: str = "relief") -> DataFrame:
    """cells (with slope_pct) plus the blended picture in 0..1."""
    h = horizon(hillshade(cells, z, res, azimuth, elevation), z, res, radius_m, directions=directions)
    return h.withColumn("slope_deg", F.degrees(F.atan(F.col("slope_pct") / 100))).withColumn(name, blend_stack(layers)).select(*cells.columns, name)


def combined_picture(general: Column, flat: Column, byte: bool = False) -> Column:
    """Half of the picture for general terrain, half of that for flat terrain."""
    v = general * 0.5 + flat * 0.5
    return as_byte(v) if byte else v


# fixed values: what the combined picture takes for general and for flat terrain
GENERAL = {"radius": 10, "least": 1, "directions": 16, "azimuth": 315, "elevation": 35, "svf": (0.7, 1.0), "openness": (68, 93), "slope": 50}
FLAT = {"radius": 20, "least": 8, "directions": 16, "azimuth": 315, "elevation": 15, "svf": (0.9, 1.0), "openness": (85, 93), "slope": 15}


def terrain_layers(p: dict) -> tuple:
    """ARCHAEOLOGY with a terrain's ranges."""
    ranges = {"svf": p["svf"], "openness_pos": p["openness"], "slope_deg": (0, p["slope"])}
    return tuple((x, *ranges.get(x, (low, high)), *rest) for x, low, high, *rest in ARCHAEOLOGY)


def combined_relief(cells: DataFrame, z: str = "z", res: float = 5.0, byte: bool = True, name: str = "relief") -> DataFrame:
    """cells plus the half-and-half picture of general and flat terrain; slope by central differences."""
    from .terrain import edge_gradient

    out = edge_gradient(cells, z, res).withColumn("slope_deg", F.degrees(F.atan(F.sqrt(F.pow("dzdx", 2) + F.pow("dzdy", 2))))).drop("dzdx", "dzdy")
    keep = out.columns
    for p, x in ((GENERAL, "__general"), (FLAT, "__flat")):
        lit = hillshade(out, z, res, p["azimuth"], p["elevation"])
        seen = horizon(lit, z, res, p["radius"] * res, p["least"] * res, p["directions"])
        out = seen.withColumn(x, blend_stack(terrain_layers(p))).select(*keep, *[c for c in out.columns if c.startswith("__")], x)
    return out.withColumn(name, combined_picture(F.col("__general"), F.col("__flat"), byte)).select(*cells.columns, name)
