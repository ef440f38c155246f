"""Map algebra: masks, costs and classes as projections of the cell table.

Cells carry slope_pct, slope_max (3 x 3 maximum of slope), forest, obstacle, partial, public (booleans, null is
false), road (1 main road, 2 track, 3 fire road, 4 public road; null elsewhere) and volume."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import Config, RoadCost
from ..functions.scalars import earthworks_cost, slope_weight

# fixed values: road classes by rank, the barrier highest
ROADS = {"main": 1, "track": 2, "fire": 3, "public": 4}


def truth(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def drive_cost(config: Config) -> Column:
    return slope_weight(F.col("slope_pct")) + F.when(truth("obstacle"), F.lit(float(config.skidder.obstacle_cost))).otherwise(0.0)


def drivable_ground(config: Config) -> Column:
    gentle = F.coalesce(F.col("slope_pct") <= config.skidder.drive_slope_max_pct, F.lit(False))
    return gentle & ~truth("obstacle") & ~truth("partial") & ~truth("public")


def drive_zone(config: Config) -> Column:
    return truth("forest") & drivable_ground(config)


def flat_ground(config: Config) -> Column:
    f = config.forwarder
    limit = min(f.cross_slope_max_pct, f.up_slope_max_pct, f.down_slope_max_pct)
    return F.coalesce(F.col("slope_pct") <= limit, F.lit(False)) & ~truth("obstacle") & ~truth("public")


def winch_zone(config: Config) -> Column:
    return truth("forest") & ~truth("obstacle") & F.coalesce(F.col("slope_max") <= config.skidder.felling_slope_max_pct, F.lit(False))


def fellable(config: Config) -> Column:
    return F.coalesce(F.col("slope_max") <= config.forwarder.felling_slope_max_pct, F.lit(False))


def forwarder_zone(config: Config, jump: Column) -> Column:
    f = config.forwarder
    limit = max(f.cross_slope_max_pct, f.up_slope_max_pct, f.down_slope_max_pct)
    return (truth("forest") | F.coalesce(jump, F.lit(False))) & fellable(config) & F.coalesce(F.col("slope_pct") <= limit, F.lit(False)) & ~truth("obstacle") & ~truth("public")


def upper_bound_zone(config: Config) -> Column:
    return drivable_ground(config) | F.col("road").isNotNull()


def excluded(config: Config) -> Column:
    """Felling impossible: locally too steep."""
    return F.coalesce(F.col("slope_max") > config.skidder.felling_slope_max_pct, F.lit(False))


def delivers() -> Column:
    """Road cells that wood can be delivered to: all classes but public roads."""
    return F.coalesce(F.col("road") != ROADS["public"], F.lit(False))


def road_is(*names: str) -> Column:
    return F.coalesce(F.col("road").isin([ROADS[n] for n in names]), F.lit(False))


def classify_by_rules(rules: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """Rules applied in turn, each overwriting those before it: the last that holds decides."""
    return reduce(lambda out, rule: F.when(rule[0], rule[1]).otherwise(out), rules, otherwise)


def first_column(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of `names` that df has: chosen when the plan is made, not by row."""
    return next((n for n in names if n in df.columns), None)


def truck_access(width: Column, width_min: float, road_class: Column, fire: Column) -> Column:
    """Why a truck gets in, or null: only a measured, insufficient width rejects. Width outranks fire, fire outranks class."""
    return F.when(width < width_min, F.lit(None).cast("string")).when(width.isNotNull(), "width").when(F.coalesce(fire, F.lit(False)), "fire").otherwise(F.when(road_class == "main", "class"))


def slope_class(slope_pct: Column, table: Sequence[tuple[float, float, float]]) -> Column:
    """Surcharge of the left-closed class a slope falls in."""
    out = F.lit(None).cast("double")
    for low, high, cost in table:
        out = F.when((slope_pct >= low) & (slope_pct < high), F.lit(float(cost))).otherwise(out)
    return out


def construction_cost(config: RoadCost, method: str = "table", width_m: float = 4, slope_max_pct: float | None = None, water: Column | None = None, stream_m: Column | None = None, soil: Column | None = None, forbidden: Column | None = None, extra: Column | None = None, res: float = 5.0) -> tuple[Column, Column]:
    """(cost, passable) of building a road per metre: base, slope, soil, bridge, culvert and free surcharges.

    A slope without a finite price, an obstacle or a forbidden cell is impassable and has no cost."""
    slope = F.col("slope_pct")
    if slope_max_pct is None:
        closed = [low for low, _, c in config.slope_table if c == float("inf")]
        slope_max_pct = min(closed) if closed else float("inf")
    inf = F.lit(float("inf"))
    term = slope_class(slope, config.slope_table) if method == "table" else F.coalesce(earthworks_cost(slope, width_m, config.earthworks), F.when(slope.isNotNull(), inf))
    term = F.when(slope >= slope_max_pct, inf).otherwise(term)
    cost = F.lit(float(config.base)) + term
    if soil is not None and config.soil:
        own = F.lit(0.0)
        for k, v in config.soil.items():
            own = F.when(soil == k, F.lit(float(v))).otherwise(own)
        cost = cost + own
    if water is not None:
        cost = cost + F.when(F.coalesce(water, F.lit(False)), F.lit(float(config.bridge))).otherwise(0.0)
    if stream_m is not None:
        cost = cost + config.culvert * F.least(F.greatest(F.coalesce(stream_m, F.lit(0.0)) / res, F.lit(0.0)), F.lit(1.0))
    if extra is not None:
        cost = cost + F.coalesce(extra, F.lit(0.0))
    ok = cost.isNotNull() & (cost < inf) & ~truth("obstacle")
    if forbidden is not None:
        ok = ok & ~F.coalesce(forbidden, F.lit(False))
    return F.when(ok, cost), ok


def distance_bands(distance: Column, bounds: Sequence[float]) -> Column:
    """1-based band of a distance: [b1, b2) is 1, from the last bound on the last; below the first bound also 1."""
    out = F.lit(1)
    for i, b in enumerate(bounds[1:], 2):
        out = F.when(distance >= b, F.lit(i)).otherwise(out)
    return F.when(distance.isNotNull(), out)


def skid_classes(access: Column, distance: Column, felling_excluded: Column, forest: Column, bounds: Sequence[float]) -> Column:
    """Bands 1..k, then k+1 inaccessible, k+2 not fellable (forest only, outranks the others), k+3 outside forest.

    access: 1 drivable, 2 accessible, 3 not accessible, 4 outside forest."""
    k = len(bounds)
    out = F.when(access == 4, F.lit(k + 3)).when(access == 3, F.lit(k + 1)).when(access.isin(1, 2) & distance.isNotNull(), distance_bands(distance, bounds))
    return F.when(F.coalesce(forest & felling_excluded, F.lit(False)), F.lit(k + 2)).otherwise(out)


def hose_bands(distance: Column, bounds: Sequence[float]) -> Column:
    """0-based band; the last bound belongs to its band, beyond it there is none."""
    out = F.lit(None).cast("int")
    last = len(bounds) - 2
    for b in range(last + 1):
        inside = (distance >= bounds[b]) & ((distance <= bounds[b + 1]) if b == last else (distance < bounds[b + 1]))
        out = F.when(inside, F.lit(b)).otherwise(out)
    return out


def flow_type(flow: Column, thresholds: Sequence[float]) -> Column:
    """Type 1..n of a flow: the number of thresholds it reaches, at least 1."""
    return F.greatest(F.lit(1), sum(((flow >= t).cast("int") for t in thresholds), F.lit(0)))
