"""Machines: what a skidder, a forwarder and a fire truck reach, cell by cell.

Cells are prepared ones (slope_pct, slope_max, aspect_deg and the layers of `algebra`). Every step is a plan or
a tiled propagation; steps meet by joins on the cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import Config
from ..functions.scalars import slope_weight
from ..sources.scratch import written
from . import algebra, rays
from .neighbours import TILE, focal
from .propagation import network_distance, propagate, zone_connected
from .recap import class_recap

# fixed values: access codes of the machines, and of the fire truck
ACCESS = ((1, "drivable"), (2, "accessible"), (3, "not_accessible"), (4, "outside_forest"))
FIRE = ((1, "inaccessible"), (2, "too_steep"), (3, "defended_1"), (4, "defended_2"), (5, "defended_3"), (6, "outside_forest"))


def own_id(mask: Column) -> Column:
    """Source ids one above the cell's, as 0 means none."""
    return F.when(mask, F.col("cell") + 1)


def sources(cells: DataFrame, mask: Column, start: Column | None = None) -> DataFrame:
    return cells.where(F.coalesce(mask, F.lit(False))).select(F.col("cell").alias("src"), F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("z").alias("z0"), (start if start is not None else F.lit(0.0)).alias("start"))


def labels(found: DataFrame, cost: str, alloc: str) -> DataFrame:
    return found.select("cell", F.col("cost").alias(cost), (F.col("alloc") - 1).alias(alloc))


def driven(cells: DataFrame, network: DataFrame, config: Config, res: float, tile: int = TILE) -> DataFrame:
    """(cell, drive_m, drive_alloc): cheapest way over drivable ground from a road, or from a track if that is
    shorter with the track's own way to a road counted by its weight. Neither network crosses the other's cells;
    tracks that reach no road are dropped."""
    price = algebra.drive_cost(config)
    zone = zone_connected(cells, algebra.drivable_ground(config), F.col("forest"), algebra.delivers(), price, config.skidder.off_road_max_m, res, tile)
    orphan = network.where("unreachable").select("cell", F.lit(True).alias("orphan"))
    b = written(cells.join(zone.withColumn("in_zone", F.lit(True)), "cell", "left").join(orphan, "cell", "left"), "drive")
    track = algebra.road_is("track")
    road = algebra.delivers() & ~track
    open_ = F.coalesce("in_zone", F.lit(False))
    by_road = labels(propagate(b, price, own_id(road), open_ & ~track, res=res, tile=tile), "r_cost", "r_alloc")
    by_track = labels(propagate(b, price, own_id(track & F.col("orphan").isNull()), open_ & ~road, res=res, tile=tile), "t_cost", "t_alloc")
    by_track = by_track.join(network.select(F.col("cell").alias("t_alloc"), F.col("distance").alias("t_way")), "t_alloc", "left")
    both = by_road.join(by_track, "cell", "full")
    wins = F.col("r_cost").isNotNull() & (F.col("t_cost").isNull() | (F.col("r_cost") <= F.col("t_cost") + config.skidder.track_weight_choice * F.col("t_way")))
    return both.select("cell", F.when(wins, F.col("r_cost")).otherwise(F.col("t_cost")).alias("drive_m"), F.when(wins, F.col("r_alloc")).otherwise(F.col("t_alloc")).alias("drive_alloc"))


def edge_of(cells: DataFrame, mask: str) -> DataFrame:
    """cells plus `edge`: in the mask, with a neighbour outside it or outside the grid."""
    t = focal(cells.withColumn("__m", F.col(mask).cast("int")), "__m", "sum", "__n")
    return t.withColumn("edge", F.col(mask) & (F.col("__n") < 9)).drop("__m", "__n")


def access_code(ok: Column, drivable: Column, road: Column) -> Column:
    code = F.when(ok & drivable | road, 1).when(ok, 2).otherwise(3)
    return F.when(F.col("slope_pct").isNotNull() | road, F.when(~algebra.truth("forest") & ~road, 4).otherwise(code))


def skidder(cells: DataFrame, config: Config, res: float = 5.0, azimuths: list[int] | None = None, tile: int = TILE) -> DataFrame:
    """cells plus access, winch_m, drive_m, track_m, distance_m and alloc (the road cell wood goes to).

    Winching from the road outranks driving; what neither reaches may be winched from the edge of the driven
    ground. Cells allotted to a track that reaches no road are not accessible."""
    c = written(cells.withColumns({"winchable": algebra.winch_zone(config)}), "skidder")
    road = algebra.delivers()
    network = written(network_distance(c, slope_weight(F.coalesce("slope_pct", F.lit(0.0))), res, tile), "network")
    winch = rays.winch(c, sources(c, road), config, res, azimuths).select("cell", F.col("distance").alias("w_m"), F.col("alloc").alias("w_alloc"))
    way = network.select(F.col("cell").alias("alloc"), F.col("distance").alias("way"), F.col("unreachable").alias("orphan"))
    t = c.join(winch, "cell", "left").join(driven(c, network, config, res, tile), "cell", "left")
    by_winch, by_drive = F.col("w_m").isNotNull() & ~road, F.col("drive_m").isNotNull() & ~road
    t = t.withColumns({"by_winch": by_winch, "by_drive": by_drive})
    t = t.withColumn("alloc", F.when(road, F.col("cell")).when(F.col("by_winch"), F.col("w_alloc")).when(F.col("by_drive"), F.col("drive_alloc")))
    t = t.withColumns({"winch_m": F.when(F.col("by_winch"), F.col("w_m")).otherwise(0.0), "forest_m": F.when(~F.col("by_winch") & F.col("by_drive"), F.col("drive_m")).otherwise(0.0)})
    t = written(t.join(way, "alloc", "left").withColumn("reached", F.col("by_drive") | road), "skidder")

    # third pass: from the edge of what was driven, carrying the way so far
    edge = edge_of(t, "reached").where("edge and not by_winch").where(~algebra.truth("obstacle") & ~algebra.truth("public") & F.col("road").isNull())
    late = rays.winch(t.select("cell", "r", "c", "z", (F.col("winchable") & ~F.col("reached")).alias("winchable")), sources(edge, F.lit(True), F.col("drive_m") + F.coalesce("way", F.lit(0.0))), config, res, azimuths)
    late = late.where("distance > 0").join(t.select(F.col("cell").alias("src"), F.col("drive_m").alias("e_drive"), F.col("drive_alloc").alias("e_alloc")), late["alloc"] == F.col("src")).select("cell", F.col("distance").alias("e_winch"), "e_drive", "e_alloc")
    t = t.join(late, "cell", "left")
    fresh = F.col("e_winch").isNotNull() & ~F.col("by_winch") & ~F.col("by_drive") & ~road
    t = t.withColumns({"fresh": fresh}).withColumns({
        "winch_m": F.when(F.col("fresh"), F.col("e_winch")).otherwise(F.col("winch_m")), "forest_m": F.when(F.col("fresh"), F.col("e_drive")).otherwise(F.col("forest_m")),
        "alloc": F.when(F.col("fresh"), F.col("e_alloc")).otherwise(F.col("alloc")),
    })
    t = t.drop("way", "orphan").join(way, "alloc", "left")
    ok = (F.col("by_winch") | F.col("by_drive") | F.col("fresh") | road) & ~F.coalesce("orphan", F.lit(False))
    out = t.withColumns({"access": access_code(ok, algebra.drive_zone(config), road), "track_m": F.coalesce("way", F.lit(0.0)), "drive_m": F.col("forest_m"), "ok": ok})
    return out.select(*cells.columns, "access", *[F.when(F.col("ok"), F.col(x)).alias(x) for x in ("winch_m", "drive_m", "track_m", "alloc")], F.when(F.col("ok"), F.col("winch_m") + F.col("drive_m") + F.col("track_m")).alias("distance_m"))


def forwarder(cells: DataFrame, config: Config, res: float = 5.0, azimuths: list[int] | None = None, tile: int = TILE, drop_orphans: bool = True) -> DataFrame:
    """cells plus access, drive_m, track_m, distance_m and alloc.

    Flat ground is driven freely; straight up and down the slope where that is shorter with the track's way
    counted; then from the flat edge of what was driven; and the crane reaches a little further."""
    f = config.forwarder
    c = written(cells, "forwarder")
    road = algebra.delivers()
    weight = slope_weight(F.coalesce("slope_pct", F.lit(0.0)))
    network = written(network_distance(c, weight, res, tile), "network")
    way = network.select(F.col("cell").alias("alloc"), F.col("distance").alias("way"), F.col("unreachable").alias("orphan"))
    flat = zone_connected(c, algebra.flat_ground(config), F.col("forest"), road, weight, f.off_road_max_m, res, tile).withColumn("flat_zone", F.lit(True))
    c = written(c.join(flat, "cell", "left").withColumn("flat_zone", F.coalesce("flat_zone", F.lit(False))), "forwarder")
    free = labels(propagate(c, weight, own_id(road), F.col("flat_zone"), res=res, tile=tile), "f_m", "f_alloc")
    edge = edge_of(c.withColumn("m", algebra.truth("forest")), "m")
    jump = propagate(edge, weight, own_id(F.col("edge")), ~algebra.truth("forest") & ~algebra.truth("obstacle") & ~algebra.truth("public"), f.off_road_max_m, res, tile).select("cell", F.lit(True).alias("jump"))
    c = c.join(jump, "cell", "left").withColumn("drivable", algebra.forwarder_zone(config, F.col("jump")))
    c = written(c, "forwarder")
    straight = rays.forward(c, sources(c, road), config, res, azimuths).select("cell", F.col("distance").alias("s_m"), F.col("alloc").alias("s_alloc"))
    t = c.join(free, "cell", "left").join(straight, "cell", "left")
    for x in ("f", "s"):
        t = t.join(way.select(F.col("alloc").alias(f"{x}_alloc"), F.col("way").alias(f"{x}_way")), f"{x}_alloc", "left")
    take = F.col("s_m").isNotNull() & (F.col("f_m").isNull() | (F.col("s_m") < F.col("f_m") + config.skidder.track_weight_choice * F.coalesce("f_way", F.lit(0.0))))
    t = t.withColumns({"drive_m": F.when(take, F.col("s_m")).otherwise(F.col("f_m")), "alloc": F.when(take, F.col("s_alloc")).otherwise(F.col("f_alloc"))})
    t = written(t.withColumn("reached", F.col("drive_m").isNotNull()).drop("f_way", "s_way"), "forwarder")

    rim = edge_of(t, "reached").where("edge").where(algebra.flat_ground(config))
    late = rays.forward(t.withColumn("drivable", F.col("drivable") & ~F.col("reached")), sources(rim, F.lit(True), F.col("drive_m")), config, res, azimuths).where("distance > 0")
    late = late.join(t.select(F.col("cell").alias("src"), F.col("drive_m").alias("e_m"), F.col("alloc").alias("e_alloc")), late["alloc"] == F.col("src")).select("cell", (F.col("distance") + F.col("e_m")).alias("e_m"), "e_alloc")
    t = t.join(late, "cell", "left").withColumns({"drive_m": F.coalesce("drive_m", "e_m"), "alloc": F.coalesce("alloc", "e_alloc")}).drop("e_m", "e_alloc")
    t = written(t.withColumn("reached", F.col("drive_m").isNotNull()), "forwarder")

    crane = propagate(t, F.lit(1.0), own_id(F.col("reached")), algebra.truth("forest") & algebra.fellable(config), f.crane_m, res, tile)
    crane = crane.select("cell", (F.col("alloc") - 1).alias("from")).join(t.select(F.col("cell").alias("from"), F.col("drive_m").alias("k_m"), F.col("alloc").alias("k_alloc")), "from").drop("from")
    t = t.join(crane, "cell", "left").withColumns({"drive_m": F.coalesce("drive_m", "k_m"), "alloc": F.coalesce("alloc", "k_alloc")}).join(way, "alloc", "left")
    ok = F.col("drive_m").isNotNull() & (~F.coalesce("orphan", F.lit(False)) if drop_orphans else F.lit(True))
    out = t.withColumns({"ok": ok, "access": access_code(ok, algebra.forwarder_zone(config, F.lit(False)), road), "track_m": F.coalesce("way", F.lit(0.0))})
    return out.select(*cells.columns, "access", *[F.when(F.col("ok"), F.col(x)).alias(x) for x in ("drive_m", "track_m", "alloc")], F.when(F.col("ok"), F.col("drive_m") + F.col("track_m")).alias("distance_m"))


def fire_truck(cells: DataFrame, config: Config, source: Column, res: float = 5.0, azimuths: list[int] | None = None) -> DataFrame:
    """cells plus hose_m, hose_alloc, hose_rise and defence (codes of FIRE; too steep outranks the bands)."""
    f = config.fire
    gentle = F.coalesce(F.col("slope_pct") <= f.slope_max_pct, F.lit(False))
    c = cells.withColumn("usable", gentle & ~algebra.truth("obstacle"))
    hose = rays.hose(c, sources(cells, source), f.reach_m, res, azimuths)
    t = cells.join(hose.select("cell", F.col("distance").alias("hose_m"), F.col("alloc").alias("hose_alloc"), F.col("rise").alias("hose_rise")), "cell", "left")
    band = algebra.hose_bands(F.col("hose_m"), f.bands_m)
    code = F.when(~algebra.truth("forest"), 6).when(F.coalesce(F.col("slope_pct") > f.slope_max_pct, F.lit(False)), 2).when(band.isNotNull(), band + 3).otherwise(1)
    return t.withColumn("defence", code)


def machine_recap(result: DataFrame, code: str, levels: tuple = ACCESS, res: float = 5.0) -> DataFrame:
    names = result.sparkSession.createDataFrame(list(levels), "value int, class string")
    return class_recap(result, names, code, "volume" if "volume" in result.columns else None, res)
