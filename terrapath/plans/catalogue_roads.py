"""Cable, road, landing and cross-section queries: kernels behind plans, rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import Alignment, Cable, Config, Selection
from ..operators import cable, recap, roads
from .catalogue import Query, r6, sources
from .catalogue_vector import tracks
from .inputs import RES, grid, prepared

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SMALL = Config(cable=Cable(length_max_m=220, length_min_m=60, span_min_m=30, cross_slope_max_pct=60))


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def cable_lines(spark, d, footprint: bool = False) -> tuple[DataFrame, DataFrame]:
    p = prepared(spark, d)
    starts = sources(p.where("road = 1"))
    return cable.scan(p, starts, SMALL, RES, footprint=footprint)


@query("cable_scan")
def cable_scan(spark, d):
    lines = cable_lines(spark, d)[0]
    return lines.select("depart", "azimuth", r6("length_m", "length_m"), "supports", "direction", r6("surface_ha", "surface_ha"), r6("volume_m3", "volume_m3"), r6("ipc", "ipc"))


@query("cable_cover")
def cable_cover(spark, d):
    return cable_lines(spark, d)[1].select("cell", "depart", "azimuth", r6("length_m", "length_m"))


@query("cable_selection")
def cable_selection(spark, d):
    from ..sources.scratch import written

    lines, _ = cable_lines(spark, d, footprint=True)
    ranked = written(recap.line_scores(lines.drop("cells", "support_steps"), Selection()), "ranked")
    return recap.greedy_cover(ranked, lines.select("depart", "azimuth", "cells"), 0.6).select("depart", "azimuth", F.col("rank").cast("long").alias("rank"))


GENTLE = Alignment(grade_min_pct=0, dz_max_m=5)


@query("road_network")
def road_network(spark, d):
    return roads.network(prepared(spark, d), parcels(spark, d), GENTLE, RES, skidding_m=20)


@query("road_multistart")
def road_multistart(spark, d):
    return roads.multistart(prepared(spark, d), parcels(spark, d), GENTLE, RES, starts=4, skidding_m=20)


@query("road_steiner")
def road_steiner(spark, d):
    return roads.steiner(prepared(spark, d), parcels(spark, d), GENTLE, RES)


def parcels(spark, d) -> DataFrame:
    return grid(spark, d).where("cell % 173 = 11 and not obstacle and road is null").select(F.col("cell").alias("parcel"), "r", "c", F.coalesce("volume", F.lit(0.0)).alias("volume"))


@query("landing_candidates")
def landing_candidates(spark, d):
    t = tracks(spark, d).withColumns({"class": F.when(F.col("id") % 3 == 0, "main").otherwise("track"), "width_m": F.when(F.col("id") % 2 == 0, F.col("id") % 9).cast("double"), "fire": F.col("id") % 5 == 0})
    out = roads.landings(t, grid(spark, d), RES, width_min=3, grade_max_pct=20, spacing=60, window=30, forest_max_m=15)
    return out.select("id", r6("at_m", "at_m"), "access", r6("grade_pct", "grade_pct"))


@query("cross_section")
def cross_section(spark, d):
    g = grid(spark, d).select(((F.col("c") - 24.5) * 0.25).alias("across"), (F.col("z") / 40 + F.abs(F.col("c") - 24.5) * 0.02).alias("height"), F.col("r").alias("station"))
    return roads.cross_sections(g)


@query("road_annealed")
def road_annealed(spark, d):
    return roads.improve(prepared(spark, d), parcels(spark, d), GENTLE, "anneal", RES, skidding_m=20)


@query("road_ripped_up")
def road_ripped_up(spark, d):
    return roads.improve(prepared(spark, d), parcels(spark, d), GENTLE, "rip_up", RES, skidding_m=20)
