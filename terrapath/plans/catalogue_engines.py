"""Engines, and what SQL can't say: rows-only queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra, engines, propagation, tiles
from .catalogue import CONFIG, Query, r6
from .inputs import RES, prepared

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("skidder")
def skidder(spark, d):
    return engines.skidder(prepared(spark, d), CONFIG, RES).select("cell", "access", r6("winch_m", "winch_m"), r6("drive_m", "drive_m"), r6("track_m", "track_m"), r6("distance_m", "distance_m"), "alloc")


@query("skidder_recap")
def skidder_recap(spark, d):
    out = engines.skidder(prepared(spark, d), CONFIG, RES)
    return engines.machine_recap(out, "access", res=RES)


@query("skidder_classes")
def skidder_classes(spark, d):
    out = engines.skidder(prepared(spark, d), CONFIG, RES)
    cls = algebra.skid_classes(F.col("access"), F.col("distance_m"), algebra.excluded(CONFIG), F.col("forest"), CONFIG.skidder.bands_m)
    return out.groupBy(cls.cast("long").alias("skid_class")).agg(F.count("*").alias("cells"))


@query("forwarder")
def forwarder(spark, d):
    return engines.forwarder(prepared(spark, d), CONFIG, RES).select("cell", "access", r6("drive_m", "drive_m"), r6("track_m", "track_m"), r6("distance_m", "distance_m"), "alloc")


@query("fire_truck")
def fire_truck(spark, d):
    out = engines.fire_truck(prepared(spark, d), CONFIG, algebra.road_is("fire"), RES)
    return out.select("cell", "hose_m", "hose_alloc", "hose_rise", F.col("defence").cast("long").alias("defence"))


@query("track_aware")
def track_aware(spark, d):
    """Veto propagation of windows of 40 rows, a task each."""
    run, schema = propagation.track_aware()
    p = prepared(spark, d)
    ok = algebra.drivable_ground(CONFIG) | algebra.delivers()
    w = p.select("cell", "r", "c", F.when(ok, algebra.drive_cost(CONFIG)).alias("price"), F.when(algebra.delivers(), F.col("cell")).alias("source"), F.when(algebra.road_is("track"), F.col("c") * 2.0).otherwise(0.0).alias("track"), F.lit(RES).alias("res"), F.lit(CONFIG.skidder.track_weight_drive).alias("weight"), F.floor(F.col("r") / 40).alias("w"))
    return w.groupBy("w").applyInPandas(lambda pdf: run(pdf.drop(columns="w")), schema).select("cell", r6("cost", "cost"), "alloc", r6("track", "track"))


@query("tiled_by_certificate")
def tiled_by_certificate(spark, d):
    """Least-cost labels of windows under a growing halo, each with its certificate; certified cells equal the whole grid's."""
    p = prepared(spark, d)
    ok = algebra.drivable_ground(CONFIG) | algebra.delivers()
    w = p.select("cell", "r", "c", F.when(ok, algebra.drive_cost(CONFIG)).alias("price"), algebra.delivers().alias("source"))
    rows = w.agg(F.max("r")).first()[0] + 1
    out = tiles.run_by_tiles(w, tiles.least_cost_engine(RES), "cell long, cost double, certified boolean", rows, 50, RES, 50, 15, 60)
    return out.select("cell", r6("cost", "cost"), "certified")
