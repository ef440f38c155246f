"""Every operator as a query on the driver's tables, with its DuckDB statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.config import Config, Earthworks, RoadCost
from ..operators import algebra, neighbours, propagation, rays, recap, terrain
from ..operators.neighbours import TILE
from .inputs import RES, SQL_GRID, SQL_PREPARED, _EIGHT, grid, prepared, sql_around, sql_slope, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
CONFIG = Config()


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def r6(x: Column | str, name: str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6).alias(name)


def long(x: Column | str, name: str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long").alias(name)


# terrain and neighbourhoods

FOUR = sql_slope("(z_e - z_w) / 10e0", "(z_n - z_s) / 10e0", "z_n IS NOT NULL AND z_s IS NOT NULL AND z_e IS NOT NULL AND z_w IS NOT NULL")


@query("grid_slope_horn", f"WITH {SQL_GRID}, {sql_slope()} SELECT cell, round(slope_pct, 6) AS slope_pct FROM s")
def grid_slope_horn(spark, d):
    return terrain.slope_aspect(grid(spark, d), "z", RES).select("cell", r6("slope_pct", "slope_pct"))


@query("grid_slope_4n", f"WITH {SQL_GRID}, {FOUR} SELECT cell, round(slope_pct, 6) AS slope_pct FROM s")
def grid_slope_4n(spark, d):
    return terrain.slope_aspect(grid(spark, d), "z", RES, "four").select("cell", r6("slope_pct", "slope_pct"))


@query("grid_aspect", f"WITH {SQL_GRID}, {sql_slope()} SELECT cell, round(aspect_deg, 6) AS aspect_deg FROM s")
def grid_aspect(spark, d):
    return terrain.slope_aspect(grid(spark, d), "z", RES).select("cell", r6("aspect_deg", "aspect_deg"))


HILL = "g2 AS (SELECT *, (coalesce(z_e, z) - coalesce(z_w, z)) / 10e0 AS gx, (coalesce(z_n, z) - coalesce(z_s, z)) / 10e0 AS gy FROM gz)"


@query("grid_hillshade", f"WITH {SQL_GRID}, gz AS ({sql_around('g', 'z')}), {HILL} SELECT cell, round(greatest((sin(radians(35)) - gx * sin(radians(315)) * cos(radians(35)) - gy * cos(radians(315)) * cos(radians(35))) / sqrt(1 + pow(gx, 2) + pow(gy, 2)), 0), 6) AS hillshade FROM g2")
def grid_hillshade(spark, d):
    return terrain.hillshade(grid(spark, d), "z", RES).select("cell", r6("hillshade", "hillshade"))


def _over(how: str) -> str:
    return f"WITH {SQL_GRID} SELECT a.cell, {how} AS v FROM g a JOIN g b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.cell"


@query("focal_max_3x3", f"WITH {SQL_PREPARED} SELECT cell, round(slope_max, 6) AS slope_max FROM p")
def focal_max_3x3(spark, d):
    return prepared(spark, d).select("cell", r6("slope_max", "slope_max"))


@query("focal_sum_contour", f"SELECT cell, v < 9 AS contour, CAST(v AS BIGINT) AS around FROM ({_over('sum(CAST(b.forest AS INT))')})")
def focal_sum_contour(spark, d):
    g = grid(spark, d).withColumn("f", F.col("forest").cast("int"))
    return neighbours.focal(g, "f", "sum", "around").select("cell", (F.col("around") < 9).alias("contour"), long("around", "around"))


@query("inner_contour", f"WITH {SQL_GRID}, n AS (SELECT a.cell, a.forest, count(*) FILTER (b.forest) AS k FROM g a JOIN g b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.cell, a.forest) SELECT cell, forest AND k < 9 AS contour FROM n")
def inner_contour(spark, d):
    return neighbours.inner_contour(grid(spark, d), "forest").select("cell", "contour")


@query("circular_fraction", f"WITH {SQL_GRID} SELECT a.cell, round(sum(CAST(b.forest AS DOUBLE)) / 29, 6) AS share FROM g a JOIN g b ON b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3 AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 9 GROUP BY a.cell")
def circular_fraction(spark, d):
    return neighbours.disc_mean(grid(spark, d).withColumn("f", F.col("forest").cast("double")), "f", 15, RES, "share").select("cell", r6("share", "share"))


@query("pyramid_mean", f"WITH {SQL_GRID} SELECT CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c, round(avg(z), 6) AS z, count(z) AS cells FROM g GROUP BY 1, 2")
def pyramid_mean(spark, d):
    return neighbours.pyramid(grid(spark, d), "z", 4).select("r", "c", r6("z", "z"), "cells")


POINTS = "pt AS (SELECT event_id, user_id * 1.7e0 + 1 AS x, (event_id % 20) * 1.1e0 + 0.3e0 AS y FROM events)"


def points(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", (F.col("user_id") * F.lit(1.7) + 1).alias("x"), (F.col("event_id") % 20 * F.lit(1.1) + F.lit(0.3)).alias("y"))


@query("sample_nearest", f"WITH {SQL_GRID}, {POINTS} SELECT event_id, round(z, 6) AS z FROM pt LEFT JOIN g ON g.r = floor(y / 5) AND g.c = floor(x / 5)")
def sample_nearest(spark, d):
    return neighbours.sample(grid(spark, d), points(spark, d), "z", RES).select("event_id", r6("z", "z"))


@query("sample_bilinear", f"""WITH {SQL_GRID}, {POINTS},
q AS (SELECT *, x / 5e0 - 0.5e0 AS fx, y / 5e0 - 0.5e0 AS fy FROM pt), k AS (SELECT q.*, a, b FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(a, b)),
w AS (SELECT *, (CASE WHEN a = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN b = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM k)
SELECT event_id, round(CASE WHEN count(*) = count(z) THEN sum(z * w) END, 6) AS z FROM w LEFT JOIN g ON g.r = floor(fy) + a AND g.c = floor(fx) + b WHERE w > 0 GROUP BY event_id""")
def sample_bilinear(spark, d):
    return neighbours.sample(grid(spark, d), points(spark, d), "z", RES, "bilinear").select("event_id", r6("z", "z"))


# map algebra

DRIVE = "coalesce(slope_pct <= 30, false) AND NOT obstacle AND NOT partial AND NOT public"
FLAT = "coalesce(slope_pct <= 15, false) AND NOT obstacle AND NOT public"
WINCH = "forest AND NOT obstacle AND coalesce(slope_max <= 100, false)"


@query("slope_weight", f"WITH {SQL_PREPARED} SELECT cell, round(sqrt(1 + pow(slope_pct / 100, 2)), 6) AS weight FROM p")
def slope_weight(spark, d):
    return prepared(spark, d).select("cell", r6(scalars.slope_weight(F.col("slope_pct")), "weight"))


@query("cost_surface", f"WITH {SQL_PREPARED} SELECT cell, round(sqrt(1 + pow(slope_pct / 100, 2)) + CASE WHEN obstacle THEN 1000 ELSE 0 END, 6) AS cost FROM p")
def cost_surface(spark, d):
    return prepared(spark, d).select("cell", r6(algebra.drive_cost(CONFIG), "cost"))


@query("zones", f"""WITH {SQL_PREPARED} SELECT cell, forest AND {DRIVE} AS drive, {DRIVE} AS ground, {FLAT} AS flat, {WINCH} AS winch, coalesce(slope_max > 100, false) AS excluded,
({DRIVE}) OR road IS NOT NULL AS upper, coalesce(slope_max <= 100, false) AS fellable, forest AND coalesce(slope_max <= 100, false) AND coalesce(slope_pct <= 30, false) AND NOT obstacle AND NOT public AS forwarder, coalesce(road <> 4, false) AS delivers FROM p""")
def zones(spark, d):
    a = algebra
    return prepared(spark, d).select(
        "cell", a.drive_zone(CONFIG).alias("drive"), a.drivable_ground(CONFIG).alias("ground"), a.flat_ground(CONFIG).alias("flat"), a.winch_zone(CONFIG).alias("winch"), a.excluded(CONFIG).alias("excluded"),
        a.upper_bound_zone(CONFIG).alias("upper"), a.fellable(CONFIG).alias("fellable"), a.forwarder_zone(CONFIG, F.lit(False)).alias("forwarder"), a.delivers().alias("delivers"),
    )


LAW = scalars.winch_law(CONFIG)


@query("winch_law", f"WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, (l_discount * 20 - 1) AS s FROM lineitem) SELECT k, n, q, round(s, 6) AS s, round(CASE WHEN s <= {LAW.down}e0 THEN {LAW.downhill_m}e0 WHEN s > {LAW.up}e0 THEN {LAW.uphill_m}e0 ELSE {LAW.base!r}e0 / (1 - {LAW.coeff!r}e0 * s / sqrt(1 + pow(s, 2))) END, 6) AS reach FROM x")
def winch_law(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), (F.col("l_discount") * 20 - 1).alias("s"))
    return x.select("k", "n", "q", r6("s", "s"), r6(scalars.winch_reach(F.col("s"), LAW), "reach"))


EARTH = """least(greatest((p - 0.35e0) / (0.6e0 - 0.35e0), 0e0), 1e0)"""


@query("earthworks_cost", f"""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_quantity * 2.1e0 / 100 AS p FROM lineitem),
y AS (SELECT *, {EARTH} AS r, 2e0 * (1 + {EARTH}) AS a, 2e0 * (1 - {EARTH}) AS b FROM x),
z AS (SELECT *, p * pow(a, 2) / 2 + 0.5e0 * pow(p * a, 2) / (1e0 - p) AS cut, CASE WHEN b > 0 THEN p * pow(b, 2) / 2 + 0.5e0 * pow(p * b, 2) / (0.6e0 - p) ELSE 0e0 END AS fill FROM y)
SELECT k, n, q, round(CASE WHEN NOT (p < 0 OR p >= 1 OR (r < 1 AND p >= 0.6e0)) THEN cut * 17 + fill * 11 + greatest(cut - fill, 0e0) * 33 END, 4) AS cost FROM z""")
def earthworks(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), (F.col("l_quantity") * F.lit(2.1)).alias("s"))
    return x.select("k", "n", "q", F.round(scalars.earthworks_cost(F.col("s"), 4, Earthworks()), 4).alias("cost"))


@query("construction_cost", f"""WITH {SQL_PREPARED}, x AS (SELECT *, 20 + CASE WHEN slope_pct >= 60 THEN CAST('inf' AS DOUBLE) WHEN slope_pct >= 35 THEN 90 WHEN slope_pct >= 15 THEN 25 WHEN slope_pct >= 0 THEN 0 END
 + CASE WHEN size = 21 THEN 400 ELSE 0 END + 120 * least(greatest(size / 10e0 / 5e0, 0e0), 1e0) AS cost FROM p), y AS (SELECT *, cost IS NOT NULL AND cost < CAST('inf' AS DOUBLE) AND NOT obstacle AND NOT (size = 14) AS passable FROM x)
SELECT cell, round(CASE WHEN passable THEN cost END, 6) AS cost, passable FROM y""")
def construction_cost(spark, d):
    cost, ok = algebra.construction_cost(RoadCost(), water=F.col("size") == 21, stream_m=F.col("size") / F.lit(10.0), forbidden=F.col("size") == 14)
    return prepared(spark, d).select("cell", r6(cost, "cost"), ok.alias("passable"))


@query("construction_earthworks", f"""WITH {SQL_PREPARED}, q AS (SELECT *, slope_pct / 100 AS p FROM p), y AS (SELECT *, {EARTH} AS rr, 2e0 * (1 + {EARTH}) AS a, 2e0 * (1 - {EARTH}) AS b FROM q),
w AS (SELECT *, p * pow(a, 2) / 2 + 0.5e0 * pow(p * a, 2) / (1e0 - p) AS cut, CASE WHEN b > 0 THEN p * pow(b, 2) / 2 + 0.5e0 * pow(p * b, 2) / (0.6e0 - p) ELSE 0e0 END AS fill FROM y),
x AS (SELECT *, CASE WHEN slope_pct >= 60 OR p >= 1 OR (rr < 1 AND p >= 0.6e0) THEN NULL ELSE 20 + cut * 17 + fill * 11 + greatest(cut - fill, 0e0) * 33 END AS cost FROM w)
SELECT cell, round(CASE WHEN NOT obstacle THEN cost END, 4) AS cost, cost IS NOT NULL AND NOT obstacle AS passable FROM x""")
def construction_earthworks(spark, d):
    cost, ok = algebra.construction_cost(RoadCost(), "earthworks")
    return prepared(spark, d).select("cell", F.round(cost, 4).alias("cost"), ok.alias("passable"))


@query("distance_bands", "SELECT o_orderkey, CAST(CASE WHEN o_totalprice / 100 >= 2000 THEN 6 WHEN o_totalprice / 100 >= 1500 THEN 5 WHEN o_totalprice / 100 >= 1000 THEN 4 WHEN o_totalprice / 100 >= 500 THEN 3 WHEN o_totalprice / 100 >= 250 THEN 2 ELSE 1 END AS BIGINT) AS band FROM orders")
def distance_bands(spark, d):
    return table(spark, d, "orders").select("o_orderkey", long(algebra.distance_bands(F.col("o_totalprice") / 100, CONFIG.skidder.bands_m), "band"))


@query("skid_classes", f"WITH {SQL_PREPARED}, a AS (SELECT *, CASE WHEN NOT forest THEN 4 WHEN obstacle THEN 3 WHEN {DRIVE} THEN 1 ELSE 2 END AS acc, price * 20 - 18000 AS dist FROM p) SELECT cell, CAST(CASE WHEN forest AND coalesce(slope_max > 100, false) THEN 8 WHEN acc = 4 THEN 9 WHEN acc = 3 THEN 7 WHEN dist >= 2000 THEN 6 WHEN dist >= 1500 THEN 5 WHEN dist >= 1000 THEN 4 WHEN dist >= 500 THEN 3 WHEN dist >= 250 THEN 2 ELSE 1 END AS BIGINT) AS skid_class FROM a")
def skid_classes(spark, d):
    acc = F.when(~F.col("forest"), 4).when(F.col("obstacle"), 3).when(algebra.drivable_ground(CONFIG), 1).otherwise(2)
    p = prepared(spark, d).withColumns({"acc": acc, "dist": F.col("price") * 20 - 18000})
    return p.select("cell", long(algebra.skid_classes(F.col("acc"), F.col("dist"), algebra.excluded(CONFIG), F.col("forest"), CONFIG.skidder.bands_m), "skid_class"))


@query("dfci_bands", "WITH x AS (SELECT o_orderkey, o_totalprice / 500 AS h FROM orders) SELECT o_orderkey, CAST(CASE WHEN h >= 0 AND h < 120 THEN 0 WHEN h >= 120 AND h < 280 THEN 1 WHEN h >= 280 AND h <= 440 THEN 2 END AS BIGINT) AS band FROM x")
def dfci_bands(spark, d):
    return table(spark, d, "orders").select("o_orderkey", long(algebra.hose_bands(F.col("o_totalprice") / 500, CONFIG.fire.bands_m), "band"))


@query("road_class_case", "SELECT p_partkey, CASE WHEN p_brand LIKE '%5' THEN 'off' WHEN p_size > 40 THEN 'main' WHEN p_size % 3 = 0 THEN 'track' ELSE 'off' END AS road_class FROM part")
def road_class_case(spark, d):
    rules = [(F.col("p_size") % 3 == 0, F.lit("track")), (F.col("p_size") > 40, F.lit("main")), (F.col("p_brand").like("%5"), F.lit("off"))]
    return table(spark, d, "part").select("p_partkey", algebra.classify_by_rules(rules, F.lit("off")).alias("road_class"))


@query("truck_access", "SELECT p_partkey, CASE WHEN w < 4 THEN NULL WHEN w IS NOT NULL THEN 'width' WHEN fire THEN 'fire' WHEN cls = 'main' THEN 'class' END AS access FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size / 5e0 END AS w, p_size % 5 = 0 AS fire, CASE WHEN p_size > 25 THEN 'main' ELSE 'track' END AS cls FROM part)")
def truck_access(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 5).alias("w"), (F.col("p_size") % 5 == 0).alias("fire"), F.when(F.col("p_size") > 25, "main").otherwise("track").alias("cls"))
    return p.select("p_partkey", algebra.truck_access(F.col("w"), 4, F.col("cls"), F.col("fire")).alias("access"))


@query("road_type", "SELECT o_orderkey, CAST(greatest(1, (o_totalprice >= 1000)::INT + (o_totalprice >= 50000)::INT + (o_totalprice >= 200000)::INT) AS BIGINT) AS type FROM orders")
def road_type(spark, d):
    return table(spark, d, "orders").select("o_orderkey", long(algebra.flow_type(F.col("o_totalprice"), (1000, 50000, 200000)), "type"))


CATENARY_SQL = """WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, 60000e0 + l_extendedprice / 10 AS th, 20000e0 + l_extendedprice / 50 AS tv, 200e0 + l_quantity AS lo, 25446900e0 AS eao, 3600e0 AS w, 28439e0 AS f, (200e0 + l_quantity) * 0.4e0 AS s1, (200e0 + l_quantity) * (0.1e0 + l_tax * 10) AS s FROM lineitem)
SELECT k, n, q, round(s, 6) AS s, round(th * s / eao + th * lo / w * (asinh(tv / th) - asinh((tv - f - w * (s / lo)) / th) + asinh((tv - f - w * (s1 / lo)) / th) - asinh((tv - w * (s1 / lo)) / th)), 5) AS x,
round(w * s / eao * (tv / w - s / (2 * lo)) + th * lo / w * (sqrt(1 + pow(tv / th, 2)) - sqrt(1 + pow((tv - f - w * (s / lo)) / th, 2)) + f * w / (th * eao) * (s1 / lo - s / lo) + sqrt(1 + pow((tv - f - w * (s1 / lo)) / th, 2)) - sqrt(1 + pow((tv - w * (s1 / lo)) / th, 2))), 5) AS z FROM x"""


@query("catenary", CATENARY_SQL)
def catenary(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    lo = F.lit(200.0) + q
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), q.alias("q"), (F.lit(60000.0) + p / 10).alias("th"), (F.lit(20000.0) + p / 50).alias("tv"), lo.alias("lo"), F.lit(25446900.0).alias("eao"), F.lit(3600.0).alias("w"), F.lit(28439.0).alias("f"), (lo * F.lit(0.4)).alias("s1"), (lo * (F.lit(0.1) + F.col("l_tax") * 10)).alias("s"))
    a = [F.col(c) for c in ("th", "tv", "lo", "eao", "w", "f", "s1", "s")]
    return x.select("k", "n", "q", r6("s", "s"), F.round(scalars.catenary_x(*a), 5).alias("x"), F.round(scalars.catenary_z(*a), 5).alias("z"))


# recaps, agreement, scores

LEVELS = ((1, "drivable"), (2, "accessible"), (3, "not_accessible"), (4, "outside_forest"), (5, "never"))
ACCESS = f"CASE WHEN slope_pct IS NULL THEN NULL WHEN NOT forest THEN 4 WHEN obstacle THEN 3 WHEN {DRIVE} THEN 1 ELSE 2 END"


def access_cells(spark, d):
    acc = F.when(F.col("slope_pct").isNotNull(), F.when(~F.col("forest"), 4).when(F.col("obstacle"), 3).when(algebra.drivable_ground(CONFIG), 1).otherwise(2))
    return prepared(spark, d).withColumn("value", acc)


LEVELS_SQL = "(VALUES " + ", ".join(f"({v}, '{n}')" for v, n in LEVELS) + ", (NULL, 'undetermined')) l(v, class)"


@query("class_recap", f"WITH {SQL_PREPARED}, a AS (SELECT *, {ACCESS} AS value FROM p) SELECT l.class, count(a.cell) AS cells, round(count(a.cell) * 25 / 10000e0, 6) AS area_ha, round(coalesce(sum(volume), 0), 4) AS volume FROM {LEVELS_SQL} LEFT JOIN a ON a.value IS NOT DISTINCT FROM l.v GROUP BY l.class")
def class_recap(spark, d):
    levels = spark.createDataFrame(list(LEVELS), "value int, class string")
    return recap.class_recap(access_cells(spark, d), levels, volume="volume", res=RES).select("class", "cells", r6("area_ha", "area_ha"), F.round("volume", 4).alias("volume"))


@query("zonal_pivot", f"WITH {SQL_PREPARED}, a AS (SELECT *, {ACCESS} AS value FROM p) SELECT CAST(n_nationkey AS BIGINT) AS zone, " + ", ".join(f"round(count(*) FILTER (value = {v}) * 25 / 10000e0, 6) AS surface_{n}_ha, round(coalesce(sum(volume) FILTER (value = {v}), 0), 4) AS volume_{n}_m3" for v, n in LEVELS) + ", round(count(a.cell) * 25 / 10000e0, 6) AS surface_total_ha FROM nation LEFT JOIN a ON a.zone = n_nationkey GROUP BY n_nationkey")
def zonal_pivot(spark, d):
    zones = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("zone"))
    t = recap.zonal_table(access_cells(spark, d), zones, LEVELS, volume="volume", res=RES)
    return t.select("zone", *[F.round(c, 6 if c.endswith("ha") else 4).alias(c) for c in t.columns if c != "zone"])


PAIRS = "x AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS a, CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS b FROM lineitem)"


def pairs(spark, d):
    return table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).alias("a"), F.when(F.col("l_linenumber") % 5 == 0, None).when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("b"))


@query("confusion_matrix", f"WITH {PAIRS} SELECT CAST(a AS BIGINT) AS ours, CAST(b AS BIGINT) AS theirs, round(count(*) * 25 / 10000e0, 6) AS area_ha FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b")
def confusion_matrix(spark, d):
    return recap.confusion(pairs(spark, d), "a", "b", RES).select(long("ours", "ours"), long("theirs", "theirs"), r6("area_ha", "area_ha"))


@query("agreement", f"""WITH {PAIRS}, n AS (SELECT count(*) FILTER (a = b) AS same, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (a = 1) = (b = 1)) AS two, count(*) FILTER (a = 1 AND b = 1) AS hit, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND (a = 1 OR b = 1)) AS any1, count(*) FILTER (a IS NOT NULL AND b IS NULL) AS o, count(*) FILTER (a IS NULL AND b IS NOT NULL) AS t FROM x)
SELECT round(same / n, 6) AS agreement, round(two / n, 6) AS agreement_two, round(hit / any1, 6) AS jaccard, round(n * 0.0025e0, 6) AS common_ha, round(o * 0.0025e0, 6) AS ours_only_ha, round(t * 0.0025e0, 6) AS theirs_only_ha FROM n""")
def agreement(spark, d):
    t = recap.agreement(pairs(spark, d), "a", "b", F.col("a") == 1, F.col("b") == 1, RES)
    return t.select(*[r6(c, c) for c in t.columns])


@query("oracle_diff", "WITH x AS (SELECT c_custkey AS k, c_acctbal AS a, c_acctbal + (CASE WHEN c_custkey % 7 = 0 THEN 0.001e0 ELSE 0 END) AS o FROM customer), y AS (SELECT *, abs(a - o) AS diff, abs(a - o) / greatest(abs(o), 1e-12) AS rel FROM x) SELECT bool_and(diff <= 0 OR rel <= 1e-6) AS ok, true AS same_nulls, round(max(diff), 6) AS max_abs, round(max(rel), 6) AS max_rel, count(diff) AS n FROM y")
def oracle_diff(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    o = c.withColumn("v", F.col("v") + F.when(F.col("k") % 7 == 0, F.lit(0.001)).otherwise(0.0))
    t = recap.compare(c, o, "k", "v")
    return t.select("ok", "same_nulls", r6("max_abs", "max_abs"), r6("max_rel", "max_rel"), "n")


LINES = "l AS (SELECT o_orderkey AS depart, CAST(o_custkey % 360 AS BIGINT) AS azimuth, 150e0 + o_custkey % 600 AS length_m, o_totalprice / 100000 AS surface_ha, CAST(o_orderkey % 3 - 1 AS BIGINT) AS direction, CAST(o_orderkey % 4 AS BIGINT) AS supports, o_totalprice / 1000 AS volume_m3, o_totalprice / 1000 / (150e0 + o_custkey % 600) AS ipc FROM orders)"


def cable_lines(spark, d):
    o = table(spark, d, "orders")
    length = F.lit(150.0) + F.col("o_custkey") % 600
    return o.select(F.col("o_orderkey").alias("depart"), (F.col("o_custkey") % 360).alias("azimuth"), length.alias("length_m"), (F.col("o_totalprice") / 100000).alias("surface_ha"), (F.col("o_orderkey") % 3 - 1).alias("direction"), (F.col("o_orderkey") % 4).alias("supports"), (F.col("o_totalprice") / 1000).alias("volume_m3"), (F.col("o_totalprice") / 1000 / length).alias("ipc"))


def choice(**kw):
    from ..functions.config import Selection

    return Selection(weights={"surface": 1, "supports": 0.5, "length": 0.25, "volume": 0.75, "ipc": 0.1}, **kw)


@query("line_score", f"""WITH {LINES}, k AS (SELECT * FROM l WHERE length_m <= 600 AND supports <= 2), m AS (SELECT quantile_cont(surface_ha, 0.98) AS ps, quantile_cont(volume_m3, 0.98) AS pv, quantile_cont(ipc, 0.98) AS pi, max(supports) AS ms, max(length_m) AS ml FROM k),
s AS (SELECT k.*, surface_ha / ps * 1e0 + volume_m3 / pv * 0.75e0 + ipc / pi * 0.1e0 + (1 - supports / ms) * 0.5e0 + (1 - length_m / ml) * 0.25e0 AS score FROM k, m) SELECT depart, azimuth, round(score, 6) AS score FROM s""")
def line_score(spark, d):
    return recap.line_scores(cable_lines(spark, d), choice(length_max=600, supports_max=2)).select("depart", "azimuth", r6("score", "score"))


@query("line_rank", f"WITH {LINES}, m AS (SELECT quantile_cont(surface_ha, 0.98) AS p FROM l), s AS (SELECT l.*, surface_ha / p * 1e0 AS score FROM l, m) SELECT depart, azimuth, row_number() OVER (ORDER BY CASE WHEN direction = 1 THEN 0 ELSE 1 END, round(score, 9) DESC, depart, azimuth) AS rank FROM s")
def line_rank(spark, d):
    from ..functions.config import Selection

    return recap.line_scores(cable_lines(spark, d), Selection(direction=1)).select("depart", "azimuth", long("rank", "rank"))


@query("budget_conversion", "WITH e AS (SELECT o_orderkey AS id, o_totalprice AS length_m, o_orderstatus = 'F' AS z FROM orders), s AS (SELECT *, sum(length_m) OVER (ORDER BY z DESC, length_m DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e) SELECT id, round(length_m, 2) AS length_m, coalesce(before, 0) < 1e8 AS converted FROM s")
def budget_conversion(spark, d):
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("length_m"), (F.col("o_orderstatus") == "F").alias("z"))
    return recap.convert_until(e, 1e8, F.col("z")).select("id", F.round("length_m", 2).alias("length_m"), "converted")


@query("threshold_sweep", "SELECT t AS threshold, count(*) FILTER (s >= t) AS n, round(coalesce(sum(v) FILTER (s >= t), 0) / 1000, 4) AS km, round(coalesce(sum(v / 2) FILTER (s >= t), 0) / 1000, 4) AS overlap_km, CASE WHEN count(*) FILTER (s >= t) > 0 THEN round(100 * (coalesce(sum(v / 2) FILTER (s >= t), 0) / 1000) / (sum(v) FILTER (s >= t) / 1000), 4) END AS overlap_pct FROM (SELECT (o_orderkey % 100) / 100e0 AS s, o_totalprice AS v FROM orders), (VALUES (0.4e0), (0.5e0), (0.6e0), (0.7e0), (0.8e0)) x(t) GROUP BY t")
def threshold_sweep(spark, d):
    s = table(spark, d, "orders").select((F.col("o_orderkey") % 100 / F.lit(100.0)).alias("score"), F.col("o_totalprice").alias("length_m"), (F.col("o_totalprice") / 2).alias("overlap_m"))
    t = recap.threshold_sweep(s, (0.4, 0.5, 0.6, 0.7, 0.8))
    return t.select("threshold", "n", F.round("km", 4).alias("km"), F.round("overlap_km", 4).alias("overlap_km"), F.round("overlap_pct", 4).alias("overlap_pct"))


# propagation and connectivity

STEP = "CASE WHEN a.r <> b.r AND a.c <> b.c THEN 5 * 1.4142135623730951e0 ELSE 5e0 END"
ARCS = "arc AS MATERIALIZED (SELECT a.cell AS u, b.cell AS v, b.w * ({step}) AS w FROM m a JOIN m b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND a.cell <> b.cell WHERE b.w IS NOT NULL AND (a.w IS NOT NULL OR a.src IS NOT NULL))"


def dijkstra_sql(model: str, cap: str = "CAST('inf' AS DOUBLE)") -> str:
    """CTEs ending in d(cell, cost, alloc) from a model m(cell, r, c, w, src): w the price, null impassable."""
    arcs = ARCS.format(step=STEP)
    return f"""WITH RECURSIVE {model}, {arcs},
d(cell, cost, alloc) USING KEY (cell) AS (
  SELECT cell, 0e0, src FROM m WHERE src IS NOT NULL
  UNION
  SELECT n.cell, n.k.cost, n.k.alloc FROM (SELECT arc.v AS cell, min({{'cost': d.cost + arc.w, 'alloc': d.alloc}}) AS k FROM d JOIN arc ON arc.u = d.cell GROUP BY arc.v) n
  LEFT JOIN recurring.d o ON o.cell = n.cell
  WHERE n.k.cost <= {cap} AND (o.cell IS NULL OR n.k.cost < o.cost OR (n.k.cost = o.cost AND n.k.alloc < o.alloc)))"""


COST_M = f"{SQL_PREPARED}, m AS (SELECT cell, r, c, CASE WHEN {DRIVE} OR coalesce(road <> 4, false) THEN sqrt(1 + pow(slope_pct / 100, 2)) + CASE WHEN obstacle THEN 1000 ELSE 0 END END AS w, CASE WHEN coalesce(road <> 4, false) THEN cell END AS src FROM p)"


def cost_model(spark, d, cap=float("inf"), tile=TILE):
    zone = algebra.drivable_ground(CONFIG) | algebra.delivers()
    return propagation.propagate(prepared(spark, d), algebra.drive_cost(CONFIG), F.when(algebra.delivers(), F.col("cell") + 1), zone, cap, RES, tile)


@query("cost_distance", f"{dijkstra_sql(COST_M)} SELECT cell, round(cost, 6) AS cost, alloc FROM d")
def cost_distance(spark, d):
    return cost_model(spark, d).select("cell", r6("cost", "cost"), (F.col("alloc") - 1).alias("alloc"))


@query("cost_distance_tiled", f"{dijkstra_sql(COST_M)} SELECT cell, round(cost, 6) AS cost, alloc FROM d")
def cost_distance_tiled(spark, d):
    """The same labels from tiles of 25 cells that wake each other."""
    return cost_model(spark, d, tile=25).select("cell", r6("cost", "cost"), (F.col("alloc") - 1).alias("alloc"))


@query("cost_distance_capped", f"{dijkstra_sql(COST_M, '50')} SELECT cell, round(cost, 6) AS cost, alloc FROM d")
def cost_distance_capped(spark, d):
    return cost_model(spark, d, 50).select("cell", r6("cost", "cost"), (F.col("alloc") - 1).alias("alloc"))


NET_M = f"{SQL_PREPARED}, m AS (SELECT cell, r, c, CASE WHEN road IS NOT NULL THEN sqrt(1 + pow(coalesce(slope_pct, 0) / 100, 2)) END AS w, CASE WHEN road <> 2 THEN cell END AS src FROM p)"


@query("network_distance", f"{dijkstra_sql(NET_M)} SELECT p.cell, round(coalesce(cost, 0), 6) AS distance, cost IS NULL AS unreachable FROM p LEFT JOIN d USING (cell) WHERE road IS NOT NULL")
def network_distance(spark, d):
    weight = scalars.slope_weight(F.coalesce("slope_pct", F.lit(0.0)))
    return propagation.network_distance(prepared(spark, d), weight, RES).select("cell", r6("distance", "distance"), "unreachable")


GEO_M = f"{SQL_GRID}, m AS (SELECT cell, r, c, CASE WHEN NOT obstacle AND NOT partial THEN 1e0 END AS w, CASE WHEN cell % 61 = 7 THEN cell END AS src FROM g)"


@query("geodesic_distance", f"{dijkstra_sql(GEO_M, '150')} SELECT cell, round(cost, 6) AS distance FROM d")
def geodesic_distance(spark, d):
    ok = ~F.col("obstacle") & ~F.col("partial")
    return propagation.propagate(grid(spark, d), F.lit(1.0), F.when(F.col("cell") % 61 == 7, F.col("cell") + 1), ok, 150, RES).select("cell", r6("cost", "distance"))


COMPONENTS = """k(cell, lab) USING KEY (cell) AS (
  SELECT cell, cell FROM m WHERE ok UNION
  SELECT n.cell, n.lab FROM (SELECT b.cell, min(k.lab) AS lab FROM k JOIN m a ON a.cell = k.cell JOIN m b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE b.ok GROUP BY b.cell) n
  JOIN recurring.k o ON o.cell = n.cell WHERE n.lab < o.lab)"""
OPEN = "size % 3 <> 0 AND size < 40"


@query("components_labelled", f"WITH RECURSIVE {SQL_GRID}, m AS MATERIALIZED (SELECT cell, r, c, {OPEN} AS ok FROM g), {COMPONENTS} SELECT cell, lab AS component FROM k")
def components_labelled(spark, d):
    return propagation.label_components(grid(spark, d), F.expr(OPEN))


@query("components_seeded", f"WITH RECURSIVE {SQL_GRID}, m AS MATERIALIZED (SELECT cell, r, c, {OPEN} AS ok FROM g), {COMPONENTS} SELECT cell FROM k WHERE lab IN (SELECT lab FROM k JOIN g USING (cell) WHERE road = 1)")
def components_seeded(spark, d):
    return propagation.reached(grid(spark, d), F.expr(OPEN), algebra.road_is("main"))


@query("trace_path", f"""{dijkstra_sql(COST_M)}, e AS (SELECT arc.v AS cell, min(arc.u) AS pred FROM arc JOIN d a ON a.cell = arc.u JOIN d b ON b.cell = arc.v WHERE a.cost + arc.w = b.cost AND a.alloc = b.alloc AND b.cost > 0 GROUP BY arc.v),
t(target, hop, cell) AS (SELECT cell, 0, cell FROM d UNION ALL SELECT target, hop + 1, pred FROM t JOIN e USING (cell)) SELECT target, CAST(hop AS BIGINT) AS hop, cell FROM t""")
def trace_path(spark, d):
    from ..sources.scratch import written

    labels = written(cost_model(spark, d), "labels")
    return propagation.trace(labels, labels)


ZONE_ONE = "size % 3 <> 0"


@query("zone_connected", f"""WITH RECURSIVE {SQL_PREPARED}, b AS MATERIALIZED (SELECT cell, r, c, {DRIVE} AS ground, forest, coalesce(road <> 4, false) AS road, sqrt(1 + pow(slope_pct / 100, 2)) + CASE WHEN obstacle THEN 1000 ELSE 0 END AS w FROM p),
a1(cell) AS (SELECT cell FROM b WHERE road UNION SELECT y.cell FROM a1 JOIN b x ON x.cell = a1.cell JOIN b y ON y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1 WHERE (y.ground AND y.forest) OR y.road),
edge AS (SELECT b.cell FROM b JOIN a1 USING (cell) JOIN b y ON y.r BETWEEN b.r - 1 AND b.r + 1 AND y.c BETWEEN b.c - 1 AND b.c + 1 JOIN a1 z ON z.cell = y.cell GROUP BY b.cell HAVING count(*) < 9),
m AS MATERIALIZED (SELECT b.cell, b.r, b.c, CASE WHEN ground AND a1.cell IS NULL THEN w END AS w, edge.cell AS src FROM b LEFT JOIN a1 USING (cell) LEFT JOIN edge USING (cell)), {ARCS.format(step=STEP)},
d(cell, cost) USING KEY (cell) AS (SELECT cell, 0e0 FROM m WHERE src IS NOT NULL UNION SELECT n.cell, n.cost FROM (SELECT arc.v AS cell, min(d.cost + arc.w) AS cost FROM d JOIN arc ON arc.u = d.cell GROUP BY arc.v) n LEFT JOIN recurring.d o ON o.cell = n.cell WHERE n.cost <= 50 AND (o.cell IS NULL OR n.cost < o.cost)),
a2 AS MATERIALIZED (SELECT cell FROM a1 UNION SELECT cell FROM d),
a3(cell) AS (SELECT cell FROM a2 UNION SELECT y.cell FROM a3 JOIN b x ON x.cell = a3.cell JOIN b y ON y.r BETWEEN x.r - 1 AND x.r + 1 AND y.c BETWEEN x.c - 1 AND x.c + 1 WHERE (y.ground AND y.forest) OR y.cell IN (SELECT cell FROM a2))
SELECT cell FROM a3 UNION SELECT cell FROM b WHERE road""")
def zone_connected(spark, d):
    p = prepared(spark, d)
    return propagation.zone_connected(p, algebra.drivable_ground(CONFIG), F.col("forest"), algebra.delivers(), algebra.drive_cost(CONFIG), CONFIG.skidder.off_road_max_m, RES)


WINDOW = "r BETWEEN 0 AND 20 AND c BETWEEN 8 AND 30"


@query("border_certificate", f"""WITH RECURSIVE {SQL_PREPARED}, q AS (SELECT *, {DRIVE} OR coalesce(road <> 4, false) AS ok, sqrt(1 + pow(slope_pct / 100, 2)) + CASE WHEN obstacle THEN 1000 ELSE 0 END AS price1, c = 8 OR c = 30 OR r = 20 AS border FROM p WHERE {WINDOW}),
m AS MATERIALIZED (SELECT cell, r, c, CASE WHEN ok THEN price1 END AS w, CASE WHEN coalesce(road <> 4, false) THEN cell END AS src FROM q),
arc AS MATERIALIZED (SELECT a.cell AS u, b.cell AS v, b.w * ({STEP}) AS w FROM m a JOIN m b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND a.cell <> b.cell WHERE b.w IS NOT NULL),
i(cell, cost) USING KEY (cell) AS (SELECT cell, 0e0 FROM m WHERE src IS NOT NULL UNION SELECT n.cell, n.cost FROM (SELECT arc.v AS cell, min(i.cost + arc.w) AS cost FROM i JOIN arc ON arc.u = i.cell GROUP BY arc.v) n LEFT JOIN recurring.i o ON o.cell = n.cell WHERE o.cell IS NULL OR n.cost < o.cost),
e(cell, cost) USING KEY (cell) AS (SELECT cell, 0e0 FROM q WHERE border AND ok UNION SELECT n.cell, n.cost FROM (SELECT arc.v AS cell, min(e.cost + arc.w) AS cost FROM e JOIN arc ON arc.u = e.cell GROUP BY arc.v) n LEFT JOIN recurring.e o ON o.cell = n.cell WHERE o.cell IS NULL OR n.cost < o.cost),
x AS (SELECT q.cell, coalesce(i.cost, CAST('inf' AS DOUBLE)) AS a, coalesce(e.cost, CAST('inf' AS DOUBLE)) AS b FROM q LEFT JOIN i USING (cell) LEFT JOIN e USING (cell))
SELECT cell, a <= b AS certified, a < b OR (a = b AND a = CAST('inf' AS DOUBLE)) AS certified_alloc FROM x""")
def border_certificate(spark, d):
    p = prepared(spark, d).where(WINDOW)
    zone = algebra.drivable_ground(CONFIG) | algebra.delivers()
    labels = propagation.propagate(p, algebra.drive_cost(CONFIG), F.when(algebra.delivers(), F.col("cell") + 1), zone, res=RES)
    border = (F.col("c") == 8) | (F.col("c") == 30) | (F.col("r") == 20)
    return propagation.certificate(p, labels, algebra.drive_cost(CONFIG), zone, border, res=RES)


# ray sweeps, in all 360 directions; the statements draw the rays by their own rules


def straight_sql(reach: float) -> str:
    """Places every third of a cell along each azimuth, rounded half to even, each once in a row."""
    limit = reach + 1.5 * RES
    return f"""k0 AS (SELECT az, k, k * ({RES!r}e0 / 3) AS t FROM range(0, 360) a(az), range(1, {int(limit / RES * 3) + 3}) b(k)),
k1 AS (SELECT az, k, CAST(round_even(-t * cos(radians(az)) / {RES!r}e0, 0) AS BIGINT) AS dr, CAST(round_even(t * sin(radians(az)) / {RES!r}e0, 0) AS BIGINT) AS dc FROM k0 WHERE t <= {limit!r}e0 + 1e-9),
k2 AS (SELECT *, coalesce(lag(dr) OVER w, 0) AS br, coalesce(lag(dc) OVER w, 0) AS bc, {RES!r}e0 * sqrt(dr * dr + dc * dc) AS hd FROM k1 WINDOW w AS (PARTITION BY az ORDER BY k)),
ray AS (SELECT az, row_number() OVER (PARTITION BY az ORDER BY k) AS step, dr, dc, hd FROM k2 WHERE (dr <> br OR dc <> bc) AND hd <= {limit!r}e0)"""


def connected_sql(reach: float) -> str:
    """Every cell that an azimuth's line crosses: the nearer border first, on a corner the row."""
    limit = reach + 1.5 * RES
    return f"""k0 AS (SELECT az, sin(radians(az)) AS x, -cos(radians(az)) AS y FROM range(0, 360) a(az)),
k1 AS (SELECT *, CASE WHEN x = 0 THEN CAST('inf' AS DOUBLE) ELSE 1 / abs(x) END AS pc, CASE WHEN y = 0 THEN CAST('inf' AS DOUBLE) ELSE 1 / abs(y) END AS pr FROM k0),
k2(az, step, dr, dc, nr, nc) AS (SELECT az, 0, 0, 0, 0.5e0 * pr, 0.5e0 * pc FROM k1 UNION ALL
SELECT k2.az, step + 1, CASE WHEN nc < nr THEN dr ELSE dr + CASE WHEN y > 0 THEN 1 ELSE -1 END END, CASE WHEN nc < nr THEN dc + CASE WHEN x > 0 THEN 1 ELSE -1 END ELSE dc END, CASE WHEN nc < nr THEN nr ELSE nr + pr END, CASE WHEN nc < nr THEN nc + pc ELSE nc END
FROM k2 JOIN k1 USING (az) WHERE {RES!r}e0 * sqrt(dr * dr + dc * dc) <= {limit!r}e0),
ray AS MATERIALIZED (SELECT az, step, dr, dc, {RES!r}e0 * sqrt(dr * dr + dc * dc) AS hd FROM k2 WHERE step > 0 AND {RES!r}e0 * sqrt(dr * dr + dc * dc) <= {limit!r}e0)"""


MET = "t0 AS (SELECT q.src, q.z0, az, step, hd, g2.* FROM q, ray JOIN p g2 ON g2.r = q.r0 + dr AND g2.c = q.c0 + dc)"
SRC = "q AS (SELECT cell AS src, r AS r0, c AS c0, z AS z0 FROM p WHERE coalesce(road <> 4, false))"
W_ALL = "OVER (PARTITION BY src, az ORDER BY step ROWS UNBOUNDED PRECEDING)"
W_BEFORE = "OVER (PARTITION BY src, az ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def sources(p: DataFrame) -> DataFrame:
    return p.where(algebra.delivers()).select(F.col("cell").alias("src"), F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("z").alias("z0"), F.lit(0.0).alias("start"))


def best_sql(live: str) -> str:
    return f"b AS (SELECT cell, min({{'t': d3, 'az': az, 'step': step, 'back': -src}}) AS k FROM {live} GROUP BY cell), f AS (SELECT cell, k.t AS distance, -k.back AS alloc FROM b WHERE cell NOT IN (SELECT src FROM q) UNION ALL SELECT src, 0e0, src FROM q) SELECT cell, round(distance, 6) AS distance, alloc FROM f"


@query("winch_sweep", f"""WITH {SQL_PREPARED}, {SRC}, {straight_sql(100)}, {MET},
t1 AS (SELECT *, z - z0 AS dz, (z - z0) / hd AS s, sqrt(hd * hd + (z - z0) * (z - z0)) AS d3 FROM t0), t2 AS (SELECT *, coalesce(max((dz - 10) / hd) {W_BEFORE}, CAST('-inf' AS DOUBLE)) AS lo, coalesce(min((dz - 10 + 30) / hd) {W_BEFORE}, CAST('inf' AS DOUBLE)) AS hi FROM t1),
t3 AS (SELECT *, min(CAST({WINCH} AND s BETWEEN lo AND hi AND (d3 <= 50 OR d3 <= CASE WHEN s <= {LAW.down}e0 THEN 100e0 WHEN s > {LAW.up}e0 THEN 50e0 ELSE {LAW.base!r}e0 / (1 - {LAW.coeff!r}e0 * s / sqrt(1 + pow(s, 2))) END) AS INT)) {W_ALL} AS live FROM t2),
t4 AS (SELECT * FROM t3 WHERE live = 1), {best_sql('t4')}""")
def winch_sweep(spark, d):
    p = prepared(spark, d)
    cells = p.withColumn("winchable", algebra.winch_zone(CONFIG))
    return rays.winch(cells, sources(p), CONFIG, RES).select("cell", r6("distance", "distance"), "alloc")


@query("forwarder_sweep", f"""WITH {SQL_PREPARED}, {SRC}, {straight_sql(300)}, {MET},
t1 AS (SELECT *, sqrt(hd * hd + (z - z0) * (z - z0)) AS d3, degrees(atan(slope_pct / 100)) AS deg, degrees(atan(0.15e0)) AS lat FROM t0), t2 AS (SELECT *, CASE WHEN deg > lat THEN d3 - coalesce(lag(d3) OVER (PARTITION BY src, az ORDER BY step), 0) ELSE 0 END AS walked,
cos((90 - (((az - aspect_deg) % 180e0) + 180e0) % 180e0) / 180 * 3.141592653589793e0) AS ct FROM t1), t3 AS (SELECT *, sum(walked) {W_ALL} AS steep FROM t2),
t4 AS (SELECT *, min(CAST(coalesce(forest AND NOT obstacle AND NOT public AND deg <= CASE WHEN z > z0 THEN degrees(atan(0.25e0)) ELSE degrees(atan(0.3e0)) END AND (aspect_deg IS NULL OR ct = 0 OR deg <= abs(lat / ct)) AND steep <= 300, false) AS INT)) {W_ALL} AS live FROM t3),
t5 AS (SELECT * FROM t4 WHERE live = 1), {best_sql('t5')}""")
def forwarder_sweep(spark, d):
    p = prepared(spark, d)
    cells = p.withColumn("drivable", F.col("forest") & ~F.col("obstacle") & ~F.col("public"))
    return rays.forward(cells, sources(p), CONFIG, RES).select("cell", r6("distance", "distance"), "alloc")


@query("hose_sweep", f"""WITH RECURSIVE {SQL_PREPARED}, {SRC}, {connected_sql(440)}, {MET},
t1 AS (SELECT *, sqrt(pow(z - coalesce(lag(z) OVER o, z0), 2) + pow(hd - coalesce(lag(hd) OVER o, 0), 2)) AS piece FROM t0 WINDOW o AS (PARTITION BY src, az ORDER BY step)), t2 AS (SELECT *, sum(piece) {W_ALL} AS laid FROM t1),
t3 AS (SELECT *, min(CAST(NOT obstacle AND coalesce(slope_pct <= 110, false) AND laid <= 440 AS INT)) {W_ALL} AS live FROM t2), t4 AS (SELECT *, CAST(floor(laid * 100 + 0.5e0) AS BIGINT) AS cm, CASE WHEN z < z0 THEN ceil(z - z0 - 0.5e0) ELSE floor(z - z0 + 0.5e0) END AS rise FROM t3 WHERE live = 1),
b AS (SELECT cell, min({{'cm': cm, 'src': src, 'az': az, 'step': step, 'rise': rise}}) AS k FROM t4 GROUP BY cell), own AS (SELECT DISTINCT src AS cell FROM t4),
f AS (SELECT cell, k.cm AS cm, k.src AS alloc, k.rise AS rise FROM b WHERE cell NOT IN (SELECT cell FROM own) UNION ALL SELECT cell, 0, cell, 0e0 FROM own)
SELECT cell, floor(cm / 100 + 0.5e0) AS distance, alloc, rise + 0e0 AS rise FROM f JOIN p USING (cell) WHERE forest""")
def hose_sweep(spark, d):
    p = prepared(spark, d)
    cells = p.withColumn("usable", ~F.col("obstacle") & F.coalesce(F.col("slope_pct") <= CONFIG.fire.slope_max_pct, F.lit(False)))
    return rays.hose(cells, sources(p), CONFIG.fire.reach_m, RES).select("cell", "distance", "alloc", (F.col("rise") + 0.0).alias("rise"))
