"""Medians, clipped polygons, projections, summaries and tensions by grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cable, recap, vector
from .catalogue import Query, r6
from .catalogue_vector import BOX_SQL, parcels
from .inputs import SQL_GRID, grid, table

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("zone_median", f"WITH {SQL_GRID} SELECT zone, round(median(volume), 6) AS median FROM g WHERE volume IS NOT NULL GROUP BY zone")
def zone_median(spark, d):
    return recap.medians(grid(spark, d), "zone", "volume").select("zone", r6("median", "median"))


# a right triangle cut to a box is the triangle above the box's lower corner less those beyond its other corners
@query("clipped_area", f"""WITH {BOX_SQL}, q AS (SELECT id, s - greatest(40 - x, 0e0) - greatest(30 - y, 0e0) AS t, 150 - greatest(x, 40e0) AS w, 120 - greatest(y, 30e0) AS h FROM b),
a AS (SELECT id, CASE WHEN w > 0 AND h > 0 THEN (pow(greatest(t, 0e0), 2) - pow(greatest(t - w, 0e0), 2) - pow(greatest(t - h, 0e0), 2) + pow(greatest(t - w - h, 0e0), 2)) / 2 ELSE 0 END AS area FROM q) SELECT id, round(area, 5) AS area FROM a WHERE area > 0""")
def clipped_area(spark, d):
    return vector.clip(parcels(spark, d), 40, 30, 150, 120).select("id", F.round("area", 5).alias("area"))


# the grid by the formula of snyder's manual: conformal latitudes instead of the isometric ones
LCC_SQL = """k AS (SELECT 6378137e0 AS a, 1e0 / 298.257222101e0 AS f, radians(44e0) AS p1, radians(49e0) AS p2, radians(46.5e0) AS p0),
k1 AS (SELECT *, sqrt(2 * f - f * f) AS e FROM k), k2 AS (SELECT *, cos(p1) / sqrt(1 - pow(e * sin(p1), 2)) AS m1, cos(p2) / sqrt(1 - pow(e * sin(p2), 2)) AS m2,
tan(pi() / 4 - p1 / 2) / pow((1 - e * sin(p1)) / (1 + e * sin(p1)), e / 2) AS t1, tan(pi() / 4 - p2 / 2) / pow((1 - e * sin(p2)) / (1 + e * sin(p2)), e / 2) AS t2, tan(pi() / 4 - p0 / 2) / pow((1 - e * sin(p0)) / (1 + e * sin(p0)), e / 2) AS t0 FROM k1),
k3 AS (SELECT *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS n FROM k2), k4 AS (SELECT *, m1 / (n * pow(t1, n)) AS ff FROM k3)"""


@query("projected_points", f"""WITH {LCC_SQL}, pt AS (SELECT event_id, -4e0 + event_id % 1201 * 0.01e0 AS lon, 42e0 + event_id % 907 * 0.01e0 AS lat FROM events),
r AS (SELECT event_id, a * ff * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat))), e / 2), n) AS rho, a * ff * pow(t0, n) AS rho0, n * radians(lon - 3) AS th FROM pt, k4)
SELECT event_id, round(700000 + rho * sin(th), 3) AS x, round(6600000 + rho0 - rho * cos(th), 3) AS y FROM r""")
def projected_points(spark, d):
    own = F.col("event_id")
    x, y = vector.lambert_conic(F.lit(-4.0) + own % 1201 * F.lit(0.01), F.lit(42.0) + own % 907 * F.lit(0.01))
    return table(spark, d, "events").select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("summary_lines", f"""WITH {SQL_GRID}, n AS (SELECT coalesce(CAST(road AS VARCHAR), 'none') AS class, count(*) * 25 / 10000e0 AS area_ha FROM g GROUP BY 1)
SELECT format('{{}}: {{}} {{:.4f}} ha ({{:.3f}} %)', 'roads', class, area_ha, 100 * area_ha / sum(area_ha) OVER ()) AS line FROM n""")
def summary_lines(spark, d):
    road = F.coalesce(F.col("road").cast("string"), F.lit("none"))
    return recap.summary_lines(grid(spark, d).groupBy(road.alias("class")).agg((F.count("*") * 25 / 10000).alias("area_ha")), "roads")


SPAN_SQL = "sp AS (SELECT s_suppkey AS id, 100e0 + s_suppkey % 7 * 0.4e0 AS lo, 2e7 AS eao, 1500e0 AS w, 5000e0 + s_suppkey % 5 * 100 AS f, 40e0 + s_suppkey % 11 AS s, 85e0 + s_suppkey % 3 AS d, 10e0 + s_suppkey % 13 AS h FROM supplier)"


@query("tension_grid", f"""WITH {SPAN_SQL}, g AS (SELECT sp.*, i * 20e0 AS th, j * 20e0 AS tv FROM sp, range(1, 300) a(i), range(0, 300) b(j)),
c AS (SELECT *, th * lo / eao + th * lo / w * (asinh(tv / th) - asinh((tv - f - w) / th) + asinh((tv - f - w * s / lo) / th) - asinh((tv - w * s / lo) / th)) - d AS gx,
w * lo / eao * (tv / w - 0.5e0) + th * lo / w * (sqrt(1 + pow(tv / th, 2)) - sqrt(1 + pow((tv - f - w) / th, 2)) + f * w / (th * eao) * (s / lo - 1) + sqrt(1 + pow((tv - f - w * s / lo) / th, 2)) - sqrt(1 + pow((tv - w * s / lo) / th, 2))) - h AS gz FROM g),
k AS (SELECT id, th, tv, abs(gx) + abs(gz) AS e FROM c WHERE abs(gx) < 0.05 AND abs(gz) < 0.05), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY e >= 0.03, CASE WHEN e < 0.03 THEN 0 ELSE e END, th, tv) AS rn FROM k)
SELECT sp.id, coalesce(th, -1e0) AS th, coalesce(tv, -1e0) AS tv, coalesce(sqrt(th * th + tv * tv) <= 6000, true) AS feasible FROM sp LEFT JOIN m ON m.id = sp.id AND rn = 1""")
def tension_grid(spark, d):
    k = F.col("s_suppkey")
    f = lambda x: F.lit(float(x))
    spans = table(spark, d, "supplier").select(k.alias("id"), (f(100) + k % 7 * f(0.4)).alias("lo"), f(2e7).alias("eao"), f(1500).alias("w"), (f(5000) + k % 5 * 100).alias("f"), (f(40) + k % 11).alias("s"), (f(85) + k % 3).alias("d"), (f(10) + k % 13).alias("h"))
    return cable.grid_tensions(spans, 6000, 20)
