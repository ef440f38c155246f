"""Landscapes derived from the driver's tables, once as Spark columns and once as SQL.

The grid has 50 columns of 5 m cells, a cell per part; its layers are simple functions of place and part size.
The strings in GRID read the same in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbours import focal
from ..operators.terrain import slope_aspect

WIDTH, RES = 50, 5.0

GRID = {
    "cell": "CAST(p_partkey AS BIGINT)",
    "r": "CAST(floor(p_partkey / 50) AS BIGINT)",
    "c": "CAST(p_partkey % 50 AS BIGINT)",
    "size": "CAST(p_size AS BIGINT)",
    "price": "p_retailprice",
}
LAYERS = {
    "z": "200e0 + 0.6e0 * r + 0.4e0 * c + 0.04e0 * size + (CASE WHEN c BETWEEN 30 AND 33 THEN (c - 29) * 4e0 ELSE 0e0 END)",
    "forest": "size % 7 <> 0",
    "obstacle": "size >= 49",
    "partial": "size BETWEEN 47 AND 48",
    "public": "c = 48",
    "road": "CASE WHEN c = 48 THEN 4 WHEN (r + c) % 37 = 0 THEN 3 WHEN c = 25 THEN 2 WHEN r % 20 = 5 THEN 1 END",
    "volume": "CASE WHEN size % 11 = 0 THEN NULL ELSE price / 4e0 END",
    "zone": "CAST((floor(r / 10) * 5 + floor(c / 10)) % 25 AS BIGINT)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "part").select(*[F.expr(e).alias(k) for k, e in GRID.items()])
    return base.select("*", *[F.expr(e).alias(k) for k, e in LAYERS.items()])


def prepared(spark: SparkSession, sf_dir: str, method: str = "horn") -> DataFrame:
    """The grid with slope_pct, aspect_deg and slope_max."""
    s = slope_aspect(grid(spark, sf_dir), "z", RES, method)
    # where the cell itself has no slope, it has no local maximum either
    return focal(s, "slope_pct", "max", "slope_max").withColumn("slope_max", F.when(F.col("slope_pct").isNotNull(), F.col("slope_max")))


def _list(parts: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {k}" for k, e in parts.items())


SQL_GRID = f"g0 AS (SELECT {_list(GRID)} FROM part), g AS (SELECT *, {_list(LAYERS)} FROM g0)"

_EIGHT = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def sql_around(source: str, layer: str) -> str:
    """A SELECT of source with layer_nw ... layer_se."""
    cols = ", ".join(f"{k}.{layer} AS {layer}_{k}" for k in _EIGHT)
    joins = " ".join(f"LEFT JOIN {source} {k} ON {k}.r = o.r + ({a}) AND {k}.c = o.c + ({b})" for k, (a, b) in _EIGHT.items())
    return f"SELECT o.*, {cols} FROM {source} o {joins}"


_ALL = " AND ".join(f"z_{k} IS NOT NULL" for k in _EIGHT)
_HORN_E = "((z_ne + 2 * z_e + z_se) - (z_nw + 2 * z_w + z_sw)) / 40e0"
_HORN_N = "((z_nw + 2 * z_n + z_ne) - (z_sw + 2 * z_s + z_se)) / 40e0"


def sql_slope(east: str = _HORN_E, north: str = _HORN_N, whole: str = _ALL) -> str:
    return (
        f"gz AS ({sql_around('g', 'z')}), gg AS (SELECT *, {east} AS gx, {north} AS gy, ({whole}) AS ok FROM gz), "
        "s AS (SELECT * EXCLUDE (gx, gy, ok), CASE WHEN ok THEN CASE WHEN atan(sqrt(pow(gx, 2) + pow(gy, 2))) < 1e-9 THEN 0e0 ELSE 100 * sqrt(pow(gx, 2) + pow(gy, 2)) END END AS slope_pct, "
        "CASE WHEN ok AND atan(sqrt(pow(gx, 2) + pow(gy, 2))) >= 1e-9 THEN (degrees(atan2(-gx, -gy)) + 360e0) % 360e0 END AS aspect_deg FROM gg)"
    )


SQL_PREPARED = (
    f"{SQL_GRID}, {sql_slope()}, sm AS (SELECT a.cell, max(b.slope_pct) AS slope_max FROM s a JOIN s b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.cell), "
    "p AS (SELECT s.*, CASE WHEN s.slope_pct IS NOT NULL THEN slope_max END AS slope_max FROM s JOIN sm USING (cell))"
)
