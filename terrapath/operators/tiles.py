"""Tile plans, and engines run tile by tile under a growing halo."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written


def tile_plan(spark: SparkSession, rows: int, columns: int, res: float, tile_m: float, halo_m: float = 0) -> DataFrame:
    """A row per tile: id, write window r1..r2, c1..c2, halo window hr1..hc2 (0-based, inclusive) and which of the halo
    window's sides are open, that is, short of the grid's edge."""
    t, h = max(1, math.ceil(tile_m / res)), math.ceil(halo_m / res)
    across = math.ceil(columns / t)
    p = spark.range(math.ceil(rows / t) * across).select((F.col("id") + 1).alias("id"), (F.floor(F.col("id") / across) * t).alias("r1"), (F.col("id") % across * t).alias("c1"))
    p = p.withColumns({"r2": F.least(F.col("r1") + t - 1, F.lit(rows - 1)), "c2": F.least(F.col("c1") + t - 1, F.lit(columns - 1))})
    p = p.withColumns({"hr1": F.greatest(F.col("r1") - h, F.lit(0)), "hr2": F.least(F.col("r2") + h, F.lit(rows - 1)), "hc1": F.greatest(F.col("c1") - h, F.lit(0)), "hc2": F.least(F.col("c2") + h, F.lit(columns - 1))})
    return p.withColumns({"open_top": F.col("hr1") > 0, "open_bottom": F.col("hr2") < rows - 1, "open_left": F.col("hc1") > 0, "open_right": F.col("hc2") < columns - 1})


def halo_overhead(plan: DataFrame) -> DataFrame:
    """One row: cells computed per cell written."""
    size = lambda a, b: F.col(b) - F.col(a) + 1
    return plan.agg((F.sum(size("hr1", "hr2") * size("hc1", "hc2")) / F.sum(size("r1", "r2") * size("c1", "c2"))).alias("overhead"))


def deal(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """cells with the tiles whose halo window holds them: (tile, inside, border), border on an open side of the window."""
    p = F.broadcast(plan)  # a row per tile
    t = cells.join(p, F.col("r").between(p["hr1"], p["hr2"]) & F.col("c").between(p["hc1"], p["hc2"]))
    border = (F.col("open_top") & (F.col("r") == F.col("hr1"))) | (F.col("open_bottom") & (F.col("r") == F.col("hr2"))) | (F.col("open_left") & (F.col("c") == F.col("hc1"))) | (F.col("open_right") & (F.col("c") == F.col("hc2")))
    own = F.col("r").between(F.col("r1"), F.col("r2")) & F.col("c").between(F.col("c1"), F.col("c2"))
    return t.select(F.col("id").alias("tile"), *cells.columns, own.alias("inside"), border.alias("border"))


def run_by_tiles(cells: DataFrame, engine: Callable[[pd.DataFrame], pd.DataFrame], out: str, rows: int, columns: int, res: float, tile_m: float, halo_m: float, halo_max_m: float) -> DataFrame:
    """An engine over each tile's window; tiles with uncertified cells run again under twice the halo, up to the most.

    engine takes a window's cells (with `border`) and returns columns `out`, among them cell and certified. Tiles
    are independent tasks; only the ids of those not done, as a table, steer the next pass. Cells uncertified at
    the largest halo stay uncertified: doubt is declared, not filed under some class."""
    spark = cells.sparkSession
    todo, result, halo = None, None, halo_m

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        made = engine(pdf)
        return made[made["cell"].isin(pdf.loc[pdf["inside"], "cell"])].assign(tile=pdf["tile"].iloc[0])

    while True:
        plan = tile_plan(spark, rows, columns, res, tile_m, halo)
        if todo is not None:
            plan = plan.join(todo, "id", "left_semi")
        made = written(deal(cells, plan).groupBy("tile").applyInPandas(task, f"{out}, tile long"), "tiles")
        open_tiles = made.where("not certified").select(F.col("tile").alias("id")).distinct()
        last = halo >= halo_max_m or not open_tiles.limit(1).count()
        done = made if last else made.join(open_tiles, made["tile"] == open_tiles["id"], "left_anti")
        result = done if result is None else result.unionByName(done)
        if last:
            return result.drop("tile")
        todo, halo = open_tiles, min(halo_max_m, 2 * halo)


def least_cost_engine(res: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """An engine for `run_by_tiles`: least cost from sources, certified where the open border can't undercut it.

    Window columns: cell, r, c, price (nan: impassable), source, border."""
    from .propagation import solve_tile

    def engine(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c, cell = (pdf[x].to_numpy() for x in ("r", "c", "cell"))
        price = pdf["price"].to_numpy(float, na_value=math.nan)

        def solve(start) -> np.ndarray:
            begin = np.where(start, 0.0, math.inf)
            d, s, _ = solve_tile(r, c, cell, price, begin, np.where(start, cell, -1), res, math.inf)
            return np.where(s >= 0, d, math.inf)

        inner = solve(pdf["source"].to_numpy(bool))
        outer = solve(pdf["border"].to_numpy(bool) & ~np.isnan(price))
        return pd.DataFrame({"cell": cell, "cost": np.where(np.isinf(inner), np.nan, inner), "certified": inner <= outer})

    return engine
