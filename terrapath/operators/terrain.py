"""Slope, aspect and hillshade from elevation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import EIGHT, TILE, stencil


def gradient(z: str, method: str, res: float) -> tuple[Column, Column]:
    """(east, north) rise per metre; null where a neighbour is missing. Rows count southward."""
    at = lambda n: F.col(f"{z}_{n}")
    if method == "horn":
        east = ((at("ne") + 2 * at("e") + at("se")) - (at("nw") + 2 * at("w") + at("sw"))) / (8 * res)
        north = ((at("nw") + 2 * at("n") + at("ne")) - (at("sw") + 2 * at("s") + at("se"))) / (8 * res)
        return east, north
    if method == "four":
        return (at("e") - at("w")) / (2 * res), (at("n") - at("s")) / (2 * res)
    raise ValueError(f"no slope method {method!r}")


def slope_aspect(cells: DataFrame, z: str = "z", res: float = 5.0, method: str = "horn", tile: int = TILE) -> DataFrame:
    """cells plus slope_pct and aspect_deg (clockwise from north, where the ground falls to).

    Border cells have neither; slopes under 1e-9 rad are 0; flat cells have no aspect."""
    s = stencil(cells, [z], tile)
    if method == "horn":
        whole = F.lit(True)
        for n, _, _ in EIGHT:
            whole = whole & F.col(f"in_{n}")
    else:
        whole = F.col("in_n") & F.col("in_s") & F.col("in_e") & F.col("in_w")
    east, north = gradient(z, method, res)
    steep = F.sqrt(F.pow(east, 2) + F.pow(north, 2))
    rad = F.atan(steep)
    slope = F.when(whole, F.when(rad < 1e-9, F.lit(0.0)).otherwise(100 * steep))
    aspect = F.when(whole & (rad >= 1e-9), F.pmod(F.degrees(F.atan2(-east, -north)), F.lit(360.0)))
    return s.withColumns({"slope_pct": slope, "aspect_deg": aspect}).select(*cells.columns, "slope_pct", "aspect_deg")


def edge_gradient(cells: DataFrame, z: str, res: float, tile: int = TILE) -> DataFrame:
    """cells plus (dzdx, dzdy) by central differences; a missing neighbour takes the cell's own elevation."""
    s = stencil(cells, [z], tile)
    own = F.col(z)
    at = lambda n: F.coalesce(F.col(f"{z}_{n}"), own)
    return s.withColumns({"dzdx": (at("e") - at("w")) / (2 * res), "dzdy": (at("n") - at("s")) / (2 * res)}).select(*cells.columns, "dzdx", "dzdy")


def hillshade(cells: DataFrame, z: str = "z", res: float = 5.0, azimuth: float = 315, elevation: float = 35, name: str = "hillshade", tile: int = TILE) -> DataFrame:
    """Cosine of the angle between the ground's normal and the sun, not below 0."""
    g = edge_gradient(cells, z, res, tile)
    a, e = math.radians(azimuth), math.radians(elevation)
    east, north = math.sin(a) * math.cos(e), math.cos(a) * math.cos(e)
    lit = (F.lit(math.sin(e)) - F.col("dzdx") * F.lit(east) - F.col("dzdy") * F.lit(north)) / F.sqrt(1 + F.pow("dzdx", 2) + F.pow("dzdy", 2))
    return g.withColumn(name, F.when(lit.isNotNull(), F.greatest(lit, F.lit(0.0)))).select(*cells.columns, name)
