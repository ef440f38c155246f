"""Checks of the inputs, and the prepared cell table that the engines work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.config import Config
from ..sources.features import plain
from . import vector
from .algebra import ROADS, classify_by_rules, excluded
from .neighbours import TILE, focal
from .terrain import slope_aspect

#: Kept on input for the network's connections, left out of the grid.
OFF_ROAD = "off_road"


def check_inputs(cells: DataFrame, roads: DataFrame, res: float, others: Sequence[DataFrame] = (), crs: Sequence[int | None] = ()) -> None:
    """Raise ValueError unless the grid is dense and square, other layers lie on it, systems agree and road classes are known."""
    if res <= 0:
        raise ValueError("the cell size must be positive")
    if len({c for c in crs if c is not None}) > 1:
        raise ValueError(f"layers in different coordinate systems: {sorted({c for c in crs if c is not None})}")
    n = cells.agg(F.count("*").alias("n"), F.countDistinct("r", "c").alias("d"), F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if not n.n:
        raise ValueError("the grid has no cells")
    if n.n != n.d or n.n != (n[3] - n[2] + 1) * (n[5] - n[4] + 1):
        raise ValueError("the grid is not a dense rectangle with a row per cell")
    for o in others:
        if o.join(cells.select("r", "c"), ["r", "c"], "left_anti").limit(1).count():
            raise ValueError("a layer has cells outside the grid")
    if "class" not in roads.columns:
        raise ValueError(f"roads need a column class; there are {', '.join(roads.columns)}")
    odd = [r[0] for r in roads.where(F.col("class").isNull() | ~F.col("class").isin(*ROADS, OFF_ROAD)).select("class").distinct().limit(5).collect()]
    if odd:
        raise ValueError(f"unknown road classes: {odd}")


def on_road(roads: DataFrame) -> DataFrame:
    """Roads that belong in the grid; to be taken before rasterising."""
    return roads.where(F.col("class").isin(*ROADS))


def drop_real_violations(roads: DataFrame) -> DataFrame:
    """Roads without those that violate the network's rules for real (columns violates and cause)."""
    return roads.where(~F.coalesce(F.col("violates") & (F.col("cause") == "real"), F.lit(False)))


def classify_roads(nature: Column, how: str = "annex", importance: Column | None = None, forest_road: Column | None = None) -> Column:
    """Road class of a topographic database's nature.

    annex: whole labels, named forest roads are main roads, anything else is off_road. importance: key words and
    importance up to 3 is public. words: everything is a main road but for tracks by key words."""
    n = plain(nature)
    has = lambda *words: F.coalesce(F.reduce(F.array(*map(F.lit, words)), F.lit(False), lambda a, w: a | n.contains(w)), F.lit(False))
    if how == "annex":
        rules = [
            (n.isin("route a 2 chaussees", "route a 1 chaussee"), F.lit("public")),
            (n == "route empierree", F.lit("main")),
            (n == "chemin", F.lit("track")),
            (F.coalesce(forest_road if forest_road is not None else F.lit(False), F.lit(False)), F.lit("main")),
        ]
        return classify_by_rules(rules, F.lit(OFF_ROAD))
    if how == "importance":
        big = F.coalesce(importance <= 3, F.lit(False)) if importance is not None else F.lit(False)
        return classify_by_rules([(has("chemin", "sentier", "escalier", "piste cyclable", "bac"), F.lit("track")), (has("autorout") | big, F.lit("public"))], F.lit("main"))
    if how == "words":
        return classify_by_rules([(has("chemin", "sentier", "empierree", "escalier", "piste cyclable"), F.lit("track"))], F.lit("main"))
    raise ValueError(f"no road classification {how!r}")


def rasterise_roads(roads: DataFrame, res: float) -> DataFrame:
    """(r, c, road): the highest class rank among the roads that touch a cell; off_road is left out first."""
    code = F.lit(None).cast("int")
    for name, rank in ROADS.items():
        code = F.when(F.col("class") == name, rank).otherwise(code)
    t = vector.touched_cells(on_road(roads).select(code.alias("road"), "vertices"), res)
    return vector.strongest_class(t, "road")


def prepare(cells: DataFrame, config: Config, res: float = 5.0, roads: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """The cell table with slope_pct, aspect_deg, slope_max and excluded; road from lines if given."""
    out = cells
    if roads is not None:
        out = out.drop("road").join(rasterise_roads(roads, res), ["r", "c"], "left")
    s = slope_aspect(out, "z", res, config.general.slope_method, tile)
    s = focal(s, "slope_pct", "max", "slope_max", tile).withColumn("slope_max", F.when(F.col("slope_pct").isNotNull(), F.col("slope_max")))
    return s.withColumn("excluded", excluded(config))
