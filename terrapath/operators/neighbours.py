"""Neighbouring cells without joins.

A grid is a table of cells (cell, r, c, layers...), r and c counted from 0. `stencil` deals cells to tiles of
`tile` x `tile`, border cells also to the tiles they touch, in one shuffle; window functions within a tile
then look along rows and along columns. The tile key is part of both window keys, so nothing moves twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Name, row offset and column offset of the eight neighbours.
EIGHT = (("nw", -1, -1), ("n", -1, 0), ("ne", -1, 1), ("w", 0, -1), ("e", 0, 1), ("sw", 1, -1), ("s", 1, 0), ("se", 1, 1))
TILE = 256


def with_halo(cells: DataFrame, tile: int = TILE, halo: int = 1) -> DataFrame:
    """cells with (tr, tc, own): each cell once in its own tile and once in every tile within `halo` cells."""
    at = lambda x, d: F.floor((F.col(x) + d) / tile)
    tiles = F.array_distinct(F.array(*[F.struct(at("r", a * halo).alias("tr"), at("c", b * halo).alias("tc")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    out = cells.withColumn("__t", F.explode(tiles))
    own = (F.col("__t.tr") == at("r", 0)) & (F.col("__t.tc") == at("c", 0))
    return out.withColumns({"tr": F.col("__t.tr"), "tc": F.col("__t.tc"), "own": own}).drop("__t")


def stencil(cells: DataFrame, layers: list[str], tile: int = TILE) -> DataFrame:
    """cells plus, per layer, columns layer_nw ... layer_se (null outside the grid) and the booleans in_nw ... in_se."""
    t = with_halo(cells, tile).repartition("tr", "tc")
    row = Window.partitionBy("tr", "tc", "r").orderBy("c")
    col = Window.partitionBy("tr", "tc", "c").orderBy("r")
    pack = F.struct("c", *layers)
    t = t.withColumn("__o", pack)
    t = t.withColumns({"__w": F.lag("__o").over(row), "__e": F.lead("__o").over(row)})
    t = t.withColumns({"__w": F.when(F.col("__w.c") == F.col("c") - 1, F.col("__w")), "__e": F.when(F.col("__e.c") == F.col("c") + 1, F.col("__e"))})
    t = t.withColumn("__line", F.struct("r", F.col("__w").alias("w"), F.col("__o").alias("o"), F.col("__e").alias("e")))
    t = t.withColumns({"__n": F.lag("__line").over(col), "__s": F.lead("__line").over(col)})
    t = t.withColumns({"__n": F.when(F.col("__n.r") == F.col("r") - 1, F.col("__n")), "__s": F.when(F.col("__s.r") == F.col("r") + 1, F.col("__s"))})
    place = {
        "nw": "__n.w", "n": "__n.o", "ne": "__n.e", "w": "__w", "e": "__e", "sw": "__s.w", "s": "__s.o", "se": "__s.e",
    }
    out = {}
    for name, _, _ in EIGHT:
        out[f"in_{name}"] = F.col(place[name]).isNotNull()
        for x in layers:
            out[f"{x}_{name}"] = F.col(f"{place[name]}.{x}")
    return t.withColumns(out).where("own").drop("__o", "__w", "__e", "__n", "__s", "__line", "tr", "tc", "own")


def focal(cells: DataFrame, layer: str, how: str, name: str, tile: int = TILE) -> DataFrame:
    """3 x 3 aggregate of a layer, the cell included, nulls left out: max, min, sum or count."""
    s = stencil(cells, [layer], tile)
    parts = [F.col(layer), *[F.col(f"{layer}_{n}") for n, _, _ in EIGHT]]
    if how in ("max", "min"):
        value = (F.greatest if how == "max" else F.least)(*parts)
    elif how == "sum":
        value = sum((F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts), F.lit(0.0))
    else:
        value = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return s.withColumn(name, value).select(*cells.columns, name)


def inner_contour(cells: DataFrame, mask: str, name: str = "contour", tile: int = TILE) -> DataFrame:
    """Whether a cell of the mask has a neighbour outside it; the grid's edge counts as outside."""
    s = stencil(cells, [mask], tile)
    full = F.lit(True)
    for n, _, _ in EIGHT:
        full = full & F.coalesce(F.col(f"{mask}_{n}"), F.lit(False))
    return s.withColumn(name, F.col(mask) & ~full).select(*cells.columns, name)


def disc_offsets(radius: float, res: float) -> list[tuple[int, int, float]]:
    """(dr, dc, distance) of all cells within a radius."""
    n = int(radius / res)
    found = [(a, b, res * (a * a + b * b) ** 0.5) for a in range(-n, n + 1) for b in range(-n, n + 1)]
    return [x for x in found if x[2] <= radius + 1e-9]


def disc_mean(cells: DataFrame, layer: str, radius: float, res: float, name: str) -> DataFrame:
    """Mean of a layer over all places within a radius (cells that are null or missing count as 0); the layer itself below
    one cell.

    Each cell adds to its neighbours; partial sums are combined before the shuffle."""
    value = F.coalesce(F.col(layer).cast("double"), F.lit(0.0))
    if radius < res:
        return cells.withColumn(name, value)
    disc = disc_offsets(radius, res)
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _ in disc])
    spread = cells.select("r", "c", value.alias("v"), F.explode(offsets).alias("o")).select((F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"), "v")
    return cells.join(spread.groupBy("r", "c").agg((F.sum("v") / len(disc)).alias(name)), ["r", "c"], "left").select(*cells.columns, name)


def pyramid(cells: DataFrame, layer: str, factor: int) -> DataFrame:
    """Block means of a layer on a grid `factor` times coarser."""
    return cells.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg(layer).alias(layer), F.count(layer).alias("cells"))


def numbered(points: DataFrame) -> DataFrame:
    """points with a number per row, written so that all branches of a plan see the same."""
    from ..sources.scratch import written

    return written(points.withColumn("__id", F.monotonically_increasing_id()), "numbered")


def sample(cells: DataFrame, points: DataFrame, layer: str, res: float, how: str = "nearest") -> DataFrame:
    """points (x, y, ...) with the layer's value there: of the cell they lie in, or bilinear between cell centres."""
    grid = cells.select("r", "c", F.col(layer).alias("__v"))
    if how == "nearest":
        at = points.withColumns({"r": F.floor(F.col("y") / res).cast("long"), "c": F.floor(F.col("x") / res).cast("long")})
        return at.join(grid, ["r", "c"], "left").withColumnRenamed("__v", layer).drop("r", "c")
    p = numbered(points)
    fx, fy = F.col("x") / res - 0.5, F.col("y") / res - 0.5
    p = p.withColumns({"__c": F.floor(fx).cast("long"), "__r": F.floor(fy).cast("long"), "__u": fx - F.floor(fx), "__w": fy - F.floor(fy)})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    wide = p.withColumn("__k", corner)
    wide = wide.withColumns({"r": F.col("__r") + F.col("__k.a"), "c": F.col("__c") + F.col("__k.b")})
    weight = F.when(F.col("__k.a") == 1, F.col("__w")).otherwise(1 - F.col("__w")) * F.when(F.col("__k.b") == 1, F.col("__u")).otherwise(1 - F.col("__u"))
    hit = wide.withColumn("__g", weight).where("__g > 0").join(grid, ["r", "c"], "left")
    value = hit.groupBy("__id").agg(F.when(F.count("*") == F.count("__v"), F.sum(F.col("__v") * F.col("__g"))).alias(layer))
    return p.select("__id", *points.columns).join(value, "__id", "left").drop("__id")
