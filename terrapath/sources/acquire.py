"""A set of layers for a box: from the store where their provenance fits, else fetched, cut and stored."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.neighbours import pyramid
from ..operators.relief import combined_relief
from .layers import FolderStore
from .provenance import differences
from .remote import Box, Unreachable

Fetch = Callable[[Box], DataFrame]


def acquire(box: Box, wanted: Mapping[str, Fetch], store: FolderStore, provenance: dict[str, dict], buffer_m: float = 100, policy: str = "reacquire", params: Mapping | None = None, optional: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """{layer: table}. `provenance` holds what is known of the stored layers, and is brought up to date.

    A layer whose service does not answer fails the call, unless it is optional; then it is missing from the
    result, which is not the same as empty."""
    if policy not in ("reacquire", "accept", "refuse"):
        raise ValueError(f"no policy {policy!r}")
    wide, have, out = box.buffered(buffer_m), set(store.names()), {}
    known = {**(params or {}), "box": [wide.x0, wide.y0, wide.x1, wide.y1]}
    for layer, fetch in wanted.items():
        diff = differences(provenance.get(layer), layer, None, known) if layer in have else ["layer"]
        if layer in have and diff and policy == "refuse":
            raise RuntimeError(f"{layer} was made otherwise: {', '.join(diff)}")
        if layer not in have or diff and policy == "reacquire":
            try:
                store.write(layer, fetch(wide))
            except Unreachable:
                if layer in optional:
                    continue
                raise
            provenance[layer] = {"layer": layer, "source": None, "params": known}
        out[layer] = store.read(layer)
    return out


def coarse_dtm(cells: DataFrame, factor: int, least: float = 0.9) -> DataFrame:
    """Block means of elevation; an error if too little of the grid has any."""
    n = cells.agg(F.count("*").alias("n"), F.sum(F.when(F.col("z").isNotNull() & ~F.isnan("z"), 1).otherwise(0)).alias("ok")).first()
    if not n.n or n.ok < least * n.n:
        raise ValueError(f"{n.ok or 0} of {n.n} cells have an elevation")
    return pyramid(cells, "z", factor)


def precomputed_relief(store: FolderStore, r0: int, r1: int, c0: int, c1: int, fetch: Callable[[], DataFrame], res: float = 5.0, least: float = 0.9, dtm: str = "dtm", relief: str = "relief") -> DataFrame:
    """(cell, r, c, relief) for a box of cells, relief in whole numbers of 0 to 255, stored as a layer.

    The stored elevation is used if it covers the box and has values in `least` of it; else it is fetched and stored."""
    box = F.col("r").between(r0, r1) & F.col("c").between(c0, c1)
    asked = (r1 - r0 + 1) * (c1 - c0 + 1)

    def covers(df: DataFrame) -> bool:
        n = df.where(box).agg(F.count("*").alias("n"), F.sum(F.when(F.col("z").isNotNull() & ~F.isnan("z"), 1).otherwise(0)).alias("ok")).first()
        return n.n == asked and n.ok >= least * asked

    if dtm not in store.names() or not covers(store.read(dtm)):
        store.write(dtm, fetch())
        if not covers(store.read(dtm)):
            raise ValueError(f"the elevation does not cover {least:.0%} of the box")
    cells = store.read(dtm).where(box)
    made = combined_relief(cells, "z", res).select("cell", F.col("relief").cast("smallint").alias("relief"))
    store.write(relief, cells.select("cell", "r", "c").join(made, "cell"))
    return store.read(relief)
