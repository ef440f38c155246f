"""Fuzzy membership of road traces: ramps per channel and their weighted mean."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ramp:
    """0 below a, 1 above b if rising; the reverse if falling."""

    rising: bool
    a: float
    b: float
    weight: float = 1.0

    def of(self, x: Column) -> Column:
        v = F.when(x.isNotNull(), F.least(F.greatest((x - self.a) / (self.b - self.a), F.lit(0.0)), F.lit(1.0)))
        return v if self.rising else 1 - v


# fixed values: ramps calibrated on reference roads, and the scale of vesselness
TERRAIN = {
    "roughness": Ramp(True, 0.0402013732, 0.172684016, 2),
    "slope": Ramp(False, 4.4913660574, 20.256017850, 2),
    "vesselness": Ramp(True, 0.0006361408, 0.070831439, 2),
    "openness_pos": Ramp(False, 81.4344019229, 86.632451057, 1),
    "local_relief": Ramp(False, -0.2492187500, 0.007807821, 1),
    "openness_neg": Ramp(True, 86.9214112193, 89.202206074, 1),
    "svf": Ramp(True, 0.8552256750, 0.914393904, 1),
}
SURFACE = {
    "penetration": Ramp(True, 0.1290322581, 1, 3),
    "ground_density": Ramp(True, 6, 29, 3),
    "canopy_height": Ramp(False, 6.8340001106, 13.803000450, 2),
}
VESSEL_SCALE = {"c_1": 0.3541673, "c_2": 0.7593123, "c_4": 1.2454072}


def normalise(specs: Mapping) -> dict[str, dict[str, Ramp]]:
    """Groups of ramps; a flat mapping of ramps stands for the terrain group."""
    if not specs:
        raise ValueError("no ramps given")
    if all(isinstance(v, Ramp) for v in specs.values()):
        return {"terrain": dict(specs), "surface": dict(SURFACE)}
    if set(specs) <= {"terrain", "surface"} and all(isinstance(r, Ramp) for g in specs.values() for r in g.values()):
        return {k: dict(v) for k, v in specs.items()}
    raise ValueError(f"neither groups nor ramps: {', '.join(map(str, specs))}")


def score(specs: Mapping, columns: Mapping[str, Column]) -> Column:
    """Weighted mean membership over the channels that are there and not null."""
    ramps = {k: r for g in normalise(specs).values() for k, r in g.items() if k in columns}
    total = sum((F.coalesce(r.of(columns[k]) * r.weight, F.lit(0.0)) for k, r in ramps.items()), F.lit(0.0))
    weight = sum((F.when(columns[k].isNotNull(), r.weight).otherwise(0.0) for k, r in ramps.items()), F.lit(0.0))
    return F.when(weight > 0, total / weight)
