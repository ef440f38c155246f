"""Parameters of the engines, their defaults and checks."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field

INF = math.inf


# fixed values: the defaults that define results
@dataclass(frozen=True)
class Skidder:
    uphill_max_m: float = 50
    downhill_max_m: float = 100
    tilt_uphill_pct: float = 75
    tilt_downhill_pct: float = 20
    off_road_max_m: float = 50
    drive_slope_max_pct: float = 30
    felling_slope_max_pct: float = 100
    winch_anchor_m: float = 10
    clearance_max_m: float = 30
    obstacle_cost: float = 1000
    track_weight_drive: float = 0.5
    track_weight_choice: float = 0.1
    option: int = 1
    bands_m: tuple[float, ...] = (0, 250, 500, 1000, 1500, 2000)


@dataclass(frozen=True)
class Forwarder:
    cross_slope_max_pct: float = 15
    up_slope_max_pct: float = 30
    down_slope_max_pct: float = 25
    crane_m: float = 8
    steep_max_m: float = 300
    off_road_max_m: float = 200
    felling_slope_max_pct: float = 100


@dataclass(frozen=True)
class Selection:
    weights: dict[str, float] = field(default_factory=lambda: {"surface": 1, "supports": 0, "length": 0, "volume": 0, "ipc": 0})
    surface_min: float = 0
    supports_max: float = INF
    length_min: float = 0
    length_max: float = INF
    volume_min: float = 0
    ipc_min: float = 0
    direction: int = 0
    contribution_min: float = 0.6


@dataclass(frozen=True)
class Cable:
    line_min_m: float = 3.5
    line_max_m: float = 50
    length_max_m: float = 750
    length_min_m: float = 150
    mast_m: float = 10.5
    terminal_m: float = 12
    lateral_m: float = 40
    supports_max: int = 3
    support_m: float = 12
    span_min_m: float = 50
    method: str = "beam"
    support_min_m: float = 4
    support_max_m: float = 12
    support_step_m: float = 4
    support_distance_m: float = 40
    pretension_steps: int = 12
    cross_angle_deg: float = 60
    cross_slope_max_pct: float = 30
    cross_length_max_m: float = 75
    cross_share_max: float = 0.15
    no_forest_max_m: float | None = None
    precision: int = 3
    carrier_kg_m: float = 1.85
    mainline_kg_m: float = 0.5
    haulback_kg_m: float = 0.5
    diameter_mm: float = 18
    breaking_kgf: float = 35000
    safety: float = 2.5
    load_kg: float = 2500
    carriage_kg: float = 400
    young_n_mm2: float = 100000
    support_angle_deg: float = 30
    carriage: int = 0
    machine: int = 1
    direction: int = 0
    gravity_pct: float = 15
    winch_up_pct: float = 15
    winch_down_pct: float = 100
    selection: Selection = field(default_factory=Selection)


@dataclass(frozen=True)
class Fire:
    reach_m: float = 440
    slope_max_pct: float = 110
    bands_m: tuple[float, ...] = (0, 120, 280, 440)
    match_m: float = 10
    width_min_m: float = 10
    turning_m: float = 20


@dataclass(frozen=True)
class Earthworks:
    cut_price: float = 17
    fill_price: float = 11
    haul_price: float = 33
    cut_slope: float = 1.0
    fill_slope: float = 0.6
    bench_min: float = 0.35
    bench_max: float = 0.60


@dataclass(frozen=True)
class RoadCost:
    base: float = 20
    reopening: float = 0.65
    #: (from, to, surcharge): left-closed slope classes in percent
    slope_table: tuple[tuple[float, float, float], ...] = ((0, 15, 0), (15, 35, 25), (35, 60, 90), (60, INF, INF))
    bridge: float = 400
    culvert: float = 120
    soil: dict[int, float] | None = None
    earthworks: Earthworks = field(default_factory=Earthworks)


@dataclass(frozen=True)
class Alignment:
    grade_min_pct: float = 2
    grade_max_pct: float = 12
    penalty_xy: float = 150
    penalty_z: float = 80
    neighbourhood_m: float = 42
    dz_max_m: float = 3
    hairpin_deg: float = 110
    cross_all_pct: float = 90
    cross_hairpin_pct: float = 55
    cross_length_max_m: float = 40
    radius_m: float = 8
    cross_share_max: float = 0.25
    hairpin_slope: float = 10
    batter: float = 1.5
    hairpin_spacing: float = 1.5
    goal_m: float = 0


@dataclass(frozen=True)
class Road:
    cost: RoadCost = field(default_factory=RoadCost)
    alignment: Alignment = field(default_factory=Alignment)


@dataclass(frozen=True)
class General:
    resolution_m: float = 5
    crs_epsg: int | None = None
    slope_method: str = "horn"
    tile_m: float = 2000
    halo_m: float = 500
    halo_max_m: float = 4000


@dataclass(frozen=True)
class Config:
    skidder: Skidder = field(default_factory=Skidder)
    forwarder: Forwarder = field(default_factory=Forwarder)
    cable: Cable = field(default_factory=Cable)
    fire: Fire = field(default_factory=Fire)
    road: Road = field(default_factory=Road)
    general: General = field(default_factory=General)

    def __post_init__(self):
        self.check()

    def check(self) -> None:
        s, f, c, r = self.skidder, self.forwarder, self.cable, self.road
        rules = {
            "winch clearance must be above its anchor": s.clearance_max_m > s.winch_anchor_m,
            "skidder distances must not be negative": min(s.uphill_max_m, s.downhill_max_m, s.off_road_max_m) >= 0,
            "skidder bands must ascend": list(s.bands_m) == sorted(set(s.bands_m)),
            "only skidding option 1 is defined": s.option == 1,
            "forwarder slopes must be positive": min(f.cross_slope_max_pct, f.up_slope_max_pct, f.down_slope_max_pct) > 0,
            "the cable's greatest height must exceed its least": c.line_max_m > c.line_min_m,
            "the cable's greatest length must exceed its least": c.length_max_m > c.length_min_m,
            "cable precision is 1 to 3": c.precision in (1, 2, 3),
            "the contribution is a share": 0 <= c.selection.contribution_min <= 1,
            "fire bands must ascend": list(self.fire.bands_m) == sorted(set(self.fire.bands_m)),
            "slope classes must join from 0 to infinity": r.cost.slope_table[0][0] == 0
            and r.cost.slope_table[-1][1] == INF
            and all(a[1] == b[0] for a, b in zip(r.cost.slope_table, r.cost.slope_table[1:], strict=False)),
            "benching must be complete before the fill slope": r.cost.earthworks.bench_max <= r.cost.earthworks.fill_slope,
            "road grades must ascend": r.alignment.grade_min_pct < r.alignment.grade_max_pct,
            "the resolution must be positive": self.general.resolution_m > 0,
            "the largest halo must be at least the first": self.general.halo_max_m >= self.general.halo_m,
            "slope methods are horn and four": self.general.slope_method in ("horn", "four"),
        }
        broken = [k for k, ok in rules.items() if not ok]
        if broken:
            raise ValueError("; ".join(broken))


def build(**sections: dict) -> Config:
    """A Config with overridden values: build(skidder={"uphill_max_m": 80})."""
    base = Config()
    return dataclasses.replace(base, **{k: _over(getattr(base, k), v) for k, v in sections.items()})


def _over(part, values: dict):
    out = {}
    for k, v in values.items():
        old = getattr(part, k)
        out[k] = _over(old, v) if dataclasses.is_dataclass(old) and isinstance(v, dict) else tuple(map(tuple, v)) if k == "slope_table" else tuple(v) if isinstance(old, tuple) else v
    return dataclasses.replace(part, **out)


def write(config: Config, path: str) -> None:
    """All sections, as JSON or, for .yml and .yaml, as YAML."""
    data = dataclasses.asdict(config)
    with open(path, "w") as f:
        if path.endswith((".yml", ".yaml")):
            import yaml

            yaml.safe_dump(json.loads(json.dumps(data)), f)
        else:
            json.dump(data, f, indent=1)


def read(path: str) -> Config:
    """Missing keys take their defaults; every section is read back."""
    with open(path) as f:
        if path.endswith((".yml", ".yaml")):
            import yaml

            data = yaml.safe_load(f)
        else:
            data = json.load(f)
    return build(**(data or {}))


def cable_precision(precision: int = 3) -> tuple[int, int, int]:
    """(azimuth step in degrees, stride of departures, beam width)."""
    return {1: (1, 1, 5), 2: (2, 1, 5), 3: (2, 2, 1)}[precision]


def cable_slopes(c: Cable) -> tuple[float, float, float, float]:
    """(downhill least, downhill most, uphill least, uphill most) line slope in radians, by machine and direction."""
    gravity, up, down = (math.atan(p / 100) for p in (c.gravity_pct, c.winch_up_pct, c.winch_down_pct))
    if c.carriage == 1:
        below, above, below_one = (-up, 0.1), (-0.1, down), (-up, 0.1)
    elif c.machine < 3:
        below, above, below_one = (-1.4, 0.1), (-0.1, 1.4), (-1.4, -gravity)
    else:
        below, above, below_one = (-1.4, -gravity), (gravity, 1.4), (-1.4, -gravity)
    if c.direction == 0:
        return *below, *above
    return (*below_one, 0, 0) if c.direction == 1 else (0, 0, *above)


@dataclass(frozen=True)
class CableConstants:
    """What the cable hardware gives: loads in newtons."""

    load: float
    stiffness: float
    tension_max: float
    no_forest_max_m: float


def cable_constants(c: Cable) -> CableConstants:
    g = 9.80665
    return CableConstants(
        g * (c.load_kg + c.carriage_kg),
        c.young_n_mm2 * 0.25 * math.pi * c.diameter_mm**2,
        c.breaking_kgf * g / c.safety,
        min(0.1 * c.length_max_m, c.length_min_m) if c.no_forest_max_m is None else c.no_forest_max_m,
    )
