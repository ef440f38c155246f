"""Closed forms as Spark columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import Config, Earthworks


def slope_weight(slope_pct: Column) -> Column:
    """Length of a step over ground of this slope, per metre of map."""
    return F.sqrt(1 + F.pow(slope_pct / 100, 2))


def percent_to_degrees(slope_pct: Column) -> Column:
    return F.degrees(F.atan(slope_pct / 100))


@dataclass(frozen=True)
class WinchLaw:
    """Reach falls from uphill to downhill limits as a function of the ray's height difference."""

    coeff: float
    base: float
    up: float
    down: float
    uphill_m: float
    downhill_m: float

    @property
    def always_m(self) -> float:
        return min(self.uphill_m, self.downhill_m)


def winch_law(config: Config) -> WinchLaw:
    s = config.skidder
    a, b = s.uphill_max_m, s.downhill_max_m
    up, down = abs(s.tilt_uphill_pct) / 100, -abs(s.tilt_downhill_pct) / 100
    if a == b:
        return WinchLaw(0, a, up, down, a, b)
    if a == 0:
        return WinchLaw(0, b, 1e-6, 0, a, b)
    if b == 0:
        return WinchLaw(0, a, 0, -1e-6, a, b)
    rise = math.sqrt(a**2 / (1 + 1 / up**2)) if up > 0 else 0.0
    fall = -math.sqrt(b**2 / (1 + 1 / down**2)) if down < 0 else 0.0
    if rise == fall:
        return WinchLaw(0, 0.5 * (a + b), up, down, a, b)
    coeff = (a - b) / (rise - fall)
    return WinchLaw(coeff, a - coeff * rise, up, down, a, b)


def winch_reach(slope: Column, law: WinchLaw) -> Column:
    """Greatest winching distance along a ray of signed slope (a ratio, positive uphill)."""
    between = F.lit(law.base) / (1 - F.lit(law.coeff) * slope / F.sqrt(1 + F.pow(slope, 2)))
    return F.when(slope <= law.down, F.lit(float(law.downhill_m))).when(slope > law.up, F.lit(float(law.uphill_m))).otherwise(between)


def earthworks_cost(slope_pct: Column, width_m: float, e: Earthworks | None = None) -> Column:
    """Cost per metre of a platform cut into a slope; null where no batter meets the ground again."""
    e = e or Earthworks()
    p = slope_pct / 100
    bench = F.least(F.greatest((p - e.bench_min) / (e.bench_max - e.bench_min), F.lit(0.0)), F.lit(1.0))
    dug, filled = F.lit(width_m / 2) * (1 + bench), F.lit(width_m / 2) * (1 - bench)
    cut = p * F.pow(dug, 2) / 2 + F.lit(0.5) * F.pow(p * dug, 2) / (e.cut_slope - p)
    fill = F.when(filled > 0, p * F.pow(filled, 2) / 2 + F.lit(0.5) * F.pow(p * filled, 2) / (e.fill_slope - p)).otherwise(F.lit(0.0))
    impossible = p.isNull() | F.isnan(p) | (p < 0) | (p >= e.cut_slope) | ((bench < 1) & (p >= e.fill_slope))
    return F.when(~impossible, cut * e.cut_price + fill * e.fill_price + F.greatest(cut - fill, F.lit(0.0)) * e.haul_price)


def _bend(g: Callable[[Column], Column], th: Column, tv: Column, lo: Column, w: Column, f: Column, s1: Column, s: Column) -> Column:
    """How much g of the cable's inclination (vertical over horizontal tension) falls from the upper support to the
    load at s1, and from below the load to s."""
    pull = lambda at, load: g((tv - load - w * at / lo) / th)
    none = F.lit(0.0)
    return (pull(none, none) - pull(s1, none)) + (pull(s1, f) - pull(s, f))


def catenary_x(th: Column, tv: Column, lo: Column, eao: Column, w: Column, f: Column, s1: Column, s: Column) -> Column:
    """Horizontal place on a loaded elastic cable at unstretched length s: load f at s1, weight w over lo."""
    return th * (s / eao + lo / w * _bend(F.asinh, th, tv, lo, w, f, s1, s))


def catenary_z(th: Column, tv: Column, lo: Column, eao: Column, w: Column, f: Column, s1: Column, s: Column) -> Column:
    """Fall below the upper support at unstretched length s: what the tension stretches, what the load takes off beyond
    s1, and the bend."""
    stretch = (tv * s - w * s * s / (2 * lo) - f * (s - s1)) / eao
    return stretch + th * lo / w * _bend(lambda v: F.sqrt(1 + v * v), th, tv, lo, w, f, s1, s)


def catenary_gap_x(th: Column, tv: Column, lo: Column, eao: Column, w: Column, f: Column, s1: Column, d: Column) -> Column:
    """Horizontal closing error: zero when the cable spans d."""
    return catenary_x(th, tv, lo, eao, w, f, s1, lo) - d


def catenary_gap_z(th: Column, tv: Column, lo: Column, eao: Column, w: Column, f: Column, s1: Column, h: Column) -> Column:
    """Vertical closing error: zero when the cable falls h."""
    return catenary_z(th, tv, lo, eao, w, f, s1, lo) - h
