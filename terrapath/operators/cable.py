"""Cable yarding: elastic catenaries, spans, supports and the scan of lines.

A task holds a tile's window: it lays rays over it, keeps lines worth a cable (`rays.check_rows`), places their supports and
gives each cell its longest line; an aggregate picks the best of all tiles. The spans that a batch of lines tries at a time,
at all load positions, are solved together by one vectorised Newton iteration."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import Cable, Config, cable_constants, cable_precision, cable_slopes
from ..sources.scratch import written
from . import rays

G = 9.80665


def gaps(th, tv, lo, eao, w, f, s, d, h):
    """(horizontal, vertical) closing errors of a cable of unstretched length lo with load f at s."""
    a, b, c, e = tv / th, (tv - f - w) / th, (tv - f - w * s / lo) / th, (tv - w * s / lo) / th
    x = th * lo / eao + th * lo / w * (np.arcsinh(a) - np.arcsinh(b) + np.arcsinh(c) - np.arcsinh(e)) - d
    root = lambda v: np.sqrt(1 + v * v)
    z = w * lo / eao * (tv / w - 0.5) + th * lo / w * (root(a) - root(b) + f * w / (th * eao) * (s / lo - 1) + root(c) - root(e)) - h
    return x, z


def solve_tension(lo, eao, w, f, s, d, h, th, tv, steps: int = 30, tol: float = 1e-3):
    """(th, tv, solved) by Newton's method from a first guess, for arrays of loads and places at once.

    The Jacobian is taken by central differences; steps that would leave the domain are halved."""
    th, tv = np.broadcast_arrays(np.asarray(th, float), np.asarray(tv, float))
    th, tv = th.copy(), tv.copy()
    for _ in range(steps):
        x, z = gaps(th, tv, lo, eao, w, f, s, d, h)
        if np.all(np.abs(x) + np.abs(z) < tol):
            break
        e = 1e-4 * np.maximum(th, 1.0)
        xa, za = gaps(th + e, tv, lo, eao, w, f, s, d, h)
        xb, zb = gaps(th - e, tv, lo, eao, w, f, s, d, h)
        xc, zc = gaps(th, tv + e, lo, eao, w, f, s, d, h)
        xd, zd = gaps(th, tv - e, lo, eao, w, f, s, d, h)
        xt, zt, xv, zv = (xa - xb) / (2 * e), (za - zb) / (2 * e), (xc - xd) / (2 * e), (zc - zd) / (2 * e)
        det = xt * zv - xv * zt
        with np.errstate(divide="ignore", invalid="ignore"):
            dt, dv = (-zv * x + xv * z) / det, (zt * x - xt * z) / det
        dt, dv = np.nan_to_num(dt), np.nan_to_num(dv)
        scale = np.where(dt < -0.5 * th, -0.5 * th / np.where(dt == 0, -1, dt), 1.0)
        th, tv = th + scale * dt, tv + scale * dv
    x, z = gaps(th, tv, lo, eao, w, f, s, d, h)
    return th, tv, np.abs(x) + np.abs(z) < 0.05


def closing(th, tv, lo, eao, w, f, s, d, h):
    """gaps and their derivatives, from the same roots: (x, z, dx/dth, dx/dtv = dz/dth, dz/dtv)."""
    a, b, c, e = tv / th, (tv - f - w) / th, (tv - f - w * s / lo) / th, (tv - w * s / lo) / th
    ra, rb, rc, re = np.sqrt(1 + a * a), np.sqrt(1 + b * b), np.sqrt(1 + c * c), np.sqrt(1 + e * e)
    k, turned = lo / w, np.arcsinh(a) - np.arcsinh(b) + np.arcsinh(c) - np.arcsinh(e)
    sines, stretch = a / ra - b / rb + c / rc - e / re, lo / eao
    x = th * stretch + th * k * turned - d
    z = w * stretch * (tv / w - 0.5) + th * k * (ra - rb + f * w / (th * eao) * (s / lo - 1) + rc - re) - h
    return x, z, stretch + k * (turned - sines), k * (1 / ra - 1 / rb + 1 / rc - 1 / re), stretch + k * sines


def solve_tensions(lo, eao, w, f, s, d, h, th, tv, group: np.ndarray | None = None, steps: int = 30, tol: float = 1e-3):
    """solve_tension for many cables at once, flat arrays of one length: each stops when it closes, or, with `group`
    (numbers from 0), when all of its group do."""
    th, tv, error = th.copy(), tv.copy(), np.full(len(th), math.inf)
    act = np.arange(len(th))
    rest = lo, w, f, s, d, h
    with np.errstate(all="ignore"):
        for _ in range(steps):
            a, b = th[act], tv[act]
            x, z, xt, xv, zv = closing(a, b, rest[0], eao, *rest[1:])
            off = np.abs(x) + np.abs(z)
            error[act] = off
            open_ = ~(off < tol)
            if group is not None and open_.any():
                open_ = (np.bincount(group[act], weights=open_) > 0)[group[act]]
            if not open_.any():
                act = act[:0]
                break
            if not open_.all():
                act, a, b, x, z, xt, xv, zv = (v[open_] for v in (act, a, b, x, z, xt, xv, zv))
                rest = tuple(v[open_] for v in rest)
            det = xt * zv - xv * xv
            dt, dv = np.nan_to_num((-zv * x + xv * z) / det), np.nan_to_num((xv * x - xt * z) / det)
            scale = np.where(dt < -0.5 * a, -0.5 * a / np.where(dt == 0, -1, dt), 1.0)
            th[act], tv[act] = a + scale * dt, b + scale * dv
        if len(act):
            x, z = gaps(th[act], tv[act], rest[0], eao, *rest[1:])
            error[act] = np.abs(x) + np.abs(z)
    return th, tv, error < 0.05


def tension_by_grid(lo, eao, w, f, s, d, h, tmax: float, step: float, close: float = 0.05, enough: float = 0.03) -> tuple[float, float, bool]:
    """(th, tv, feasible): the node of a grid of tensions below tmax whose closing errors are both under `close` and
    smallest in sum, or the first under `enough`; (-1, -1) if there is none. Feasible means not above tmax."""
    at = np.arange(0, int(tmax), step, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        x, z = gaps(at[:, None], at[None, :], lo, eao, w, f, s, d, h)
    total = np.where((np.abs(x) < close) & (np.abs(z) < close), np.abs(x) + np.abs(z), np.inf).ravel()
    if not np.isfinite(total).any():
        return -1.0, -1.0, math.hypot(1, 1) <= tmax
    good = np.flatnonzero(total < enough)
    i, j = divmod(int(good[0] if len(good) else np.argmin(total)), len(at))
    return float(at[i]), float(at[j]), math.hypot(at[i], at[j]) <= tmax


def grid_tensions(spans: DataFrame, tmax: float, step: float) -> DataFrame:
    """spans (id, lo, eao, w, f, s, d, h) to (id, th, tv, feasible), each by `tension_by_grid`."""
    names = ["lo", "eao", "w", "f", "s", "d", "h"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            found = [tension_by_grid(*row, tmax, step) for row in p[names].itertuples(index=False)]
            yield pd.DataFrame({"id": p["id"], "th": [x[0] for x in found], "tv": [x[1] for x in found], "feasible": [x[2] for x in found]})

    return spans.select("id", *names).mapInPandas(run, "id long, th double, tv double, feasible boolean")


def place_on_cable(th, tv, lo, eao, w, f, s):
    """(across, down) from the upper support to the load at s."""
    a, c = tv / th, (tv - w * s / lo) / th
    across = th * s / eao + th * lo / w * (np.arcsinh(a) - np.arcsinh(c))
    down = w * s / eao * (tv / w - s / (2 * lo)) + th * lo / w * (np.sqrt(1 + a * a) - np.sqrt(1 + c * c))
    return across, down


def as_column(v):
    """Arrays as a column, numbers as they are."""
    return v[:, None] if isinstance(v, np.ndarray) else v


@dataclass(frozen=True)
class Span:
    slope: float
    length: float
    tension: float
    clearance: float


class Hardware:
    def __init__(self, c: Cable):
        k = cable_constants(c)
        self.c, self.load, self.eao, self.tmax = c, k.load, k.stiffness, k.tension_max

    def force(self, lo, s, before: float = 0.0, after: float = 0.0):
        """Load with half the weight of the lines that pull it."""
        return 0.5 * ((s + before) * self.c.mainline_kg_m + (lo - s + after) * self.c.haulback_kg_m) * G + self.load

    def chord_clears(self, x, z, i: int, j: int, zi: float, zj: float, before: float) -> bool:
        """Cheap test first: the chord stays above the ground clearance, and its sag keeps it below the largest."""
        d, h = x[j] - x[i], abs(zi - zj)
        diag = math.hypot(d, h)
        f = self.force(diag, diag / 2, before)
        sag = 1.1 * (f * diag / (4 * self.tmax) + self.c.carrier_kg_m * G * diag**2 / (8 * self.tmax))
        inner = slice(i + 1, j)
        above = zi + (zj - zi) * (x[inner] - x[i]) / d - z[inner]
        return bool(np.all(above >= self.c.line_min_m) and np.all(above - sag <= self.c.line_max_m))

    def chords_clear(self, x, z, i: int, js: np.ndarray, zi: float, zj: np.ndarray, before: float) -> np.ndarray:
        """chord_clears for many ends at once."""
        inner = slice(i + 1, int(js.max()))
        own = np.arange(inner.start, inner.stop) < js[:, None]
        return self.clear_chords(x[inner] - x[i], z[inner], own, x[js] - x[i], zi, zj, before)

    def clear_chords(self, at, z, own, d, zi, zj, before) -> np.ndarray:
        """chord_clears by rows: ground z at `at` from the start, where own; spans of d between heights zi and zj."""
        diag = np.hypot(d, np.abs(zi - zj))
        sag = 1.1 * (self.force(diag, diag / 2, before) * diag / (4 * self.tmax) + self.c.carrier_kg_m * G * diag**2 / (8 * self.tmax))
        above = as_column(zi) + (zj - zi)[:, None] * at / d[:, None] - z
        bad = (above < self.c.line_min_m) | (above - sag[:, None] > self.c.line_max_m) | np.isnan(above)
        return ~(bad & own).any(axis=1)

    def hangs_low(self, x, z, i: int, js: np.ndarray, zi: float, zj: np.ndarray, before: float) -> np.ndarray:
        """low_hanging for spans from one place."""
        inner = slice(i + 1, int(js.max()))
        return self.low_hanging(x[inner] - x[i], z[inner], x[js] - x[i], zi, zj, before)

    def low_hanging(self, at, z, d, zi, zj, before) -> np.ndarray:
        """Spans whose sweep is bound to find the load too near the ground, told without solving; by rows as in clear_chords.

        With the load at a of d from the upper support, moments about both supports give a fall below the chord of at least
        (f a (d - a) / d + bending by the cable's own weight) / th; th is bounded, as the tension must not be above the largest
        by 1000 N. Where ground within 6 m lies above that, a load at some step of 5 m is too low: steps begin and end less than 16 m
        from the supports. 0.1 m is left for closing errors."""
        d, h, zi, before = d[:, None], (zj - zi)[:, None], as_column(zi), as_column(before)
        diag, tilt = np.hypot(d, h), np.abs(h) / d
        lines = before * self.c.mainline_kg_m + diag * (1 - self.tmax / self.eao) * min(self.c.mainline_kg_m, self.c.haulback_kg_m)
        f, most, square = 0.5 * lines * G + self.load, self.tmax + 1000, 1 + tilt * tilt
        left = d - at
        v = f / d * np.where(h > 0, at, left)
        th = (np.sqrt(np.maximum(most * most * square - v * v, 0)) - tilt * v) / square
        fall = (f / d + self.c.carrier_kg_m * G / 2.04) * at * left / th
        low = (zi + h / d * at - fall - z < self.c.line_min_m - 0.1) & (at >= 16) & (left >= 16)
        return (low[:, :-2] & low[:, 1:-1] & low[:, 2:] & (at[..., 2:] - at[..., :-2] >= 6)).any(axis=1)

    def may_span(self, x, z, i: int, js: np.ndarray, hi: float, hj: float, slopes: tuple[float, float], before: float, last_slope: float | None) -> np.ndarray:
        """Those of js that the cheap tests leave as ends of a span from i: chord, slope and turn at the support."""
        js = js[x[js] > x[i]]
        if not len(js):
            return js
        zi, zj = z[i] + hi, z[js] + hj
        slope = np.arctan2(zj - zi, x[js] - x[i])
        ok = (slopes[0] <= slope) & (slope <= slopes[1])
        if last_slope is not None:
            turn = np.abs(slope - last_slope)
            ok &= ~((turn >= math.radians(self.c.support_angle_deg)) | (slope * last_slope < 0) & (turn >= 0.1))
        js, zj = js[ok], zj[ok]
        if not len(js):
            return js
        ok = self.chords_clear(x, z, i, js, zi, zj, before)
        js, zj = js[ok], zj[ok]
        return js[~self.hangs_low(x, z, i, js, zi, zj, before)] if len(js) else js

    def span(self, x, z, i: int, j: int, hi: float, hj: float, slopes: tuple[float, float], before: float = 0.0, last_slope: float | None = None, step: float = 5.0) -> Span | None:
        """The span from i to j (support heights hi, hj) at full tension, or None if it can't carry the load everywhere."""
        if not len(self.may_span(x, z, i, np.array([j]), hi, hj, slopes, before, last_slope)):
            return None
        return self.spans([(x, z, i, j, hi, hj, before)], step)[0]

    def spans(self, asked: list[tuple], step: float = 5.0) -> list[Span | None]:
        """Spans (x, z, i, j, hi, hj, before) that passed the cheap tests, all solved together."""
        zi, zj = (np.array([q[1][q[k]] + q[k + 2] for q in asked]) for k in (2, 3))
        d, before = np.array([q[0][q[3]] - q[0][q[2]] for q in asked]), np.array([q[6] for q in asked], float)

        def ground(of: np.ndarray, along: np.ndarray) -> np.ndarray:
            cut = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
            return np.concatenate([np.interp(x[i] + along[m:n], x, z) for (x, z, i, *_), m, n in zip([asked[k] for k in of[cut[:-1]].tolist()], cut[:-1], cut[1:], strict=True)])

        good, *found = self.carried(d, zi, zj, before, ground, step)
        return [Span(*x) if k else None for k, *x in zip(good.tolist(), *(v.tolist() for v in found), strict=True)]

    def carried(self, d: np.ndarray, zi: np.ndarray, zj: np.ndarray, before: np.ndarray, ground: Callable, step: float = 5.0) -> tuple[np.ndarray, ...]:
        """(whether it carries the load everywhere, slope, length, tension, clearance) of spans between heights zi and zj, d
        apart. ground(of, along): heights under places of span `of`, from its start."""
        lo, th, tv, good = self.at_full_tensions(d, np.abs(zi - zj), before)
        out = good, np.arctan2(zj - zi, d), lo, np.zeros(len(d)), np.zeros(len(d))
        some = np.flatnonzero(good)
        if len(some):
            good[some], out[3][some], out[4][some] = self.sweep(zi[some], zj[some], d[some], lo[some], th[some], tv[some], before[some], lambda of, along: ground(some[of], along), step)
        return out

    def at_full_tension(self, d: float, h: float, before: float) -> tuple[float, float, float] | None:
        """at_full_tensions of one span, None if there is no such length."""
        lo, th, tv, found = self.at_full_tensions(np.array([d]), np.array([h]), np.array([before]))
        return (float(lo[0]), float(th[0]), float(tv[0])) if found[0] else None

    def length_at(self, d: np.ndarray, h: np.ndarray, before: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(length, newtons a metre): about the unstretched lengths at which the load in the middle gives the largest tension, by
        Newton's method in length and direction; and how fast the tension falls there. Not a number where it does not close."""
        diag, most = np.hypot(d, h), self.tmax

        def off(lo, th, tv):
            f = self.force(lo, lo / 2, before)
            return closing(th, tv, lo, self.eao, self.c.carrier_kg_m * G * lo, f, lo / 2, d, h)

        sag = self.force(diag, diag / 2, before) * d / (4 * most)
        lo = (diag + 2 * sag * sag / diag) / (1 + most / self.eao)
        turn = np.arctan2(h + 2 * sag, d)
        with np.errstate(all="ignore"):
            for _ in range(steps):
                th, tv, e = most * np.cos(turn), most * np.sin(turn), 1e-5 * diag
                x, z, xt, xv, zv = off(lo, th, tv)
                (xa, za, *_), (xb, zb, *_) = off(lo + e, th, tv), off(lo - e, th, tv)
                xl, zl, xr, zr = (xa - xb) / (2 * e), (za - zb) / (2 * e), -xt * tv + xv * th, -xv * tv + zv * th
                if np.all(np.abs(x) + np.abs(z) < 1e-7):
                    break
                det = xl * zr - xr * zl
                lo, turn = lo - (zr * x - xr * z) / det, turn - (xl * z - zl * x) / det
            det = xt * zv - xv * xv
            fall = (th * (zv * xl - xv * zl) + tv * (xt * zl - xv * xl)) / (det * most)
            good = (np.abs(x) + np.abs(z) < 1e-4) & (th > 0) & (fall > 0)
        return np.where(good, lo, np.nan), np.where(good, fall, np.nan)

    def at_full_tensions(self, d: np.ndarray, h: np.ndarray, before: np.ndarray, sure: float = 300.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(length, th, tv, found): the unstretched lengths at which the load in the middle gives the largest tension, within 50 N.

        They are those that halving comes to. Halves whose tension is off by more than `sure`, told by `length_at`, are
        chosen without solving."""
        diag = np.hypot(d, h)
        low, high, pull = diag * (1 - self.tmax / self.eao), diag + 100.0, 0.9 * self.tmax
        length, at_th, at_tv, found = np.zeros(len(d)), np.zeros(len(d)), np.zeros(len(d)), np.zeros(len(d), bool)
        goal, fall = self.length_at(d, h, before)
        act = np.arange(len(d))
        for _ in range(80):
            mid = (low[act] + high[act]) / 2
            over = mid < goal[act]
            hit = np.zeros(len(act), bool)
            near = np.flatnonzero(~(np.abs(mid - goal[act]) * fall[act] > sure))
            if len(near):
                at, lo = act[near], mid[near]
                dd, hh = d[at], h[at]
                f = self.force(lo, lo / 2, before[at])
                th, tv, ok = solve_tensions(lo, self.eao, self.c.carrier_kg_m * G * lo, f, lo / 2, dd, hh, pull * dd / diag[at], pull * hh / diag[at] + f / 2)
                t = np.hypot(th, tv)
                with np.errstate(invalid="ignore"):
                    hit[near], over[near] = ok & (np.abs(t - self.tmax) <= 50), ~ok | (t > self.tmax)
                got = hit[near]
                length[at[got]], at_th[at[got]], at_tv[at[got]], found[at[got]] = lo[got], th[got], tv[got], True
            low[act[over & ~hit]], high[act[~over & ~hit]] = mid[over & ~hit], mid[~over & ~hit]
            act = act[~hit & ~(high[act] - low[act] < 1e-7)]
            if not len(act):
                break
        return length, at_th, at_tv, found

    def sweep(self, zi, zj, d, lo, th, tv, before, ground: Callable, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The load at every step of each span: (solved, clear of the ground, below the largest height and tension; tension; clearance)."""
        n = np.where(lo > 20, np.ceil((lo - 20.0) / step), 1).astype(np.int64)
        of, start = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        at_lo, h = lo[of], np.abs(zi - zj)
        s = np.where(at_lo > 20, 10.0 + step * (np.arange(len(of)) - start[of]), at_lo / 2)
        w, down = self.c.carrier_kg_m * G * at_lo, (zi >= zj)[of]
        f = self.force(at_lo, np.where(down, s, at_lo - s), before[of])
        a, b, ok = solve_tensions(at_lo, self.eao, w, f, s, d[of], h[of], th[of], tv[of], of)
        with np.errstate(all="ignore"):
            across, fall = place_on_cable(a, b, at_lo, self.eao, w, f, s)
            tension = np.hypot(a, b)
            height = np.maximum(zi, zj)[of] - fall - ground(of, np.where(down, across, d[of] - across))
            good = ok & ~((height < self.c.line_min_m) | (height > self.c.line_max_m) | (tension > self.tmax + 1000))
        return np.logical_and.reduceat(good, start), np.maximum.reduceat(tension, start), np.minimum.reduceat(height, start) - self.c.line_min_m


def settled(hw: Hardware, searches: list[Generator]) -> list:
    """What searches return that ask for spans one by one; what all of them ask for at a time is solved together."""
    out, asking, asked = [None] * len(searches), list(range(len(searches))), [None] * len(searches)
    answers: list[Span | None] = [None] * len(searches)
    while asking:
        still = []
        for k in asking:
            try:
                asked[k] = searches[k].send(answers[k])
                still.append(k)
            except StopIteration as e:
                out[k] = e.value
        asking = still
        for k, x in zip(asking, hw.spans([asked[k] for k in asking]) if asking else [], strict=True):
            answers[k] = x
    return out


def place_supports(hw: Hardware, x: np.ndarray, z: np.ndarray, slopes: tuple[float, float], start_h: float, beam: int) -> tuple[int, list[int]] | None:
    """supports_of for one line."""
    return settled(hw, [supports_of(hw, x, z, slopes, start_h, beam)])[0]


def supports_of(hw: Hardware, x: np.ndarray, z: np.ndarray, slopes: tuple[float, float], start_h: float, beam: int) -> Generator:
    """(last pixel, support pixels) of the farthest line with few supports: beam search over support places. Spans are
    yielded to be solved.

    A state is a place with its last slope and the line laid so far. From each, the farthest feasible end is
    taken, else supports at feasible distances make new states, of which the `beam` farthest go on."""
    c = hw.c
    last, ends = len(x) - 1, []
    states = [(0, start_h, None, 0.0, [])]
    for used in range(c.supports_max + 1):
        more = []
        for at, height, slope, laid, supports in states:
            far = np.arange(last, at, -1)
            far = far[x[far] - x[at] >= c.span_min_m]
            for j in hw.may_span(x, z, at, far[x[far] >= c.length_min_m], height, c.terminal_m, slopes, laid, slope).tolist():
                if (yield x, z, at, j, height, c.terminal_m, laid):
                    ends.append((j, -used, supports))
                    break
            if used == c.supports_max:
                continue
            kept = 0
            for j in hw.may_span(x, z, at, far[far < last], height, c.support_m, slopes, laid, slope).tolist():
                if kept >= beam:
                    break
                if s := (yield x, z, at, j, height, c.support_m, laid):
                    more.append((j, c.support_m, s.slope, laid + s.length, [*supports, j]))
                    kept += 1
        if ends and max(ends)[0] == last:
            break
        states = sorted(more, key=lambda q: -q[0])[: max(1, beam)]
        if not states:
            break
    if not ends:
        return None
    j, _, supports = max(ends, key=lambda q: (q[0], q[1]))
    return j, supports


def place_supports_by_graph(hw: Hardware, x: np.ndarray, z: np.ndarray, slopes: tuple[float, float], start_h: float, beam: int) -> tuple[int, list[int]] | None:
    """Alternative: nodes are places with support heights, arcs feasible spans under the pull of the line laid before them;
    the farthest end reached, then the cheapest supports (taller ones cost more)."""
    c = hw.c
    heights = np.arange(c.support_min_m, c.support_max_m + 1e-9, c.support_step_m).tolist()
    stride = max(1, int(c.support_distance_m / max(x[1] - x[0], 1e-9)) // 2)
    queue, seen, best = [(0.0, 0, start_h, 0, (), 0.0, None)], {}, None
    while queue:
        cost, at, height, used, supports, laid, slope = heapq.heappop(queue)
        if seen.get((at, height, used), math.inf) <= cost:
            continue
        seen[at, height, used] = cost
        for j in range(len(x) - 1, at, -1):
            if x[j] - x[at] < c.span_min_m:
                break
            if x[j] < c.length_min_m or best and (j < best[0] or j == best[0] and cost >= best[1]):
                continue
            if hw.span(x, z, at, j, height, c.terminal_m, slopes, laid, slope):
                best = (j, cost, supports)
                break
        if used == c.supports_max:
            continue
        for j in range(at + stride, len(x) - 1, stride):
            if x[j] - x[at] < max(c.span_min_m, c.support_distance_m):
                continue
            for hj in heights:
                if s := hw.span(x, z, at, j, height, hj, slopes, laid, slope):
                    heapq.heappush(queue, (cost + 1 + (hj / c.support_max_m) ** 2, j, hj, used + 1, (*supports, j), laid + s.length, s.slope))
    return (best[0], list(best[2])) if best else None


def line_of(hw: Hardware, x: np.ndarray, z: np.ndarray, precision: int) -> Generator:
    """(last pixel, supports, direction): 1 with the machine above, -1 below, by whether the start clears the profile; None without
    a line. Spans are yielded to be solved, as in `supports_of`."""
    c, (low_min, low_max, up_min, up_max) = hw.c, cable_slopes(hw.c)
    beam = cable_precision(precision)[2]
    far = z[x > c.length_min_m]
    above = bool(len(far)) and z[0] + c.mast_m >= far.max() + c.terminal_m
    slopes, direction = ((low_min, low_max), 1) if above else ((up_min, up_max), -1)
    if slopes == (0, 0):
        return None
    if c.method == "graph":
        found = place_supports_by_graph(hw, x, z, slopes, c.mast_m, beam)
    else:
        found = yield from supports_of(hw, x, z, slopes, c.mast_m, beam)
    return (*found, direction) if found else None


class Profiles:
    """Lines as rows, padded: x from the start (inf beyond the end), z and the number of cells."""

    def __init__(self, hw: Hardware, x: np.ndarray, z: np.ndarray, n: np.ndarray):
        own = np.arange(x.shape[1]) < n[:, None]
        self.hw, self.x, self.z, self.n = hw, np.where(own, x, np.inf), np.where(own, z, np.nan), n
        self.row = 2 * float(np.max(x, where=own, initial=1.0)) + 1  # keys of rows, one after the other
        self.keys = (np.minimum(self.x, self.row - 1) + np.arange(len(x))[:, None] * self.row).ravel()

    def ground(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Heights at places along lines, between the cells."""
        wide = self.x.shape[1]
        k = np.searchsorted(self.keys, line * self.row + at, side="right") - 1 - line * wide
        k = np.clip(k, 0, self.n[line] - 2) + line * wide
        x, z = self.x.ravel(), self.z.ravel()
        return (z[k + 1] - z[k]) / (x[k + 1] - x[k]) * (at - x[k]) + z[k]

    def ends(self, line, at, height, slope, laid, least, most, goals, end_h: float, need: int) -> list[list[tuple[int, float, float]]]:
        """Per state (line, place, height, last slope or not a number, line laid, slopes allowed, goals as rows) the farthest `need`
        ends that carry the load: (place, slope, length). What the states try next is solved together."""
        hw, c = self.hw, self.hw.c
        x, z = self.x[line], self.z[line]
        own = np.arange(len(line))
        x0, zi = x[own, at], z[own, at] + height
        with np.errstate(all="ignore"):
            x = x - x0[:, None]  # from the state's place
            turn = np.arctan2(z + end_h - zi[:, None], x)
            left = goals & (x > 0) & (least[:, None] <= turn) & (turn <= most[:, None])
            bend = np.abs(turn - slope[:, None])
            left &= ~((bend >= math.radians(c.support_angle_deg)) | (turn * slope[:, None] < 0) & (bend >= 0.1))
            # ends seen under the clearance of what lies before; the exact test comes later
            rise = np.where(x > 0, (z + c.line_min_m - zi[:, None]) / x, -np.inf)
            seen = np.fmax.accumulate(rise, axis=1)
            left[:, 1:] &= ~((z[:, 1:] + end_h - zi[:, None]) / x[:, 1:] < seen[:, :-1] - 1e-9)
        out: list[list[tuple[int, float, float]]] = [[] for _ in range(len(line))]
        wide, act = x.shape[1], own[left.any(axis=1)]
        while len(act):
            ask, k = np.full(len(act), -1), np.arange(len(act))
            while len(k):
                o = act[k]
                some = left[o].any(axis=1)
                k, o = k[some], o[some]
                if not len(k):
                    break
                j = wide - 1 - np.argmax(left[o, ::-1], axis=1)
                cut = slice(int(at[o].min()) + 1, max(int(j.max()), int(at[o].min()) + 2))
                xs, zs, steps = x[o, cut], z[o, cut], np.arange(cut.start, cut.stop)
                inner = (steps > at[o][:, None]) & (steps < j[:, None])
                d, zj = x[o, j], z[o, j] + end_h
                with np.errstate(all="ignore"):
                    good = hw.clear_chords(xs, zs, inner, d, zi[o], zj, laid[o])
                    good[good] = ~hw.low_hanging(xs[good], zs[good], d[good], zi[o[good]], zj[good], laid[o[good]])
                ask[k[good]] = j[good]
                left[o[~good], j[~good]] = False
                k = k[~good]
            act, ask = act[ask >= 0], ask[ask >= 0]
            if not len(act):
                break
            ok, got_slope, length, _, _ = hw.carried(x[act, ask], zi[act], z[act, ask] + end_h, laid[act], lambda of, along: self.ground(line[act[of]], x0[act[of]] + along))  # noqa: B023
            left[act, ask] = False
            for o, j, t, m in zip(act[ok].tolist(), ask[ok].tolist(), got_slope[ok].tolist(), length[ok].tolist(), strict=True):
                out[o].append((j, t, m))
            act = act[[len(out[o]) < need for o in act.tolist()]]
        return out


def lines_of(hw: Hardware, x: np.ndarray, z: np.ndarray, n: np.ndarray, precision: int) -> list[tuple[int, list[int], int] | None]:
    """What `line_of` returns for each of many lines, rows of x and z with n cells each, all searched together by `supports_of`'s rule."""
    c, (low_min, low_max, up_min, up_max) = hw.c, cable_slopes(hw.c)
    beam = cable_precision(precision)[2]
    if c.method == "graph":
        return settled(hw, [line_of(hw, x[k, :m], z[k, :m], precision) for k, m in enumerate(n.tolist())])
    far = (x > c.length_min_m) & (np.arange(x.shape[1]) < n[:, None])
    above = far.any(axis=1) & (z[:, 0] + c.mast_m >= np.where(far, z, -np.inf).max(axis=1, initial=-np.inf) + c.terminal_m)
    least, most = np.where(above, low_min, up_min), np.where(above, low_max, up_max)
    p = Profiles(hw, x, z, n)
    ends: list[list[tuple[int, int, list[int]]]] = [[] for _ in range(len(n))]
    # (line, place, height, last slope, line laid, supports)
    states = [(k, 0, c.mast_m, math.nan, 0.0, []) for k in np.flatnonzero((n > 1) & ~((least == 0) & (most == 0))).tolist()]
    for used in range(c.supports_max + 1):
        if not states:
            break
        line, at, height, slope, laid = (np.array([q[k] for q in states], kind) for k, kind in enumerate((int, int, float, float, float)))
        near = p.x[line] - p.x[line, at][:, None] < c.span_min_m
        goals = ~near & np.isfinite(p.x[line])
        for q, found in zip(states, p.ends(line, at, height, slope, laid, least[line], most[line], goals & (p.x[line] >= c.length_min_m), c.terminal_m, 1), strict=True):
            ends[q[0]] += [(j, -used, q[5]) for j, _, _ in found]
        on = np.array([not any(e[0] == n[k] - 1 for e in ends[k]) for k in line.tolist()], bool)
        if used == c.supports_max or not on.any():
            break
        states = [q for q, k in zip(states, on.tolist(), strict=True) if k]
        line, at, height, slope, laid, goals = line[on], at[on], height[on], slope[on], laid[on], goals[on]
        goals &= np.arange(goals.shape[1]) < (n[line] - 1)[:, None]
        more: dict[int, list] = {}
        for q, found in zip(states, p.ends(line, at, height, slope, laid, least[line], most[line], goals, c.support_m, beam), strict=True):
            more.setdefault(q[0], []).extend((q[0], j, c.support_m, t, q[4] + m, [*q[5], j]) for j, t, m in found)
        states = [q for some in more.values() for q in sorted(some, key=lambda q: -q[1])[: max(1, beam)]]
    best = [max(e, key=lambda q: (q[0], q[1])) if e else None for e in ends]
    return [e and (e[0], e[2], 1 if up else -1) for e, up in zip(best, above.tolist(), strict=True)]


#: Lines solved together; it bounds a task's memory.
TOGETHER = 4000
#: Lines, then (with supports -1) the longest line of a tile over each cell.
FOUND = "depart long, azimuth int, length_m double, supports int, direction int, support_steps array<int>, surface_ha double, volume_m3 double, cell long"


def scan(cells: DataFrame, starts: DataFrame, config: Config, res: float = 5.0, azimuths: list[int] | None = None, footprint: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines, covered): lines (depart, azimuth, length_m, supports, direction, support_steps, surface_ha, volume_m3, ipc) and
    covered (cell, depart, azimuth, length_m), each cell's longest line, ties to the first start and azimuth. With `footprint`, lines
    have the cells under them too, as `roads.line_footprint` finds them.

    cells: cell, r, c, z, forest, aspect_deg, slope_pct, volume. starts: (src, r0, c0, z0, start). As in `rays.swept`, starts are
    dealt to tiles and cells to every tile within reach; a task holds one tile's window and some thousand lines at a time."""
    c = config.cable
    step, stride, _ = cable_precision(c.precision)
    az = azimuths if azimuths is not None else list(range(0, 360, step))
    picked = starts.where(F.pmod(F.col("src"), F.lit(stride)) == 0) if stride > 1 else starts
    pad, steps = 0, {a: [(0, 0, 0.0)] for a in az}
    for a, _, dr, dc, hd in rays.straight_rays(res, c.length_max_m, az):
        steps[a].append((dr, dc, hd))
        pad = max(pad, abs(dr), abs(dc))
    longest = max(map(len, steps.values()), default=1)
    span = max(32, pad)
    wide = span + 2 * pad
    offsets, hds, has = np.zeros((len(az), longest), np.int64), np.zeros((len(az), longest)), np.zeros((len(az), longest), bool)
    for k, a in enumerate(az):
        n = len(steps[a])
        offsets[k, :n], hds[k, :n], has[k, :n] = [dr * wide + dc for dr, dc, _ in steps[a]], [hd for *_, hd in steps[a]], True
    layers = {"z": "z", "forest": "CAST(forest AS INT)", "aspect_deg": "aspect_deg", "slope_pct": "slope_pct", "volume": "coalesce(volume, 0)"}
    tile = lambda x: F.floor(x / span).cast("int")
    near = lambda x: F.explode(F.sequence(tile(F.col(x) - pad), tile(F.col(x) + pad)))
    dealt = cells.select("cell", "r", "c", *[F.expr(e).cast("double").alias(x) for x, e in layers.items()]).withColumn("tr", near("r")).withColumn("tc", near("c"))
    asked = picked.select(F.col("src").cast("long").alias("src"), "r0", "c0", tile(F.col("r0")).alias("tr"), tile(F.col("c0")).alias("tc"))
    dealt = dealt.join(asked.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
    azs = np.array(az, np.int32)
    schema = FOUND + ", cells array<long>" * footprint

    def run(key: tuple, ask: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        place = lambda r, c: (r.to_numpy(np.int64) - key[0] * span + pad) * wide + c.to_numpy(np.int64) - key[1] * span + pad
        window = {x: np.full(wide * wide, np.nan) for x in layers}
        cell, there = np.zeros(wide * wide, np.int64), np.zeros(wide * wide, bool)
        at = place(here["r"], here["c"])
        cell[at], there[at] = here["cell"], True
        for x in layers:
            window[x][at] = here[x]
        order = np.argsort(ask["src"].to_numpy(), kind="stable")
        src, first = ask["src"].to_numpy()[order], place(ask["r0"], ask["c0"])[order]
        hw, out = Hardware(c), []
        over = {"length_m": np.zeros(wide * wide), "depart": np.zeros(wide * wide, np.int64), "azimuth": np.zeros(wide * wide, np.int32)}
        some = max(1, 2 * TOGETHER // max(1, len(az)))
        for k in range(0, len(src), some):
            own, turn = np.repeat(np.arange(k, min(k + some, len(src))), len(az)), np.tile(np.arange(len(az)), min(some, len(src) - k))
            out.append(lines_from(hw, res, src[own], azs[turn], first[own][:, None] + offsets[turn], hds[turn], has[turn], window, there, cell, over))
        best = np.flatnonzero(over["length_m"] > 0)
        out.append(pd.DataFrame({x: v[best] for x, v in over.items()} | {"supports": -1, "direction": 0, "support_steps": None, "surface_ha": 0.0, "volume_m3": 0.0, "cell": cell[best], "cells": None}))
        return pd.concat([x for x in out if len(x)] or out[:1]).reindex(columns=[x.split()[0] for x in schema.split(", ")])

    def lines_from(hw, res, src, azimuth, at, hd, own, window, there, cell, over) -> pd.DataFrame:
        own = own & there[at]
        profile = {x: np.where(own, window[x][at], np.nan) for x in ("z", "forest", "aspect_deg", "slope_pct")}
        end = rays.check_rows(azimuth, hd, *profile.values(), config)
        good = np.flatnonzero(end > 0)
        inside = own[good] & (np.arange(own.shape[1]) <= end[good][:, None])
        n, rows = inside.sum(axis=1), at[good]
        x, z, rows = rays.to_front(inside, hd[good], profile["z"][good], rows)
        wide = max(2, int(n.max(initial=0)))
        found = [f for m in range(0, len(good), TOGETHER) for f in lines_of(hw, *(v[m : m + TOGETHER] for v in (x[:, :wide], z[:, :wide], n)), c.precision)]
        kept = np.array([k for k, f in enumerate(found) if f], np.int64)
        last = np.array([found[k][0] for k in kept], np.int64)
        wooded = (np.arange(rows.shape[1]) <= last[:, None]) & (window["forest"][rows[kept]] == 1)
        some = wooded.any(axis=1)
        kept, last, wooded = kept[some], last[some], wooded[some]
        rows, length = rows[kept], x[kept, last]
        line = {"depart": src[good[kept]], "azimuth": azimuth[good[kept]], "length_m": length}
        # the last to be written stays: the longest, then the first start and azimuth (lines come in that order)
        to_best = np.lexsort((-np.arange(len(kept)), length))
        flat, of = rows[to_best][wooded[to_best]], np.repeat(to_best, wooded[to_best].sum(axis=1))
        top = np.full(len(there), -1)
        top[flat] = of
        hit = np.flatnonzero(top >= 0)
        hit = hit[length[top[hit]] > over["length_m"][hit]]  # starts come in order: on ties what is there stays
        for name, v in over.items():
            v[hit] = line[name][top[hit]]
        area = res * res / 10000
        if footprint:
            line["cells"] = [under[1:m] for under, m in zip(cell[rows], (last + 1).tolist(), strict=True)]
        return pd.DataFrame(line | {"supports": [len(found[k][1]) for k in kept], "direction": [found[k][2] for k in kept], "support_steps": [found[k][1] for k in kept], "surface_ha": wooded.sum(axis=1) * area, "volume_m3": np.cumsum(np.where(wooded, window["volume"][rows], 0), axis=1)[:, -1] * area, "cell": 0})

    # more tasks than tiles come to one: whole tiles differ in work
    tasks = max(192, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = lambda df: df.repartition(tasks, "tr", "tc").groupBy("tr", "tc")
    found = written(by(asked).cogroup(by(dealt)).applyInPandas(run, schema), "found")  # two results are made of it
    lines = found.where("supports >= 0").drop("cell").withColumn("ipc", F.col("volume_m3") / F.col("length_m"))
    best = found.where("supports < 0").groupBy("cell").agg(F.max(F.struct("length_m", (-F.col("depart")).alias("s"), (-F.col("azimuth")).alias("a"))).alias("b"))
    return lines, best.select("cell", (-F.col("b.s")).alias("depart"), (-F.col("b.a")).alias("azimuth"), F.col("b.length_m").alias("length_m"))
