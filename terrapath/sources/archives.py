"""Which files of a tile archive a box needs, by name or by header, before any is read."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable

from .remote import Box

GRID_KEY = re.compile(r"_(\d{4})_(\d{4})_")


def by_name(names: Iterable[str], box: Box, side: float = 5000, unit: float = 1000) -> list[str]:
    """Files whose name holds the upper left corner of a tile that meets the box; names without a key are left out."""
    out = []
    for name in names:
        m = GRID_KEY.search(name.rsplit("/", 1)[-1])
        if m:
            x, y = int(m[1]) * unit, int(m[2]) * unit
            if x <= box.x1 and x + side >= box.x0 and y - side <= box.y1 and y >= box.y0:
                out.append(name)
    return out


def las_bounds(head: bytes) -> Box | None:
    """The box in a LAS public header block; None if it is none."""
    if len(head) < 227 or head[:4] != b"LASF":
        return None
    x1, x0, y1, y0 = struct.unpack_from("<4d", head, 179)
    return Box(x0, y0, x1, y1)


def by_header(names: Iterable[str], box: Box, read_head: Callable[[str], bytes]) -> list[str]:
    """Point-cloud files whose header meets the box; one that can't be read is kept."""
    out = []
    for name in names:
        try:
            b = las_bounds(read_head(name))
        except OSError:
            b = None
        if b is None or not (b.x1 < box.x0 or b.x0 > box.x1 or b.y1 < box.y0 or b.y0 > box.y1):
            out.append(name)
    return out


def station_key(station_m: float, **parameters) -> str:
    """Cache key of a cross-section: the rounded station and all parameters."""
    return "_".join([f"{round(station_m):d}", *(f"{k}={parameters[k]}" for k in sorted(parameters))])
