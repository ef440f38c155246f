"""Features and rasters from web services, a partition per tile.

Transports are passed in, so that nothing here needs a network: a transport takes a request and returns
(status, headers, body)."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Transport = Callable[[str], tuple[int, dict, bytes]]


class Unreachable(RuntimeError):
    """A service that did not answer: never the same as an empty answer."""


class TooMuch(RuntimeError):
    """A service that gave up on the amount; a smaller box may work."""


@dataclass(frozen=True)
class Box:
    x0: float
    y0: float
    x1: float
    y1: float

    def quarters(self) -> list[Box]:
        mx, my = (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2
        return [Box(self.x0, self.y0, mx, my), Box(mx, self.y0, self.x1, my), Box(self.x0, my, mx, self.y1), Box(mx, my, self.x1, self.y1)]

    def buffered(self, d: float) -> Box:
        return Box(self.x0 - d, self.y0 - d, self.x1 + d, self.y1 + d)


def tiles(box: Box, side: float = 2000, overlap: float = 0.05) -> list[Box]:
    """Boxes of a side that cover a box, each wider by a share, so features on a seam are in both."""
    nx, ny = max(1, math.ceil((box.x1 - box.x0) / side)), max(1, math.ceil((box.y1 - box.y0) / side))
    w, h = (box.x1 - box.x0) / nx, (box.y1 - box.y0) / ny
    return [Box(box.x0 + i * w - overlap * w, box.y0 + j * h - overlap * h, box.x0 + (i + 1) * w + overlap * w, box.y0 + (j + 1) * h + overlap * h) for j in range(ny) for i in range(nx)]


def retry(call: Callable, waits: tuple[float, ...] = (1, 3), sleep: Callable[[float], None] = time.sleep):
    """call(), tried again after each wait; the last error is raised."""
    for wait in (*waits, None):
        try:
            return call()
        except Exception:
            if wait is None:
                raise
            sleep(wait)


def wfs_url(base: str, typename: str, box: Box, crs: int, start: int = 0, count: int = 1000) -> str:
    return f"{base}?SERVICE=WFS&VERSION=2.0.0&REQUEST=GetFeature&TYPENAMES={typename}&SRSNAME=EPSG:{crs}&BBOX={box.x0},{box.y0},{box.x1},{box.y1},EPSG:{crs}&OUTPUTFORMAT=application/json&STARTINDEX={start}&COUNT={count}"


def wms_url(base: str, layer: str, box: Box, crs: int, width: int, height: int, forbidden: tuple[str, ...] = ()) -> str:
    if layer in forbidden:
        raise ValueError(f"layer {layer!r} may not be used for elevation")
    return f"{base}?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS={layer}&STYLES=&CRS=EPSG:{crs}&BBOX={box.x0},{box.y0},{box.x1},{box.y1}&WIDTH={width}&HEIGHT={height}&FORMAT=image/geotiff"


def enough_finite(values, share: float = 0.9) -> bool:
    """Whether a raster has enough finite values to be used."""
    v = list(values)
    return bool(v) and sum(x is not None and math.isfinite(x) for x in v) / len(v) >= share


def overpass_query(box: Box, key: str, value: str | list[str] | None = None, timeout: int = 90) -> str:
    """Ways and relations with a tag inside (south, west, north, east)."""
    match = f'["{key}"]' if value is None else f'["{key}"="{value}"]' if isinstance(value, str) else f'["{key}"~"^({"|".join(value)})$"]'
    area = f"({box.y0},{box.x0},{box.y1},{box.x1})"
    return f"[out:json][timeout:{timeout}];(way{match}{area};relation{match}{area};);out geom;"


def verdict(status: int, body: bytes) -> str:
    """ok, quota, too_much or failed."""
    if status in (429, 504):
        return "quota"
    if not 200 <= status < 300:
        return "failed"
    try:
        data = json.loads(body)
    except ValueError:
        return "too_much"  # cut off
    remark = data.get("remark", "")
    return "too_much" if "timed out" in remark or "memory" in remark else "failed" if remark else "ok"


def overpass(box: Box, key: str, value, transport: Transport, mirrors: list[str], retries: int = 2, depth: int = 3, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Elements of a box, by mirrors in turn; too large answers are asked for in quarters. Elements come once."""
    last = "failed"
    for _ in range(retries + 1):
        for server in mirrors:
            status, headers, body = transport(f"{server}?data={overpass_query(box, key, value)}")
            last = verdict(status, body)
            if last == "ok":
                return json.loads(body)["elements"]
            if last == "too_much":
                if depth == 0:
                    raise TooMuch(f"{key} in {box}")
                found = [e for q in box.quarters() for e in overpass(q, key, value, transport, mirrors, retries, depth - 1, sleep)]
                return list({(e["type"], e["id"]): e for e in found}.values())
            if last == "quota":
                sleep(min(10.0, float(headers.get("Retry-After", 1))))
    raise Unreachable(f"no mirror answered for {key}: {last}")


class TilePartition(InputPartition):
    def __init__(self, box: Box):
        self.box = box


class TiledReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.fieldNames(), options

    def partitions(self) -> list[TilePartition]:
        o = self.options
        return [TilePartition(b) for b in tiles(Box(*(float(o[k]) for k in ("x0", "y0", "x1", "y1"))), float(o.get("side", 2000)), float(o.get("overlap", 0.05)))]

    def read(self, partition: TilePartition) -> Iterator[tuple]:
        module, name = self.options["transport"].split(":")
        transport = getattr(__import__(module, fromlist=[name]), name)

        o, waits = self.options, tuple(float(x) for x in self.options.get("waits", "1,3").split(",") if x)
        count, start = int(o.get("count", 1000)), 0

        def ask() -> dict:
            status, _, body = transport(wfs_url(o["url"], o["typename"], partition.box, int(o.get("crs", 2154)), start, count))
            if verdict(status, body) != "ok":
                raise Unreachable(f"status {status}")
            return json.loads(body)

        while True:  # page by page: a full page may have another after it
            page = retry(ask, waits)
            found = page["features"]
            for f in found:
                row = {**f.get("properties", {}), "id": f.get("id"), "geometry": json.dumps(f.get("geometry"))}
                yield tuple(row.get(n) for n in self.names)
            start += len(found)
            matched = page.get("numberMatched")
            known = matched if isinstance(matched, int) else None
            if not found or (start >= known if known is not None else len(found) < count):
                if known is not None and start < known:
                    raise Unreachable(f"{start} of {known} features of a tile came")
                return


class TiledFeatures(DataSource):
    """spark.read.format("tiled_features"): a WFS layer, a task per tile; `keep_first` on id drops seam copies.

    Options: url, typename, x0, y0, x1, y1, crs, side, overlap, count (features of a page), waits and transport
    ("module:function"). A tile is read page by page; a tile that ends before the number of features that the server
    announces raises."""

    @classmethod
    def name(cls) -> str:
        return "tiled_features"

    def schema(self) -> str:
        return "id string, geometry string"

    def reader(self, schema: StructType) -> TiledReader:
        return TiledReader(schema, self.options)
