"""Services and layers per country, from JSON files."""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path


@lru_cache
def country(code: str, folder: str) -> dict:
    """The registry of a country: crs, services by key, layers with their service's key, sources."""
    path = Path(folder) / f"{code.upper()}.json"
    if not path.exists():
        raise KeyError(f"no registry for {code!r}; there are {', '.join(countries(folder)) or 'none'}")
    return json.loads(path.read_text())


def countries(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.json"))


def source(key: str, code: str, folder: str) -> dict:
    found = country(code, folder).get("sources", {})
    if key not in found:
        raise KeyError(f"no source {key!r}")
    return found[key]


def layer_service(key: str, code: str, folder: str) -> dict:
    """A layer's entry, with what its service adds."""
    data = country(code, folder)
    layer = data.get("layers", {}).get(key)
    if layer is None:
        raise KeyError(f"no layer {key!r}")
    return {**data.get("services", {}).get(layer.get("service"), {}), **layer}


def national_crs(code: str, folder: str) -> int:
    return int(country(code, folder)["crs"])


def clear() -> None:
    country.cache_clear()
