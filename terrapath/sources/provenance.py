"""Sidecars that say how a cached layer came about, and whether it may be used again."""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Mapping

POLICIES = ("reacquire", "warn", "accept", "refuse")


def sidecar(path: str) -> str:
    return f"{path}.provenance.json"


def write_sidecar(path: str, layer: str, source: str | None = None, params: Mapping | None = None, version: str = "0.1.0") -> None:
    with open(sidecar(path), "w") as f:
        json.dump({"layer": layer, "source": source, "version": version, "date": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "params": dict(params or {})}, f, sort_keys=True)


def read_sidecar(path: str) -> dict | None:
    try:
        with open(sidecar(path)) as f:
            return json.load(f)
    except (FileNotFoundError, json.JSONDecodeError):
        return None


def differences(found: Mapping | None, layer: str, source: str | None, params: Mapping) -> list[str]:
    """What differs; a missing sidecar or parameter differs."""
    if found is None:
        return ["sidecar"]
    out = [k for k, v in (("layer", layer), ("source", source)) if found.get(k) != v]
    have = found.get("params", {})
    return out + sorted(k for k in {*have, *params} if k not in have or k not in params or json.loads(json.dumps(params[k])) != have[k])


def usable(path: str, layer: str, source: str | None = None, params: Mapping | None = None, policy: str = "reacquire", warn=print) -> bool:
    """Whether the cached file may be used: always if nothing differs; else by policy."""
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    if not os.path.exists(path):
        return False
    diff = differences(read_sidecar(path), layer, source, params or {})
    if not diff or policy == "accept":
        return True
    if policy == "refuse":
        raise RuntimeError(f"{path} was made otherwise: {', '.join(diff)}")
    if policy == "warn":
        warn(f"{path} was made otherwise: {', '.join(diff)}")
        return True
    return False
