"""The parameter tree: leaves with provenance, resolved on the driver and written into plans as literals."""

from __future__ import annotations

import hashlib
import json
from copy import deepcopy
from pathlib import Path
from typing import Any

import numpy as np
import yaml
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = Path(__file__).parent / "config" / "defaults.yaml"


class ParamError(ValueError):
    """A parameter is missing, null or may not be overridden."""


def _leaves(tree: dict, at: str = "") -> dict[str, dict]:
    out: dict[str, dict] = {}
    for key, node in tree.items():
        path = f"{at}.{key}" if at else key
        if isinstance(node, dict) and "value" in node and "conf" in node:
            out[path] = node
        elif isinstance(node, dict):
            out |= _leaves(node, path)
        else:
            raise ParamError(f"{path} is not a leaf")
    return out


class Params:
    """Immutable leaves by dotted path."""

    def __init__(self, leaves: dict[str, dict]) -> None:
        self._leaves = leaves

    def leaf(self, path: str) -> dict:
        if path not in self._leaves:
            raise ParamError(f"no parameter {path}")
        return deepcopy(self._leaves[path])

    def paths(self, under: str = "") -> list[str]:
        """Paths of all leaves, or of those under one."""
        return sorted(x for x in self._leaves if not under or x == under or x.startswith(f"{under}."))

    def value(self, path: str) -> Any:
        out = self.leaf(path)["value"]
        if out is None:
            raise ParamError(f"{path} is null and needs a local value")
        return out

    def sample(self, path: str, rng: np.random.Generator) -> Any:
        """Uniform on [low, high]; the value where a leaf has no bounds."""
        leaf = self.leaf(path)
        if leaf.get("low") is None or leaf.get("high") is None:
            return self.value(path)
        return float(rng.uniform(leaf["low"], leaf["high"]))

    def with_values(self, values: dict[str, Any]) -> Params:
        """A draw's view: these values, all else unchanged."""
        leaves = dict(self._leaves)
        for path, value in values.items():
            leaves[path] = self.leaf(path) | {"value": value}
        return Params(leaves)

    def deterministic(self) -> Params:
        """The same values without bounds, so that nothing is drawn."""
        return Params({path: {k: v for k, v in leaf.items() if k not in ("low", "high")} for path, leaf in self._leaves.items()})

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self._leaves, sort_keys=True).encode()).hexdigest()

    def manifest(self) -> dict:
        """Hash, number of leaves, and paths by confidence."""
        by: dict[str, list[str]] = {}
        for path, leaf in sorted(self._leaves.items()):
            by.setdefault(leaf["conf"], []).append(path)
        return {"hash": self.hash(), "leaves": len(self._leaves), "by_conf": by}

    def table(self, spark: SparkSession) -> DataFrame:
        """(path, value, low, high, conf, scope): one row for each leaf, values as JSON."""
        rows = [(p, json.dumps(x["value"]), x.get("low"), x.get("high"), x["conf"], x["scope"]) for p, x in sorted(self._leaves.items())]
        return spark.createDataFrame([(a, b, None if c is None else float(c), None if d is None else float(d), e, f) for a, b, c, d, e, f in rows], "path string, value string, low double, high double, conf string, scope string")


def load_params(overrides: dict[str, Any] | None = None, global_overrides: dict[str, dict] | None = None, path: Path = DEFAULTS) -> Params:
    """The defaults, then a city's overrides (local leaves only), then justified overrides of global leaves."""
    leaves = _leaves(yaml.safe_load(path.read_text()))
    for key, value in (overrides or {}).items():
        if key not in leaves:
            raise ParamError(f"no parameter {key}")
        if leaves[key]["scope"] != "local":
            raise ParamError(f"{key} is global: it needs a justified override")
        leaves[key] = leaves[key] | {"value": value}
    for key, said in (global_overrides or {}).items():
        missing = {"value", "reason", "approved_by", "date"} - set(said)
        if key not in leaves or missing:
            raise ParamError(f"{key}: override lacks {sorted(missing)}" if missing else f"no parameter {key}")
        leaves[key] = leaves[key] | {"value": said["value"]}
    bad = [p for p, x in leaves.items() if x["conf"] not in ("E", "R", "G") or x["scope"] not in ("global", "local") or (x.get("low") is not None and not x["low"] <= x["value"] <= x["high"])]
    if bad:
        raise ParamError(f"invalid leaves: {bad}")
    return Params(leaves)
