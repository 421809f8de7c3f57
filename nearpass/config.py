"""Pipeline settings: one dataclass per block, read from nested dictionaries or files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

from nearpass.operators.detect import DetectRules


@dataclass(frozen=True)
class Window:
    start_jd: float
    end_jd: float


@dataclass(frozen=True)
class Source:
    """A release's table, window and columns; ``reject_flag`` names the column of rejected rows."""

    table: str
    max_key: int = 0
    reject_flag: str | None = None
    drop: tuple[str, ...] = ()


@dataclass(frozen=True)
class Population:
    a_min: float = 0.0
    a_max: float = float("inf")
    only_numbered: bool = True


@dataclass(frozen=True)
class PipelineConfig:
    window: Window
    population: Population = field(default_factory=Population)
    detect: DetectRules = field(default_factory=DetectRules)
    block_days: float = 30.0
    run_id: str = "run"
    output_format: str = "parquet"


def deep_merge(base: dict, override: dict) -> dict:
    """``override`` laid over ``base``, block by block."""
    out = dict(base)
    for k, v in override.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def build(cls: type, values: dict[str, Any]) -> Any:
    """An instance of a settings block; unknown and missing keys are errors that name them."""
    known = {f.name: f for f in fields(cls)}
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise ValueError(f"{cls.__name__}: unknown {', '.join(unknown)}")
    blocks = {"window": Window, "population": Population, "detect": DetectRules}
    try:
        return cls(**{k: build(blocks[k], v) if k in blocks and isinstance(v, dict) else v for k, v in values.items()})
    except TypeError as error:
        raise ValueError(f"{cls.__name__}: {error}") from None


def load_config(path: str, local: str | None = None) -> PipelineConfig:
    """Settings from a JSON or YAML file; a local file, if there is one, overrides it."""
    values = _read(path)
    if local:
        try:
            values = deep_merge(values, _read(local))
        except FileNotFoundError:
            pass
    return build(PipelineConfig, values)


def _read(path: str) -> dict:
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError:
                raise ValueError("YAML files need the yaml module; JSON works without") from None
            return yaml.safe_load(f) or {}
        return json.load(f)
