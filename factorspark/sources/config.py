"""YAML configuration and text/CSV sinks."""

from __future__ import annotations

import logging
from pathlib import Path

import yaml
from pyspark.sql import DataFrame

from factorspark.operators.costs import CostModel

log = logging.getLogger(__name__)


def load_yaml(path: str | Path) -> dict:
    """A YAML file's mapping; empty with a warning where there is none."""
    p = Path(path)
    if not p.exists():
        log.warning("no configuration at %s", p)
        return {}
    return yaml.safe_load(p.read_text()) or {}


def load_cost_model(path: str | Path) -> CostModel:
    """The ``costs`` block of a YAML file; costs nothing where the file is missing."""
    costs = load_yaml(path).get("costs") or {}
    return CostModel(**{k: float(v) for k, v in costs.items() if k in ("commission_per_share", "slippage_bps")})


def write_csv(df: DataFrame, path: str, *, order: list[str] | None = None) -> None:
    """A small result table as one CSV file with a header."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_text(path: str | Path, text: str) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
