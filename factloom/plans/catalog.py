"""The registered queries of the reference's operators and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that each hold QUERIES (name -> function) and ORACLES (name -> SQL).
MODULES: tuple[str, ...] = ("structured", "texts", "retrieval", "structure", "graphs", "service", "labels", "fusion", "facts_built", "evidence", "knowledge", "composed", "streams", "passages", "fed", "recorded", "judged", "units")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"factloom.plans.{name}")
        for key, value in getattr(module, attribute).items():
            if key in out:
                raise ValueError(f"query registered twice: {key}")
            out[key] = value
    return out


def queries() -> dict[str, Query]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
