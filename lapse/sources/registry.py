"""Datasets by name: the eight built-in ones plus any adapter a user registers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lapse.sources.adapter import Adapter
from lapse.sources.adapters import BUILT_IN
from lapse.sources.readers import input_report

_ADAPTERS: dict[str, Adapter] = {a.name: a for a in BUILT_IN}


def register_dataset(adapter: Adapter) -> Adapter:
    """Make a user-defined adapter available by its name."""
    _ADAPTERS[adapter.name] = adapter
    return adapter


def list_datasets() -> list[str]:
    return sorted(a.name for a in BUILT_IN)


def get_dataset(name: str) -> Adapter:
    key = name.lower().strip()
    if key not in _ADAPTERS:
        raise ValueError(f"unknown dataset '{name}'; available: {sorted(_ADAPTERS)}")
    return _ADAPTERS[key]


def get_ecosystem_type(name: str) -> str:
    found = _ADAPTERS.get(name.lower())
    return found.ecosystem if found else "unknown"


def catalogue(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """One metadata row per dataset."""
    rows = [get_dataset(n).metadata(spark) for n in names or list_datasets()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def adapter_inputs(spark: SparkSession, adapters: list[Adapter], roots: dict[str, str]) -> DataFrame:
    """Presence report of the inputs of several datasets; ``roots`` maps a dataset to its folder."""
    wanted = [
        (a.name, label, paths) for a in adapters for label, paths in a.inputs(roots.get(a.name, ""))
    ]
    return input_report(spark, wanted)


def expected_inputs(spark: SparkSession, names: list[str], roots: dict[str, str]) -> DataFrame:
    return adapter_inputs(spark, [get_dataset(n) for n in names], roots)
