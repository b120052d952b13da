"""Sources, in order of registration, and the settings file."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewrack.schema import SOURCE


@dataclass(frozen=True)
class Entry:
    name: str
    url: str
    color: str
    options: Mapping[str, str] = field(default_factory=dict)


class Registry:
    """Registered sources. ``options`` are those of the data source that reads them."""

    def __init__(self) -> None:
        self.entries: list[Entry] = []

    def add(self, name: str, url: str, color: str, **options: str) -> Entry:
        if any(e.name == name for e in self.entries):
            raise ValueError(f"source {name!r} is registered already")
        self.entries.append(Entry(name, url, color, options))
        return self.entries[-1]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, e.name, e.url, e.color) for k, e in enumerate(self.entries)], SOURCE)


def settings(path: str, environment: Mapping[str, str] | None = None) -> Callable[[str, str], str]:
    """``get(key, default)`` from the environment, then a file of ``KEY=value`` lines; an empty environment value falls through."""
    env = os.environ if environment is None else environment
    stored: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                if line and not line.startswith("#") and "=" in line:
                    key, _, value = line.partition("=")
                    stored[key.strip()] = value.strip().strip("\"'")
    return lambda key, default="": env.get(key) or stored.get(key) or default
