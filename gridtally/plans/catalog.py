"""Named sources: a catalogue that resolves a name and arguments to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from gridtally.functions.scalars import cache_key, fill_template

LEVELS = {"hot": StorageLevel.MEMORY_AND_DISK, "warm": StorageLevel.DISK_ONLY, "cold": None}


@dataclass
class Catalog:
    """Loaders by name. A resolved frame is kept by name, arguments and columns, at its tier's storage level."""

    spark: SparkSession
    loaders: dict[str, tuple[Callable[..., DataFrame], str]] = field(default_factory=dict)
    kept: dict[str, DataFrame] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def register(self, name: str, load: Callable[..., DataFrame], tier: str = "cold") -> None:
        self.loaders[name] = (load, tier)

    def register_path(self, name: str, template: str, tier: str = "cold") -> None:
        """A Parquet source whose path has {slots} for arguments."""
        self.register(name, lambda **args: self.spark.read.parquet(fill_template(template, args)), tier)

    def resolve(self, name: str, /, fields: list[str] | None = None, **args) -> DataFrame | None:
        """The frame; None for a disabled name. Unknown columns are ignored; no columns is no filter."""
        name = name.rsplit(":", 1)[-1]
        if name in self.disabled:
            return None
        key = cache_key(name, args, fields)
        if key not in self.kept:
            load, tier = self.loaders[name]
            frame = load(**args)
            if fields:
                frame = frame.select(*(c for c in frame.columns if c in fields))
            self.kept[key] = frame.persist(LEVELS[tier]) if LEVELS[tier] else frame
        return self.kept[key]

    def write(self, name: str, frame: DataFrame, path: str, version: str) -> None:
        """Writes a new version and lets later reads see it."""
        if not version:
            raise ValueError("a version is needed")
        frame.write.mode("error").parquet(f"{path}/version={version}")
        for key in [k for k in self.kept if k.startswith(f"{name}?")]:
            self.kept.pop(key).unpersist()
