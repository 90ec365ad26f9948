"""Settings from several places, the nearest first: given, Spark's own, a file of properties, environment.

A setting has a dotted name. Spark's place is ``spark.tarnflow.`` and the name; the file has lines of
``name = value``; the environment has TARNFLOW_ and the name in capitals with underscores, or an alias.
Blank values count as none.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import SparkSession


def properties(text: str) -> dict[str, str]:
    """Lines of ``name = value`` (or ``name: value``); lines that begin with # or ! say nothing."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            at = min((line.index(c) for c in "=:" if c in line), default=len(line))
            out[line[:at].strip()] = line[at + 1 :].strip()
    return out


class Settings:
    def __init__(self, spark: SparkSession | None = None, given: Mapping[str, str] | None = None, file: str | None = None, environment: Mapping[str, str] | None = None):
        self.environment = os.environ if environment is None else environment
        self.tiers: list[Mapping[str, str]] = [given or {}]
        if spark is not None:
            prefix = "spark.tarnflow."
            self.tiers.append({k.removeprefix(prefix): v for k, v in spark.sparkContext.getConf().getAll() if k.startswith(prefix)})
        file = file or self.environment.get("TARNFLOW_CONFIG")
        if file:
            with open(file, encoding="utf-8") as f:
                self.tiers.append(properties(f.read()))

    def text(self, name: str, default: str | None = None, alias: str | None = None) -> str | None:
        names = [name, *([alias] if alias else [])]
        for key in names:
            for tier in self.tiers:
                if (tier.get(key) or "").strip():
                    return tier[key].strip()
        for key in ["TARNFLOW_" + n.upper().replace(".", "_") for n in names]:
            if (self.environment.get(key) or "").strip():
                return self.environment[key].strip()
        return default

    def number(self, name: str, default: int, alias: str | None = None) -> int:
        """A whole number; text that isn't one is an error that names the setting."""
        found = self.text(name, None, alias)
        if found is None:
            return default
        try:
            return int(found)
        except ValueError:
            raise ValueError(f"{name} is not a whole number: {found!r}") from None

    def flag(self, name: str, default: bool, alias: str | None = None) -> bool:
        found = self.text(name, None, alias)
        return default if found is None else found.lower() in ("true", "yes", "on", "1")
