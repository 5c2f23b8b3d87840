"""Extension points: source adapters and correction operations, both failing closed."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions.text import SCHEMA_ID

import re

Reader = Callable[..., DataFrame]
Operation = Callable[[DataFrame], DataFrame]


class Registry:
    """Names bound once to callables."""

    def __init__(self, what: str):
        self._what = what
        self._known: dict[str, Callable] = {}

    def register(self, name: str, fn: Callable) -> None:
        if not re.match(SCHEMA_ID, name):
            raise ValueError(f"{self._what} name is not portable: {name}")
        if not callable(fn):
            raise TypeError(f"{self._what} must be callable: {name}")
        if name in self._known:
            raise ValueError(f"{self._what} is already registered: {name}")
        self._known[name] = fn

    def get(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"{self._what} is unknown: {name}")
        return self._known[name]

    def require(self, names: Iterable[str]) -> None:
        """Fail before anything runs when any name is missing."""
        missing = sorted(set(names) - set(self._known))
        if missing:
            raise KeyError(f"{self._what} is unknown: {', '.join(missing)}")


def run_corrections(registry: Registry, plan: DataFrame, frames: DataFrame, operations: list[str]) -> DataFrame:
    """Apply named operations to the frames the plan assigns to each; preflighted as a whole.

    plan(frame_key, operation). ``operations`` is the contract's own short list of names.
    """
    registry.require(operations)
    planned = frames.join(plan, "frame_key")
    result = None
    for name in operations:
        part = registry.get(name)(planned.filter(F.col("operation") == name))
        result = part if result is None else result.unionByName(part)
    return result


def fixed_clock(timestamp: str) -> Column:
    """A job's clock as a literal, so that reruns give the same rows."""
    return F.lit(timestamp).cast("timestamp_ntz")


SOURCES = Registry("motion source")
CORRECTIONS = Registry("correction operation")
