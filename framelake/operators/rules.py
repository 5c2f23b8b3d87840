"""Rule sets as named conditions: a row per broken rule, all evaluated in one pass over the input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failing(df: DataFrame, keys: list[str], rules: dict[str, Column], name: str = "code") -> DataFrame:
    """One row per key and rule whose condition holds; a null condition counts as not broken."""
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in rules.items()]))
    return df.select(*keys, F.explode(broken).alias(name))


def unless(good: Column) -> Column:
    """Broken unless the condition holds; null counts as broken."""
    return ~F.coalesce(good, F.lit(False))


def pluck(items: Column, field: str) -> Column:
    return F.transform(items, lambda item: item.getField(field))


def repeated(items: Column) -> Column:
    return F.size(F.array_distinct(items)) != F.size(items)


def any_of(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(items, test)


def all_in(items: Column, allowed: Column) -> Column:
    return F.size(F.array_except(items, allowed)) == 0
