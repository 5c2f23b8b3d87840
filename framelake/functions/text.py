"""Identifier and path predicates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Identifier patterns, reserved device names and secret-like keys, in natural order.
CONTRACT_ID = r"^[a-z0-9](?:[a-z0-9._-]{0,62}[a-z0-9])?$"
SCHEMA_ID = r"^[a-z0-9][a-z0-9._-]{0,63}$"
RUN_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
CLIP_STEM = r"^[A-Za-z0-9](?:[A-Za-z0-9._-]{0,126}[A-Za-z0-9])?$"
RESERVED_STEM = r"(?i)^(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.|$)"
UNSAFE_CHARACTER = r"[<>:\"|?*\x00-\x1f]"
SECRET_KEY = r"(?i)(?:password|passwd|secret|token|api[-_]?key|credential|private[-_]?key)"
ABSOLUTE_PATH = r"^(?:[/\\]|[A-Za-z]:[/\\])"
SHA256 = r"^[a-f0-9]{64}$"
REDACTED = "<external-path-redacted>"


def is_contract_id(value: Column) -> Column:
    """Lower-case id that starts and ends with a letter or digit."""
    return value.rlike(CONTRACT_ID)


def is_schema_id(value: Column) -> Column:
    """Lower-case id that may end in ``_`` or ``-`` but is no reserved device name."""
    return value.rlike(SCHEMA_ID) & ~value.rlike(RESERVED_STEM) & ~value.endswith(".")


def is_safe_run_id(value: Column) -> Column:
    return value.rlike(RUN_ID) & ~value.endswith(".") & ~value.rlike(RESERVED_STEM)


def is_safe_clip_stem(value: Column) -> Column:
    return value.rlike(CLIP_STEM) & ~value.rlike(RESERVED_STEM)


def is_absolute(value: Column) -> Column:
    return value.rlike(ABSOLUTE_PATH)


def is_portable_path(value: Column) -> Column:
    """Contained, normalised, relative, and made of components every platform can store."""

    def fine(part: Column) -> Column:
        return (
            ~part.isin("", ".", "..")
            & ~part.rlike(RESERVED_STEM) & ~part.rlike(UNSAFE_CHARACTER)
            & ~part.endswith(".") & ~part.endswith(" ")
        )

    return (value != "") & ~value.contains("\\") & ~is_absolute(value) & F.forall(F.split(value, "/"), fine)


@F.pandas_udf(StringType())
def portability_key(values: pd.Series) -> pd.Series:
    """Compatibility-normalised lower case; names that collide on some platform share it."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).lower())


def basename(value: Column) -> Column:
    return F.regexp_extract(value, r"([^/\\]*)$", 1)


def hide_absolute(value: Column) -> Column:
    """Absolute paths keep only their last component."""
    return F.when(is_absolute(value), F.concat(F.lit("<absolute>/"), basename(value))).otherwise(value)


def relativize(root: Column, path: Column) -> Column:
    """Path below root; null when it is not contained. Lexical only."""
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(path == root, F.lit("")).when(inside, F.substr(path, F.length(root) + 2))


def durable_path(root: Column, path: Column) -> Column:
    """Absolute paths become relative to the run, or are redacted when they lie elsewhere."""
    return F.when(is_absolute(path), F.coalesce(relativize(root, path), F.lit(REDACTED))).otherwise(path)


def ancestors(path: Column) -> Column:
    """Every prefix of an absolute path that ends at a component, the path itself included."""
    parts = F.split(F.substr(path, F.lit(2)), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))
    )
