"""Canonical JSON, content hashes and keyed signatures."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Keys that describe where a document came from, not what it says.
PROVENANCE_KEYS = (
    "animationContractSha256",
    "selectionApprovalSha256",
    "frameApprovalSha256",
    "snapReceiptSha256",
)


def canonical_json(text: Column) -> Column:
    """Compact JSON with the keys of every object sorted by code unit; null for text that is no JSON. Numbers must be integers."""
    return F.to_json(F.try_parse_json(text))


def stable_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def packed_hash(value: Column) -> Column:
    """A hex SHA-256 as its 32 bytes, half the text; any other text as its own bytes and 33 zeros, so none is taken for another."""
    other = F.concat(F.encode(value, "UTF-8"), F.lit(bytes(33)))
    return F.when(value.rlike("\\A[a-f0-9]{64}\\z"), F.unhex(value)).otherwise(other)


def signer(key: bytes, domain: str):
    """Column function: HMAC-SHA256 over domain, NUL and canonical JSON.

    The key stays inside the function's closure, so neither plans nor the UI print it.
    """
    lead = domain.encode() + b"\0"

    @F.pandas_udf(StringType())
    def sign(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda p: None if p is None else hmac.new(key, lead + p.encode(), hashlib.sha256).hexdigest())

    return lambda text: sign(canonical_json(text))


def _without_provenance(value):
    if isinstance(value, dict):
        return {k: _without_provenance(v) for k, v in value.items() if k not in PROVENANCE_KEYS}
    if isinstance(value, list):
        return [_without_provenance(v) for v in value]
    return value


@F.pandas_udf(StringType())
def strip_provenance(documents: pd.Series) -> pd.Series:
    """The document without its provenance keys at any depth; null for text that is no JSON."""

    def strip(document):
        try:
            return json.dumps(_without_provenance(json.loads(document)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return documents.map(strip)


def rows_hash(pairs: Column) -> Column:
    """Hash of an ordered list of structs as a JSON list."""
    return F.sha2(F.to_json(pairs), 256)
