"""Language identification: nearest of several clustered centroids per language.

A text becomes a vector of its character n-grams (1 to 3 characters of the lowered text, runs of
anything but letters read as one space), hashed to ``2 ** BITS`` bins. A bin weighs
``(1 + ln tf) * idf`` and the vector is normalised. The document frequencies behind idf come from all
training documents; the centroids are spherical k-means of at most ``sample`` training documents of
each language (and of none that the sample holds no letters of), those with the smallest hash of the id. A text gets the language of the centroid with
the largest cosine, which is its score (0 to 1).

Rejection by distance: a language's bound is the smallest cosine that ``1 - trim`` of its own sample
reaches, times ``slack``. A text below the bound of its language keeps the prediction and is marked
``rejected``; callers that would rather have no language than a wrong one use that column.

Nulls: a null text or one without letters gets ``und``, score 0 and rejected. Rows with null text or
language are not learned from. Nothing learned: every text gets ``und``. A tie goes to the language that
sorts first. Repeated rows are judged one by one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import text as T

BITS = 13
ORDERS = (1, 2, 3)
SAMPLE = 400
CENTROIDS = 4
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
CHUNK = 1 << 20


def counts(text: str | None) -> np.ndarray | None:
    """Occurrences per bin, or None for a text without letters. Long texts go through in pieces."""
    body = _OTHER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, body)):
        return None
    body = f" {body} "
    out = np.zeros(1 << BITS, dtype=np.float64)
    for start in range(0, len(body), CHUNK):
        codes = np.frombuffer(body[start : start + CHUNK + max(ORDERS) - 1].encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = codes.astype(np.uint64)
        fresh = min(CHUNK, len(body) - start)
        runs = np.zeros(len(codes), dtype=np.uint64)
        for order in range(1, max(ORDERS) + 1):
            reach = len(codes) - order + 1
            if reach <= 0:
                break
            runs = runs[:reach] * np.uint64(0x100000001B3) + codes[order - 1 :] + np.uint64(order)
            if order in ORDERS:
                bins = (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
                out += np.bincount(bins[: min(reach, fresh)].astype(np.int64), minlength=1 << BITS)
    return out


def weighted(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    out = np.log1p(found) * idf
    return out / np.maximum(np.linalg.norm(out, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Centroid rows, the language of each, its bound and the idf of the bins."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    bounds: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> list[list]:
        found = [counts(t) for t in texts]
        known = [i for i, f in enumerate(found) if f is not None]
        names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        for block in range(0, len(known) if len(self.owner) else 0, 256):
            rows = known[block : block + 256]
            close = weighted(np.stack([found[i] for i in rows]), self.idf) @ self.centroids.T
            best = close.argmax(axis=1)
            for i, k, c in zip(rows, best, close[np.arange(len(rows)), best]):
                lang = self.owner[k]
                names[i], scores[i], rejected[i] = self.languages[lang], float(np.clip(c, 0, 1)), bool(c < self.bounds[lang])
        return [names, scores, rejected]


def clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means started from rows far from each other; fewer rows give fewer centroids."""
    chosen = [int((rows @ rows.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int((rows @ rows[chosen].T).max(axis=1).argmin()))
    centre = rows[chosen]
    for _ in range(rounds):
        near = (rows @ centre.T).argmax(axis=1)
        for j in range(len(centre)):
            if (near == j).any():
                mean = rows[near == j].mean(axis=0)
                centre[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return centre


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bin, over all of ``docs``; a task emits one row per bin at most."""
    T.bounded_batches(docs.sparkSession)

    def run(batches):
        seen, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = counts(text)
                if found is not None:
                    seen += found > 0
                    n += 1
        bins = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(bins, -1)), pa.array(np.append(seen[bins], n))], ["bin", "held"])

    rows = docs.select("text").mapInArrow(run, "bin long, held long").groupBy("bin").agg(F.sum("held").alias("held")).collect()
    held, n = np.zeros(1 << BITS), 0
    for row in rows:
        if row.bin < 0:
            n = row.held
        else:
            held[row.bin] = row.held
    return held, n


def fit(docs: DataFrame, sample: int = SAMPLE, per_language: int = CENTROIDS, trim: float = 0.01, slack: float = 0.8) -> Model:
    """Learn from the documents that have a text and a ``lang``."""
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    held, n = document_frequencies(known)
    idf = np.log((n + 1) / (held + 1)) + 1
    few = T.sampled_texts(known, known, "lang", sample)
    rows = T.map_texts(few, ["lang"], lambda texts: [[_packed(t) for t in texts]], "found binary").where("found is not null").collect()
    languages = sorted({r.lang for r in rows})
    owner, centres, bounds = [], [], []
    for i, lang in enumerate(languages):
        vectors = weighted(np.stack([np.frombuffer(r.found, dtype=np.float32) for r in rows if r.lang == lang]), idf)
        mine = clusters(vectors, per_language)
        centres.append(mine)
        owner += [i] * len(mine)
        bounds.append(float(np.quantile((vectors @ mine.T).max(axis=1), trim)) * slack)
    found = np.concatenate(centres) if centres else np.empty((0, 1 << BITS))
    return Model(languages, np.array(owner, dtype=np.int64), found.astype(np.float32), np.array(bounds), idf)


def _packed(text: str | None) -> bytes | None:
    found = counts(text)
    return None if found is None else found.astype(np.float32).tobytes()


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id) with lang_pred, score and rejected."""
    return T.map_texts(docs, keep or ["doc_id"], model.predict, "lang_pred string, score double, rejected boolean")
