"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every text is read whole. Its features are the distinct character n-grams (3 to 5 characters, A-Z
lowered, the text padded by one space at both ends), hashed to ``2 ** BITS`` bins. A bin's value is
its log-count ratio ``r = ln((p + 1) / P) - ln((q + 1) / Q)``, where p and q are the labelled toxic
and other documents that hold it. A logistic regression over these scaled features gives the score.

The classifier is fitted on at most ``sample`` labelled documents of either class, those with the
smallest hash of the id; scoring runs inside tasks and shuffles nothing.

Nulls: a null text is an empty one; rows with a null label or a null id are not learned from. A
document that carries both labels is learned from with both. With no labelled document of one of
the classes every score is the share of toxic labels (0.5 without labels). Empty texts are scored
too, by the intercept. Columns the operator needs are picked by name, so extra ones do no harm; an
output name that the table already has is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.llm import text as T

BITS = 18
ORDERS = (3, 4, 5)
SAMPLE = 1_500
CHUNK = 1 << 20


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct bins of a text, in no particular order. Long texts go through in pieces that overlap by an n-gram."""
    body = " " + (text or "").encode("utf-8", "replace").lower().decode("utf-8") + " "
    seen = []
    for start in range(0, len(body), CHUNK):
        part = body[start : start + CHUNK + max(ORDERS) - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        for order in ORDERS:
            if len(codes) >= order:
                runs = np.full(len(codes) - order + 1, order, dtype=np.uint64)
                for i in range(order):
                    runs = runs * np.uint64(0x100000001B3) + codes[i : i + len(runs)]
                seen.append((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
    if not seen:
        return np.empty(0, dtype=np.int64)
    flat = np.concatenate(seen).astype(np.int64)
    places = T.worker_state("toxicity").setdefault(bits, np.zeros(1 << bits, dtype=np.int64))
    numbers = np.arange(len(flat))
    places[flat] = numbers
    return flat[places[flat] == numbers]


@dataclass
class Model:
    """Weight of every bin (already times its ratio) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[features(text)].astype(np.float64).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def fit_bins(rows: list[np.ndarray], labels: np.ndarray, steps: int = 110, penalty: float = 0.02) -> Model:
    """Log-count ratios, then logistic regression by accelerated gradient descent, classes weighted alike."""
    labels = np.asarray(labels, dtype=np.float64)
    size, toxic = 1 << BITS, float(labels.sum())
    clean = len(labels) - toxic
    if not toxic or not clean:
        share = 0.5 if not len(labels) else np.clip(toxic / len(labels), 1e-6, 1 - 1e-6)
        return Model(np.zeros(size, dtype=np.float32), float(np.log(share / (1 - share))))
    held, p = np.zeros(size), np.zeros(size)
    for bins, label in zip(rows, labels):
        held[bins] += 1
        p[bins] += label
    ratio = np.log((p + 1) / (toxic + 2)) - np.log((held - p + 1) / (clean + 2))
    share = np.where(labels == 1, 0.5 / toxic, 0.5 / clean)
    norm = np.array([(ratio[bins] ** 2).sum() for bins in rows])
    rate = 1.0 / (0.25 * float((share * (norm + 1)).sum()) + penalty / 10)
    w, v, b, c = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(steps):
        scaled, slope, drift = v * ratio, np.zeros(size), 0.0
        for bins, label, part in zip(rows, labels, share):  # one document at a time: little memory
            gap = part * (1 / (1 + np.exp(-np.clip(scaled[bins].sum() + c, -500, 500))) - label)
            slope[bins] += gap
            drift += gap
        new_w, new_b = v - rate * (ratio * slope + penalty / 100 * v), c - rate * drift
        pull = step / (step + 3)
        v, c = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b = new_w, new_b
    return Model((w * ratio).astype(np.float32), float(b))


def packed(bins: np.ndarray) -> bytes:
    """Bins as compressed differences, a fraction of their size on the way to the driver."""
    gaps = np.diff(np.sort(bins), prepend=0).astype("<u4")
    return len(gaps).to_bytes(4, "little") + pa.compress(gaps.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    gaps = pa.decompress(raw[4:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(gaps, dtype="<u4")).astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled documents: ``labels`` has doc_id and toxic (0 or 1)."""
    chosen = T.labelled_sample(docs, labels, "toxic", sample)
    bins = T.map_texts(chosen, ["toxic"], lambda texts: [[packed(features(t)) for t in texts]], "bins binary")
    flat, ends, given = np.empty(1 << 20, dtype=np.int32), [0], []
    for row in bins.toLocalIterator():
        mine = unpacked(row.bins)
        while ends[-1] + len(mine) > len(flat):
            flat = np.concatenate((flat, np.empty_like(flat)))
        flat[ends[-1] : ends[-1] + len(mine)] = mine  # one large block, which goes back to the system after training
        ends.append(ends[-1] + len(mine))
        given.append(row.toxic)
    return fit_bins([flat[a:b] for a, b in zip(ends, ends[1:])], np.array(given))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id) with score and predicted."""

    def make(texts):
        got = [model.score(t) for t in texts]
        return [got, [int(s >= 0.5) for s in got]]

    return T.map_texts(docs, keep or ["doc_id"], make, "score double, predicted int")
