"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

A text is read whole and condensed to the statistics of ``STATISTICS``: sizes and counts go through a
logarithm, shares through a logarithm with a small offset, so that each is roughly bell-shaped. Either
class (label 1 good, 0 bad) is a normal distribution over these. A class covariance is estimated from few
rows in many directions, so it is shrunk twice: towards the covariance within both classes, the more the
fewer rows the class has, and then towards a multiple of the identity by the oracle-approximating weight,
which follows from its trace and the number of rows. The score is the probability of label 1 from the
difference of the two log densities (half the squared Mahalanobis lengths, and the log determinants) and
the log odds of the classes. The factors of both covariances are computed once and kept in the model.

Learning needs only the number, sum and sum of products of each class, which tasks add up and Spark
merges, so it uses every labelled document and no sample. Texts are read once: statistics are written to
the shared folder (some 120 bytes a document), joined with the labels from there, and scored from there.

Nulls: a null text is an empty one; its statistics are those of no words, and it is scored like any other.
Rows with a null id, or labels other than 0 and 1, are not learned from; a document that carries two labels
counts with both. Where a class has no labelled document every score is the share of label 1 (0.5 without
labels). Repeated rows are learned from and scored one by one. Values further than ``REACH`` standard
deviations from the mean count as that far, so one odd text cannot decide a covariance. Columns with the
names of the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import text as T

STATISTICS = (
    "words", "word_length", "word_spread", "symbols", "marks", "digits", "upper", "wide", "distinct", "commonest",
    "neighbours", "line_words", "lines_again", "ended", "spaces",
)
REACH = 8.0
FAINT = 20
THRESHOLD = 0.3
_UPPER, _LOWER, _DIGIT = (np.arange(ord(a), ord(b) + 1) for a, b in ("AZ", "az", "09"))
_SENTENCE = np.frombuffer(b".,;:!?'\"-()", dtype=np.uint8)
_SYMBOL = np.array([c for c in range(33, 127) if not chr(c).isalnum() and c not in _SENTENCE])
_SPACE = np.frombuffer(T.SPACES, dtype=np.uint8)


def _share(part: float, whole: float, usual: float) -> float:
    """Logarithm of a share, to which ``FAINT`` more members with the usual share are added, so that few say little."""
    return float(np.log((part + FAINT * usual) / (whole + FAINT) + 0.002))


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for one text."""
    raw = (text or "").encode("utf-8", "replace")
    kinds = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    n, lines = len(words), [x for x in raw.split(b"\n") if x.strip(T.SPACES)]
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    hashes = T.hashed(words)
    times = np.unique(hashes, return_counts=True)[1]
    count = lambda which: int(kinds[which].sum())
    letters = count(_UPPER) + count(_LOWER) + int(kinds[128:].sum())
    ended = sum(x.rstrip(T.SPACES)[-1:] in b".!?" for x in lines)
    mean = (float(lengths.sum()) + FAINT * 5.5) / (n + FAINT)
    spread = (float(((lengths - mean) ** 2).sum()) + FAINT * 9.0) / (n + FAINT)
    return [
        float(np.log1p(n)), float(np.log(mean)), float(np.log(spread)),
        _share(count(_SYMBOL), n, 0.0), _share(count(_SENTENCE), n, 0.15), _share(count(_DIGIT), len(raw), 0.0), _share(count(_UPPER), letters, 0.03),
        _share(int(kinds[128:].sum()), len(raw), 0.0), _share(len(times), n, 0.8), _share(int(times.max(initial=0)), n, 0.05),
        _share(int((hashes[1:] == hashes[:-1]).sum()), n, 0.0), float(np.log((n + FAINT) / (len(lines) + 1))), _share(len(lines) - len(set(lines)), len(lines), 0.0),
        _share(ended, len(lines), 0.9), _share(count(_SPACE), len(raw), 0.16),
    ]


@dataclass
class Moments:
    """Number, sum and sum of products of the rows of a class; two of them add up."""

    n: int
    total: np.ndarray
    products: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / max(self.n, 1)

    @property
    def scatter(self) -> np.ndarray:
        return self.products - np.outer(self.total, self.mean)


@dataclass
class Model:
    """Middle and scale of the statistics; per class the mean, the inverse Cholesky factor and its log determinant; log odds."""

    middle: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whiten: list[np.ndarray]
    halves: list[float]
    odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        z = np.full(len(x), self.odds)
        x = np.clip((x - self.middle) / self.scale, -REACH, REACH)
        for sign, mean, whiten, half in zip((-1, 1), self.means, self.whiten, self.halves):
            z += sign * (half - 0.5 * (((x - mean) @ whiten.T) ** 2).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def shrunk(own: np.ndarray, n: int, pooled: np.ndarray) -> np.ndarray:
    """A class covariance moved towards the pooled one, then towards a multiple of the identity."""
    p = len(own)
    share = p / (p + n)
    mixed = (1 - share) * own + share * pooled
    trace, squares = np.trace(mixed), float((mixed**2).sum())
    above, below = (1 - 2 / p) * squares + trace**2, (n + 1 - 2 / p) * (squares - trace**2 / p)
    weight = 1.0 if below <= 0 else min(1.0, above / below)
    return (1 - weight) * mixed + weight * max(trace / p, 1e-6) * np.eye(p)


def solve(bad: Moments, good: Moments, middle: np.ndarray, scale: np.ndarray) -> Model:
    """The model of two classes whose moments are those of standardised statistics."""
    total = bad.n + good.n
    if not bad.n or not good.n:
        share = np.clip(good.n / total, 1e-6, 1 - 1e-6) if total else 0.5
        return Model(middle, scale, [], [], [], float(np.log(share / (1 - share))))
    pooled = (bad.scatter + good.scatter) / total
    means, whiten, halves = [], [], []
    for one in (bad, good):
        lower = np.linalg.cholesky(shrunk(one.scatter / one.n, one.n, pooled))
        means.append(one.mean), whiten.append(np.linalg.inv(lower)), halves.append(-float(np.log(np.diag(lower)).sum()))
    return Model(middle, scale, means, whiten, halves, float(np.log(good.n / bad.n)))


def condensed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the statistics x, written to the shared folder: texts are read once."""
    made = T.map_texts(docs, keep, lambda texts: [[statistics(t) for t in texts]], "x array<double>")
    return T.stored(made, "document-statistics")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _moments(rows: DataFrame, middle: np.ndarray, scale: np.ndarray) -> tuple[Moments, Moments]:
    """Of both classes of ``rows`` (x, label): a task adds up its rows, Spark the tasks."""
    p = len(STATISTICS)

    def run(batches):
        held = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            x = np.clip((_matrix(batch.column(0)) - middle) / scale, -REACH, REACH)
            label = batch.column(1).to_numpy()
            for c in (0, 1):
                mine = x[label == c]
                held[c] += np.concatenate(([len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()))
        cell = np.arange(held.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], len(cell))), pa.array(np.tile(cell, 2)), pa.array(held.ravel())], ["label", "cell", "v"])

    cells = rows.select("x", "label").mapInArrow(run, "label long, cell long, v double").groupBy("label", "cell").agg(F.sum("v").alias("v"))
    held = np.zeros((2, 1 + p + p * p))
    for row in cells.collect():  # 2 * 241 numbers
        held[row.label, row.cell] = row.v
    return tuple(Moments(round(h[0]), h[1 : 1 + p], h[1 + p :].reshape(p, p)) for h in held)


def fit(rows: DataFrame, labels: DataFrame, mark: str = "quality") -> Model:
    """Learn from all of ``rows`` (doc_id, x) that ``labels`` marks 0 or 1: first the scale, then the classes."""
    marked = labels.where(F.col(mark).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(mark).cast("int").alias("label"))
    known = T.stored(rows.join(marked, F.col("doc_id") == F.col("_id")).select("x", "label"), "labelled-statistics")
    p = len(STATISTICS)
    middle, scale = np.zeros(p), np.ones(p)
    for _ in range(2):  # the second time without what lies beyond REACH of the first
        bad, good = _moments(known, middle, scale)
        both = Moments(bad.n + good.n, bad.total + good.total, bad.products + good.products)
        spread = np.sqrt(np.maximum(np.diag(both.scatter) / max(both.n, 1), 0)) if both.n else np.ones(p)
        middle, scale = middle + scale * both.mean, scale * np.where(spread > 1e-6, spread, 1.0)
    return solve(*_moments(known, middle, scale), middle, scale)


def score(rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``rows`` of ``condensed`` with score and predicted in place of x."""
    keep = [c for c in rows.columns if c.lower() not in ("x", "score", "predicted")]
    source = rows.select("x", *keep)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.score(_matrix(batch.column(0))))], [*keep, "score"])

    scored = source.mapInArrow(run, source.drop("x").schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, learns: Column, keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` (default doc_id) with score and predicted; learned where ``learns`` holds of keep's columns."""
    keep = keep or ["doc_id"]
    rows = condensed(docs, keep if "doc_id" in keep else [*keep, "doc_id"])
    return score(rows, fit(rows.where(learns), labels), threshold).select(*keep, "score", "predicted")
