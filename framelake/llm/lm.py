"""Language-model scoring by deleted interpolation of word and word-pair estimates.

A text's tokens are its words (A-Z lowered) and one end. The model mixes maximum-likelihood estimates:

    p(w)     = m * c(w) / N + (1 - m) / (V + 1)
    p(w | h) = l[b] * c(h, w) / c(h) + (1 - l[b]) * p(w)        h: the token before, b = log2 c(h)

where b puts contexts into buckets of like frequency; a context never seen leaves p(w). The weights m and
l[b] are learned by expectation-maximisation on held-out counts: the training documents of one fold of
``FOLDS`` are deleted from the counts, and their tokens, reduced to how many fall into each cell of
(bucket, pair estimate, word estimate), are what the weights are fitted to. The cells are a table of
fixed size, whatever the corpus. For scoring, the counts of the deleted fold are added back.

Counts are summed over all training documents by ``exchange``: documents in chunks send the keys of
their words and pairs to buckets, and get the totals back. Keys are 64-bit hashes of the tokens; two
keys of a corpus with n distinct pairs coincide with a chance of about n * n / 2 ** 65.

Nulls and edges: a null text is empty, that is one token, the end. Every row is a document, also one that
repeats. Without training documents N and V are 0 and every token has probability 1. Without a held-out
token the weights stay at their start of one half. Empty input gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import exchange as X
from framelake.llm import text as T

FOLDS = 9
BUCKETS = 48
STEP = 0.2
ZERO = -10_000
ROUNDS = 60
RESULT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each closed by the hash of the end, and where each text starts."""
    parts = [T.hashed([*T.folded(t), b""]) for t in texts]
    sizes = np.array([len(p) for p in parts])
    return np.concatenate(parts), np.cumsum(sizes) - sizes


@dataclass
class Keyed:
    """A chunk's distinct keys and, per token, the places of its word, its pair and its context among them."""

    keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    context: np.ndarray
    starts: np.ndarray


def keyed(texts: list[str | None]) -> Keyed:
    """Words have odd keys, pairs even ones. The context of a first token counts like the end: once a document."""
    tokens, starts = _tokens(texts)
    words = T.mixed(tokens) | np.uint64(1)
    before = np.roll(words, 1)
    before[starts] = words[-1]
    pairs = T.mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens) & ~np.uint64(1)
    keys, place = np.unique(np.concatenate((words, pairs)), return_inverse=True)
    word, pair = place[: len(tokens)], place[len(tokens) :]
    context = np.roll(word, 1)
    context[starts] = word[-1]
    return Keyed(keys, word, pair, context, starts)


@dataclass
class Weights:
    """The mixture: ``word`` is m, ``pair`` is l by bucket."""

    word: float
    pair: np.ndarray


def _counted(chunk: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys of a chunk with the counts of its training documents: kept ones, deleted ones."""
    k = keyed(chunk.column("text").to_pylist())
    fold = np.repeat(chunk.column("fold").to_numpy(), np.diff(np.append(k.starts, len(k.word))))
    counts = []
    for role in (1, 2):
        mine = fold == role
        places = np.concatenate((k.word[mine], k.pair[mine]))
        counts.append(np.bincount(places, minlength=len(k.keys)))
    return k.keys, counts


def _summary(keys: np.ndarray, totals: list[np.ndarray]) -> list[int]:
    """Kept tokens and words, all tokens and words."""
    words = (keys & np.uint64(1)).astype(bool)
    kept, both = totals[0][words], (totals[0] + totals[1])[words]
    return [int(kept.sum()), int((kept > 0).sum()), int(both.sum()), int((both > 0).sum())]


def _cells(k: Keyed, kept: np.ndarray, n: int, v: int) -> np.ndarray:
    """(bucket, pair cell, word cell) of every token; cells are steps of the log of the estimate times V + 1."""
    c, h, hw = kept[k.word], kept[k.context], kept[k.pair]
    with np.errstate(divide="ignore", invalid="ignore"):
        pair = np.where((h > 0) & (hw > 0), np.rint(np.log(hw / h * (v + 1)) / STEP), ZERO)
        word = np.where(c > 0, np.rint(np.log(c / max(n, 1) * (v + 1)) / STEP), ZERO)
    return np.stack([bucket_of(h), pair.astype(np.int64), word.astype(np.int64)], axis=1)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + log2 of its count."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def learn(cells: list[tuple[int, int, int, int]]) -> Weights:
    """Expectation-maximisation over (bucket, pair cell, word cell, tokens)."""
    m, pair = 0.5, np.full(BUCKETS, 0.5)
    if not cells:
        return Weights(m, pair)
    b, i, j, n = np.array(cells, dtype=np.float64).T
    value = lambda cell: np.where(cell == ZERO, 0.0, np.exp(np.clip(cell * STEP, -500, 500)))
    r2, r1, b = value(i), value(j), b.astype(np.int64)
    for _ in range(ROUNDS):
        m = float(np.clip((n * m * r1 / (m * r1 + 1 - m)).sum() / n.sum(), 1e-6, 1 - 1e-6))
    lower = m * r1 + 1 - m
    tokens = np.bincount(b, weights=n, minlength=BUCKETS)
    for _ in range(ROUNDS):
        share = n * pair[b] * r2 / (pair[b] * r2 + (1 - pair[b]) * lower)
        mine = np.bincount(b, weights=share, minlength=BUCKETS)
        pair = np.clip(np.where(tokens > 0, mine / np.maximum(tokens, 1), pair), 1e-6, 1 - 1e-6)
    return Weights(m, pair)


def probabilities(c, h, hw, n: int, v: int, w: Weights) -> np.ndarray:
    """p(w | h) from the counts of word, context and pair."""
    word = w.word * c / n + (1 - w.word) / (v + 1) if n else np.ones(len(c))
    weight = np.where(h > 0, w.pair[bucket_of(h)], 0.0)
    return weight * hw / np.maximum(h, 1) + (1 - weight) * word


def score(docs: DataFrame, training: Column, deleted: Column, parts: tuple[int, int] | None = None) -> DataFrame:
    """``RESULT`` for every document. ``training`` holds for the documents to learn from, ``deleted`` for
    those of them whose counts serve to learn the weights."""
    spark = docs.sparkSession
    T.bounded_batches(spark)
    fold = F.when(F.coalesce(training, F.lit(False)), F.when(F.coalesce(deleted, F.lit(False)), 2).otherwise(1)).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long"), "text", fold.alias("fold"))
    chunks, buckets = parts or X.sizes(rows)
    apart = max(1, -(-chunks // FOLDS))
    chunk = F.when(F.col("fold") == 2, chunks + X.chunk_of(apart, "doc_id", "text")).otherwise(X.chunk_of(chunks, "doc_id", "text"))
    rows = rows.withColumn("chunk", chunk)
    told = T.stored(X.answers(X.requests(rows, buckets, _counted), 2, _summary), "lm")
    said = told.where("chunk = -1").agg(*[F.sum(F.col("summary")[i]).alias(f"s{i}") for i in range(4)]).first()
    kept_n, kept_v, n, v = [int(x or 0) for x in said]
    given = told.where("chunk >= 0").withColumnRenamed("chunk", "_chunk").select("_chunk", "bucket", "totals")

    def cells(key, chunk: pa.Table, answer: pa.Table) -> pa.Table:
        k = keyed(chunk.column("text").to_pylist())
        kept, _ = X.received(answer, k.keys, buckets, 2)
        found, times = np.unique(_cells(k, kept, kept_n, kept_v), axis=0, return_counts=True)
        return pa.table({"b": found[:, 0], "i": found[:, 1], "j": found[:, 2], "n": times})

    held = rows.where("fold = 2").groupBy("chunk").cogroup(given.where(F.col("_chunk") >= chunks).groupBy("_chunk"))
    counted = held.applyInArrow(cells, "b long, i long, j long, n long").groupBy("b", "i", "j").agg(F.sum("n").alias("n"))
    weights = learn([tuple(r) for r in counted.collect()])

    def scores(key, chunk: pa.Table, answer: pa.Table) -> pa.Table:
        k = keyed(chunk.column("text").to_pylist())
        kept, gone = X.received(answer, k.keys, buckets, 2)
        counts = kept + gone
        c, h, hw = counts[k.word], counts[k.context], counts[k.pair]
        summed = lambda x: np.add.reduceat(x, k.starts)
        return pa.table({
            "doc_id": chunk.column("doc_id"),
            "n_tokens": np.diff(np.append(k.starts, len(c))),
            "n_known": summed((c > 0).astype(np.int64)),
            "train_tokens": np.full(len(k.starts), n),
            "base_score": summed(np.log10((c + 0.1) / (n + 0.1 * (v + 1)))),
            "score": summed(np.log10(probabilities(c, h, hw, n, v, weights))),
        })

    return rows.groupBy("chunk").cogroup(given.groupBy("_chunk")).applyInArrow(scores, RESULT)
