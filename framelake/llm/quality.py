"""Quality rules: gradient-boosted trees over document statistics.

Every text is read whole and condensed to the counts of ``COUNTS`` and the ratios of ``FEATURES``.
Two fixed rules fail a document outright (``base_failed``): fewer than ``MIN_WORDS`` words, or more
than half of its words in repeated three-word windows. The rest is left to the trees: binary
log-loss boosting over binned features, each tree grown level by level with second-order gains. A
split on a feature with a constraint is only made if it moves the score the right way, and both
sides are bounded by the middle of their weights, so the score is monotonic in that feature as a
whole. The ensemble is kept as flat arrays (feature, threshold, left child, value) of all trees and
applied to a batch level by level with numpy indexing.

The trees are fitted on at most ``sample`` labelled documents of either class, those with the
smallest hash of the id; scoring runs inside the scan's tasks and shuffles nothing.

Nulls: a null text is an empty one (no words, fails the base rule). Rows without id or label are not
learned from. Where one class has no labelled document the trees are empty and every document that
passes the base rules is kept. Repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import text as T

SAMPLE = 4_000
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Derived feature and its constraint: +1 the score may only rise with it, -1 only fall, 0 free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "distinct_share": 0, "letter_share": 1, "digit_share": 0, "upper_share": 0, "stop_share": 0,
    "top_word_share": -1, "long_word_share": 0, "words_per_line": 0, "ended_line_share": 0,
}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts and the features of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    spaces = sum(raw.count(T.SPACES[i : i + 1]) for i in range(len(T.SPACES)))
    chars = len(text) - spaces
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip(T.SPACES)]
    dup_lines = len(lines) - len(set(lines))
    hashes = T.hashed(words)
    repeated = 0
    if n >= 3:
        runs = T.windows(hashes, 3)
        order = np.argsort(runs, kind="stable")
        same = runs[order][1:] == runs[order][:-1]
        twice = np.zeros(len(runs) + 1, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice = twice[: len(runs)]
        covered = np.zeros(n, dtype=bool)
        for i in range(3):
            covered[i : i + len(runs)] |= twice
        repeated = int(covered.sum())
    counts = [n, chars, symbols, dup_lines, repeated]
    if not n:
        return counts, [0.0] * len(FEATURES)
    kinds, times = np.unique(hashes, return_counts=True)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    body = np.frombuffer(raw, dtype=np.uint8)
    upper = int(((body >= 65) & (body <= 90)).sum())
    lower = int(((body >= 97) & (body <= 122)).sum())
    digits = int(((body >= 48) & (body <= 57)).sum())
    wide = int((body >= 128).sum())
    ended = sum(x.rstrip(T.SPACES)[-1:] in b".!?" for x in lines)
    return counts, [
        float(np.log1p(n)), chars / n, symbols / n, dup_lines / len(lines), repeated / n, len(kinds) / n,
        (upper + lower + wide) / len(body), digits / len(body), upper / len(body), float((lengths <= 3).mean()),
        float(times.max() / n), float((lengths >= 15).mean()), float(np.log1p(n / len(lines))), ended / len(lines),
    ]


@dataclass
class Trees:
    """Flat nodes of all trees; a leaf points at itself. ``roots`` holds the first node of every tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document; x is (rows, features)."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            inner = self.left[at] != at
            at = np.where(inner, self.left[at] + (x[rows, self.feature[at]] > self.threshold[at]), at)
        z = self.base + self.value[at].sum(axis=1) if len(self.roots) else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, constraints: list[int], trees: int = 80, depth: int = 4, rate: float = 0.15,
    bins: int = 64, penalty: float = 1.0, least: float = 2.0,
) -> Trees:
    """Second-order boosting; ``least`` is the smallest hessian sum of a leaf."""
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    none = np.empty(0, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Trees(none, np.empty(0), none, np.empty(0), none, max(base, 0.0), 0)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    feature, threshold, left, value, roots = [], [], [], [], []

    def leaf(v):
        feature.append(0), threshold.append(0.0), left.append(len(left)), value.append(v)
        return len(left) - 1

    z = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        root = leaf(-g.sum() / (h.sum() + penalty))
        roots.append(root)
        level = [(root, np.arange(len(y)), -np.inf, np.inf)]
        for _ in range(depth):
            following = []
            for node, rows, low, high in level:
                best = _best_split(binned[rows], g[rows], h[rows], cuts, constraints, penalty, least, low, high)
                if best is None:
                    continue
                j, k, wl, wr = best
                feature[node], threshold[node] = j, cuts[j][k]
                left[node] = leaf(wl)
                leaf(wr)
                mid = (wl + wr) / 2
                bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}.get(constraints[j], ((low, high), (low, high)))
                goes = binned[rows, j] > k
                following += [(left[node], rows[~goes], *bounds[0]), (left[node] + 1, rows[goes], *bounds[1])]
            level = following
        for i in range(root, len(left)):
            value[i] *= rate
        one = Trees(*map(np.array, (feature, threshold, left, value)), np.array([root]), 0.0, depth)
        at = np.full(len(y), root)
        for _ in range(depth):
            at = np.where(one.left[at] != at, one.left[at] + (x[np.arange(len(y)), one.feature[at]] > one.threshold[at]), at)
        z = z + one.value[at]
    return Trees(*map(np.array, (feature, threshold, left, value)), np.array(roots), base, depth)


def _best_split(binned, g, h, cuts, constraints, penalty, least, low, high):
    """(feature, cut, left weight, right weight) of the largest gain, or None."""
    whole, best, found = g.sum() ** 2 / (h.sum() + penalty), 1e-6, None
    for j, cut in enumerate(cuts):
        if not len(cut):
            continue
        gl = np.cumsum(np.bincount(binned[:, j], weights=g, minlength=len(cut) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, j], weights=h, minlength=len(cut) + 1))[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        wl, wr = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
        gain = -(2 * gl * wl + (hl + penalty) * wl**2 + 2 * gr * wr + (hr + penalty) * wr**2) - whole
        fit = (hl >= least) & (hr >= least) & ((wr - wl) * constraints[j] >= 0)
        if fit.any():
            k = int(np.argmax(np.where(fit, gain, -np.inf)))
            if gain[k] > best:
                best, found = gain[k], (j, k, float(wl[k]), float(wr[k]))
    return found


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learn from labelled documents: ``labels`` has doc_id and quality (1 good, 0 bad)."""
    chosen = T.labelled_sample(docs, labels, "quality", sample)
    rows = T.map_texts(chosen, ["quality"], lambda texts: [[statistics(t)[1] for t in texts]], "x array<double>").collect()
    x = np.array([r.x for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([r.quality for r in rows], dtype=np.float64), list(FEATURES.values()))


def score(docs: DataFrame, trees: Trees, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id), the counts, base_failed, score and kept."""

    def make(texts):
        got = [statistics(t) for t in texts]
        counts = np.array([c for c, _ in got], dtype=np.int64).reshape(len(got), len(COUNTS))
        scores = trees.score(np.array([f for _, f in got], dtype=np.float64).reshape(len(got), len(FEATURES)))
        return [*counts.T, scores]

    made = ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    out = T.map_texts(docs, [c for c in keep or ["doc_id"] if c not in ("base_failed", "kept")], make, made)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5))
