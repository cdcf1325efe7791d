"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Trees are grown level by level in numpy on a bounded sample of labelled documents and laid out as arrays (feature, threshold, value by heap
position), so a batch of documents walks all trees with array look-ups. Statistics come from the whole text.

Defined results: a null or empty text has the statistics of an empty one and is scored like any other; without labelled rows every score is
0.5; repeated rows get equal scores; an empty table gives an empty result. Other columns are kept, whatever their names; a column named like
an added one is replaced.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .common import remainder

#: Most labelled documents used for a fit; those with the smallest hash of the id are taken.
MAX_LABELLED = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_HESSIAN = 80, 4, 48, 0.12, 2.0, 2.0
SYMBOLS = b"#*$%&|<>"
FEATURES = """chars words lines word_length upper digits symbols exclaim commas other_marks accents spaces distinct top_word adjacent dup_lines
words_per_line longest_line long_words short_words entropy end_marks capital_words alpha_words""".split()
_CLASS = np.zeros((8, 256), np.float64)
for _row, _set in enumerate([bytes(range(65, 91)), b"0123456789", SYMBOLS, b"!", b",.", b"\"'()-/:;=?@[]^_`{}~+\\", bytes(range(128, 256)), b" \t\n\r\x0b\x0c"]):
    _CLASS[_row, list(_set)] = 1


def statistics(text):
    """One row of FEATURES for a text."""
    raw = (text or "").encode("utf-8")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    share = _CLASS @ counts / n
    p = counts[counts > 0] / n
    ws = raw.split()
    k = max(1, len(ws))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    tally = {}
    for w in ws:
        tally[w] = tally.get(w, 0) + 1
    lens = np.fromiter(map(len, ws), np.int64, len(ws)) if ws else np.zeros(1, np.int64)
    return [
        np.log1p(len(raw)), np.log1p(len(ws)), np.log1p(len(lines)), lens.mean(), *share, len(tally) / k, max(tally.values(), default=0) / k,
        sum(map(bytes.__eq__, ws, ws[1:])) / k, (len(lines) - len(set(lines))) / m, k / m, np.log1p(max(map(len, lines), default=0)),
        (lens > 14).mean(), (lens < 3).mean(), -(p * np.log(p)).sum() if len(raw) else 0.0,
        sum(w[-1] in b".!?" for w in ws) / k, sum(65 <= w[0] <= 90 for w in ws) / k, sum(map(bytes.isalpha, ws)) / k,
    ]


def features(texts):
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """``feature``, ``threshold``, ``value``: one row per tree, in heap order; a node without a split sends all rows left."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x):
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        first_leaf = self.feature.shape[1] if self.feature.size else 0
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range((first_leaf + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            raw += v[at - first_leaf]
        return 1 / (1 + np.exp(-raw))


def fit(x, y, trees=TREES, depth=DEPTH, bins=BINS, rate=RATE):
    """Boosted trees for logistic loss. Splits come from gradient and curvature histograms of all features at once, level by level."""
    inner = 2**depth - 1
    if not len(x) or y.min() == y.max():
        rate0 = float(np.clip(y.mean(), 0.01, 0.99)) if len(x) else 0.5
        empty = np.zeros((0, inner))
        return Trees(np.log(rate0 / (1 - rate0)), empty.astype(np.int64), empty, np.zeros((0, inner + 1)))
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    width = max(map(len, edges)) + 1
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    slot = binned + np.arange(d) * width
    base = np.log(y.mean() / (1 - y.mean()))
    raw = np.full(n, base)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    usable = np.arange(width)[None, :] < np.array([len(e) for e in edges])[:, None]
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (d * width) + slot).ravel()
            g = np.bincount(key, np.repeat(grad, d), nodes * d * width).reshape(nodes, d, width).cumsum(2)
            h = np.bincount(key, np.repeat(hess, d), nodes * d * width).reshape(nodes, d, width).cumsum(2)
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(h < LEAST_HESSIAN) | (ht - h < LEAST_HESSIAN) | ~usable] = -1
            best = gain.reshape(nodes, -1).argmax(1)
            split = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            f, b = best // width, best % width
            cut = np.where(split, b, width)
            feature[k, first : first + nodes] = f
            threshold[k, first : first + nodes] = [edges[i][j] if s else np.inf for i, j, s in zip(f, b, split)]
            node = at - first
            at = 2 * at + 1 + (binned[np.arange(n), f[node]] > cut[node])
        leaf = at - inner
        value[k] = rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + RIDGE)
        raw += value[k][leaf]
    return Trees(base, feature, threshold, value)


def train(docs, labels, held_out=5, max_rows=MAX_LABELLED):
    """Fit on at most ``max_rows`` labelled documents outside the held-out remainder class."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder("doc_id", held_out) != 0))
    known = known.select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)

    def rows(batches):
        for b in batches:
            yield pd.DataFrame({"x": list(features(b["text"])), "quality": b["quality"], "doc_id": b["doc_id"]})

    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    got = own.mapInPandas(rows, "x array<double>, quality int, doc_id long").toPandas()
    got = got.sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, got["quality"].to_numpy(np.float64))


def with_score(docs, model, into="score"):
    """``docs`` with the model's score of ``text``."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(features(texts)))

    return docs.withColumn(into, score(F.col("text").cast("string")))
