"""Language of whole texts by a byte convolutional network.

Windows of WINDOW bytes go through an embedding, filters of several widths, max pooling and softmax. The network is trained in numpy on a
bounded sample of labelled texts. A document's windows cover the whole text, each overlapping the one before by the widest filter less one;
its prediction is the mean of their probabilities, weighed by their bytes.

Defined results: a null text and a text without a letter are ``und`` with score 0; without training rows every text is; equal rows get equal
results; ties go to the language that sorts first; an empty table gives an empty result. Other columns are kept; those named like added ones
are replaced.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

WINDOW, EMBED, WIDTHS, FILTERS = 96, 8, (2, 3, 4), 16
#: Most labelled documents used for training (those with the smallest hash of the id), and windows of each.
MAX_LABELLED, MAX_WINDOWS = 4_000, 4
EPOCHS, BATCH, RATE = 5, 128, 0.01
_LETTER = re.compile(r"[^\W\d_]")
_STEP = WINDOW - max(WIDTHS) + 1


def windows(text):
    """(n, WINDOW) bytes, padded with zeros, that cover the text; and how many new bytes each has."""
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    n = max(1, -(-max(0, len(raw) - WINDOW) // _STEP) + 1)
    buf = np.zeros((n - 1) * _STEP + WINDOW, np.uint8)
    buf[: len(raw)] = raw
    view = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[::_STEP]
    new = np.full(n, _STEP)
    new[-1] = max(1, len(raw) - _STEP * (n - 1))
    return view, new


class Network:
    def __init__(self, labels, seed=7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.embed = (r.normal(size=(256, EMBED)) * 0.5).astype(np.float32)
        self.embed[0] = 0
        self.conv = [(r.normal(size=(w * EMBED, FILTERS)) * (2 / (w * EMBED)) ** 0.5).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (r.normal(size=(FILTERS * len(WIDTHS), len(labels))) * 0.2).astype(np.float32)
        self.shift = np.zeros(len(labels), np.float32)

    def _columns(self, x, w):
        """(n, positions, w * EMBED) embedded bytes of every place of a filter of width w."""
        e = self.embed[x]
        return np.concatenate([e[:, k : x.shape[1] - w + 1 + k] for k in range(w)], 2)

    def pooled(self, x):
        """Largest response of each filter, before bias."""
        wide = max(WIDTHS)
        every = np.concatenate([np.pad(c, ((0, (wide - w) * EMBED), (0, 0))) for w, c in zip(WIDTHS, self.conv)], 1)
        padded = np.pad(x, ((0, 0), (0, wide - min(WIDTHS))))
        y = self._columns(padded, wide) @ every
        return np.concatenate([y[:, : x.shape[1] - w + 1, k * FILTERS : (k + 1) * FILTERS].max(1) for k, w in enumerate(WIDTHS)], 1)

    def probabilities(self, x, rows=512):
        out = np.empty((len(x), len(self.labels)), np.float32)
        for k in range(0, len(x), rows):
            z = np.maximum(self.pooled(x[k : k + rows]) + self.bias, 0) @ self.out + self.shift
            z = np.exp(z - z.max(1, keepdims=True))
            out[k : k + rows] = z / z.sum(1, keepdims=True)
        return out

    def _step(self, x, y):
        """Gradients of the mean cross entropy, in the order of ``parameters``."""
        n = len(x)
        best, at = [], []
        for w, c in zip(WIDTHS, self.conv):
            r = self._columns(x, w) @ c
            at.append(r.argmax(1))
            best.append(np.take_along_axis(r, at[-1][:, None], 1)[:, 0])
        pre = np.concatenate(best, 1) + self.bias
        h = np.maximum(pre, 0)
        z = h @ self.out + self.shift
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        dh = (p @ self.out.T) * (pre > 0)
        g_embed, g_conv = np.zeros_like(self.embed), []
        for k, (w, c) in enumerate(zip(WIDTHS, self.conv)):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            seen = x[np.arange(n)[:, None, None], at[k][:, :, None] + np.arange(w)]
            cols = self.embed[seen].reshape(n, FILTERS, w * EMBED)
            g_conv.append(np.einsum("nf,nfc->cf", d, cols))
            back = (d[:, :, None] * c.T).reshape(-1, EMBED)
            for e in range(EMBED):
                g_embed[:, e] += np.bincount(seen.ravel(), back[:, e], 256)
        g_embed[0] = 0
        return [g_embed, *g_conv, dh.sum(0), h.T @ p, p.sum(0)]

    def parameters(self):
        return [self.embed, *self.conv, self.bias, self.out, self.shift]

    def fit(self, x, y, epochs=EPOCHS, batch=BATCH, rate=RATE, seed=8):
        r = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()], 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for k in range(0, len(order), batch):
                t += 1
                now = rate * (1 - 0.9 * (epoch / epochs)) * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t)
                for p, g, a, b in zip(self.parameters(), self._step(x[order[k : k + batch]], y[order[k : k + batch]]), m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (now * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts):
        """(label, score) of each text."""
        known = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if self.labels else []
        out = [("und", 0.0)] * len(texts)
        if known:
            parts = [windows(texts[k]) for k in known]
            first = np.concatenate([[0], np.cumsum([len(x) for x, _ in parts])[:-1]])
            weight = np.concatenate([w for _, w in parts]).astype(np.float64)
            p = self.probabilities(np.concatenate([x for x, _ in parts])) * weight[:, None]
            p = np.add.reduceat(p, first, 0) / np.add.reduceat(weight, first)[:, None]
            for k, row in zip(known, p):
                best = int(row.argmax())
                out[k] = (self.labels[best], float(min(1.0, max(0.0, row[best]))))
        return out


def train(docs, max_rows=MAX_LABELLED, max_windows=MAX_WINDOWS):
    """A network from at most ``max_rows`` rows (doc_id, text, lang); rows without a language or a letter don't count."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = own.filter("lang is not null and doc_id is not null and text rlike '\\\\p{L}'").select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).distinct()

    def rows(batches):
        for b in batches:
            got = []
            for doc, t, lang in zip(b["doc_id"], b["text"], b["lang"]):
                x, _ = windows(t)
                pick = x[np.unique(np.linspace(0, len(x) - 1, max_windows).astype(int))]
                got += [(doc, k, w.tobytes(), lang) for k, w in enumerate(pick)]
            yield pd.DataFrame(got, columns=["doc_id", "k", "x", "lang"])

    chosen = own.join(F.broadcast(known), ["doc_id", "lang"]).mapInPandas(rows, "doc_id long, k int, x binary, lang string")
    got = chosen.toPandas().sort_values(["doc_id", "k", "lang"], kind="stable")
    labels = sorted(got["lang"].unique())
    net = Network(labels)
    if labels:
        x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, WINDOW)
        net.fit(x, np.searchsorted(labels, got["lang"]))
    return net


def with_language(docs, net):
    """``docs`` with ``language`` (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(net.predict(list(texts)), columns=["lang_pred", "score"])

    return docs.withColumn("language", predict(F.col("text").cast("string")))
