"""Quality rules with n-gram perplexity: word statistics, and a modified Kneser-Ney model per language over characters.

Characters count as they are, with case and marks. Each task counts the 4-grams of its documents; from these Spark makes the counts of all
documents, discounts, contexts and interpolated probabilities of each order as tables dealt by language and gram: they grow with the corpus and
are never whole on one machine. Documents move once, compressed, to blocks of about BLOCK characters; a block asks for the probabilities of its
different grams by a join and scores its documents with them. A document is rejected where its log-perplexity is outside its language's
band (the middle of all documents' less LOWER and plus UPPER robust deviations), or its mean squared surprise, which single odd characters
move, is more than SQUARE robust deviations above the middle; both are wider for short texts by the square root of their length.

Defined results: a null or empty text has no words and fails the base rule; a null language is a language of its own; a language whose
documents all have one perplexity, or that has one document, rejects nothing by band; equal rows get equal results; an empty table gives an
empty result. Only doc_id, text and lang are read.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import words

#: CLASSES^ORDER fits 63 bits. Code points below CLASSES - FOLDED are told apart, those above by their remainder.
ORDER, CLASSES, FOLDED = 4, 55_108, 1021
BLOCK = 32_000_000
#: The bands in robust deviations; a text of SHORT characters may be off by the square root of two more.
LOWER, UPPER, SQUARE, SHORT = 10.0, 25.0, 6.0, 400.0
SYMBOLS = "#*$%&|<>"


def grams(text):
    """Codes of the 4-grams that end at each character; three line ends stand before the text."""
    if not text:
        return np.zeros(0, np.int64)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    s = np.full(len(code) + ORDER - 1, 10, np.int64)
    s[ORDER - 1 :] = np.where(code < CLASSES - FOLDED, code, CLASSES - FOLDED + code % FOLDED)
    out = s[: len(code)].copy()
    for k in range(1, ORDER):
        out *= CLASSES
        out += s[k : k + len(code)]
    return out


def _hash(code, order):
    x = (np.asarray(code, np.uint64) + np.uint64(order << 40)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


class HashArray:
    """Values by hashed key in a sorted array; a key that is not there has the given value."""

    def __init__(self, keys, values, missing):
        order = np.argsort(keys)
        self.keys, self.values, self.missing = keys[order], values[order].astype(np.float32), missing

    def get(self, keys):
        if not len(self.keys):
            return np.full(len(keys), self.missing, np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.float32(self.missing))


def _discounts(counts):
    n = [max(1, int((counts == k).sum())) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0] + [float(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.05, k - 0.05)) for k in range(1, 4)])


class Model:
    """Interpolated modified Kneser-Ney model from (codes, counts) of the highest order: the plain form of ``probabilities``, in memory."""

    def __init__(self, codes, counts):
        self.own, self.back = [], []
        levels = [(np.asarray(codes, np.int64), np.asarray(counts, np.int64))]
        for k in range(ORDER - 1, 0, -1):  # below: how many different classes stand before
            below, many = np.unique(levels[0][0] % CLASSES**k, return_counts=True)
            levels.insert(0, (below, many))
        for k, (code, count) in enumerate(levels, 1):
            d = _discounts(count)[np.minimum(count, 3)]
            context, at = np.unique(code // CLASSES, return_inverse=True)
            total = np.bincount(at, count)
            self.own.append(HashArray(_hash(code, k), (count - d) / total[at], 0.0))
            self.back.append(HashArray(_hash(context, k), np.bincount(at, d) / total, 1.0))

    def log_prob(self, codes):
        """Natural logarithm of each 4-gram's last class given the three before it."""
        codes = np.asarray(codes, np.int64)
        p = np.full(len(codes), 1.0 / CLASSES, np.float64)
        for k in range(1, ORDER + 1):
            code = codes % CLASSES**k
            p = self.own[k - 1].get(_hash(code, k)) + self.back[k - 1].get(_hash(code // CLASSES, k)) * p
        return np.log(p)


def base_statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    text = text or ""
    ws = words(text)
    if not ws:
        return 0, 0, sum(map(text.count, SYMBOLS)), 0, 0
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    repeat = 0
    if len(ws) > 5:
        ids = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in ws), np.int64, len(ws))
        window, size = w, 1  # windows of 2, 4 and 5 words as exact numbers: pairs of numbers are numbered anew
        for more in (1, 2, 1):
            right = window if more == size else w
            pair = window[: len(right) - size] * (len(ws) + 1) + right[size:]
            window, size = np.unique(pair, return_inverse=True)[1], size + more
        often = np.bincount(window)[window] > 1
        marked = np.zeros(len(ws) + 1, np.int64)
        at = np.flatnonzero(often)
        np.add.at(marked, at, 1)
        np.add.at(marked, at + 5, -1)
        repeat = int((np.cumsum(marked) > 0).sum())
    return len(ws), chars, sum(map(text.count, SYMBOLS)), dup, repeat


def _texts(docs, *more):
    """doc_id as a string, lang and text."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *more)


def task_grams(docs):
    """(lang, code, n, docs): 4-grams of a task's documents, and how many of these hold it. A gram may have several rows, from several tasks."""

    def rows(batches):
        waiting, size = {}, 0

        def settled():
            for lang, parts in waiting.items():
                code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([m for _, m in parts])).astype(np.int64)
                yield pd.DataFrame({"lang": pd.Series([lang] * len(code), dtype=object), "code": code, "n": n, "docs": np.bincount(at)})
            waiting.clear()

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                if text:
                    waiting.setdefault(lang, []).append(np.unique(grams(text), return_counts=True))
                    size += len(text)
            if size > BLOCK // 4:
                yield from settled()
                size = 0
        yield from settled()

    return _texts(docs).select("lang", "text").mapInPandas(rows, "lang string, code long, n long, docs long")


def gram_counts(docs):
    """(lang, code, n) over all documents."""
    return task_grams(docs).groupBy("lang", "code").agg(F.sum("n").alias("n"))


def packed(docs, n_blocks):
    """(block, texts): doc_id as a string, lang and text of the documents that are dealt to a block, as compressed Arrow streams, one or more per task."""

    def rows(batches):
        def settled(waiting):
            t = pa.Table.from_batches(waiting)
            at, own = t["block"].to_numpy(), t.drop_columns(["block"])
            blocks, streams = np.unique(at), []
            for block in blocks:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
                    out.write_table(own.filter(pa.array(at == block)).combine_chunks())
                streams.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(streams, pa.binary())], ["block", "texts"])

        waiting, size = [], 0
        for b in batches:
            waiting.append(b)
            size += b.nbytes
            if size > BLOCK:
                yield settled(waiting)
                waiting, size = [], 0
        if size:
            yield settled(waiting)

    block = F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))), F.lit(n_blocks)).cast("int")
    return _texts(docs, block.alias("block")).mapInArrow(rows, "block int, texts binary")


def _unpacked(streams):
    """Lists of doc_id, lang and text of each stream."""
    for x in streams:
        t = pa.ipc.open_stream(x).read_all()
        yield [t[c].to_pylist() for c in ("doc_id", "lang", "text")]


def _key(lang):
    """A null language as a key of joins, apart from all others."""
    return "" if lang is None else "=" + lang


def block_grams(texts):
    """(block, lang, code): the different 4-grams of each block of ``packed``, once each, with ``_key`` of their language."""

    def rows(own):
        found = {}
        for _, langs, texts in _unpacked(own["texts"]):
            parts = {}
            for lang, text in zip(langs, texts):
                if text:
                    parts.setdefault(_key(lang), []).append(np.unique(grams(text)))
            for lang, p in parts.items():
                found[lang] = np.unique(np.concatenate([*p, found.get(lang, np.zeros(0, np.int64))]))
        lang = np.repeat(np.array(list(found), dtype=object), np.array([len(c) for c in found.values()], np.int64))
        code = np.concatenate([np.zeros(0, np.int64), *found.values()])
        return pd.DataFrame({"block": np.full(len(code), own["block"].iloc[0], np.int32), "lang": lang, "code": code})

    return texts.groupBy("block").applyInPandas(rows, "block int, lang string, code long")


def probabilities(counts):
    """(lang, code, p, base): each 4-gram's last character given the three before it, and given nothing, from (lang, code, n); lang must
    not be null. ``docs`` is carried along."""
    more = [c for c in counts.columns if c == "docs"]
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):  # below: how many different characters stand before
        below = levels[0].groupBy("lang", (F.col("code") % CLASSES**k).alias("code")).agg(F.count("*").alias("n"))
        levels.insert(0, cut(below, f"grams{k}"))
    out = None
    for k, level in enumerate(levels, 1):
        seen = level.groupBy("lang").agg(*(F.greatest(F.sum((F.col("n") == q).cast("double")), F.lit(1.0)).alias(f"n{q}") for q in (1, 2, 3, 4)))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        d = [F.least(F.greatest(q - (q + 1) * y * F.col(f"n{q + 1}") / F.col(f"n{q}"), F.lit(0.05)), F.lit(q - 0.05)).alias(f"d{q}") for q in (1, 2, 3)]
        own = level.join(F.broadcast(seen.select("lang", *d)), "lang")  # one row per language
        own = own.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = W.partitionBy("lang", F.expr(f"code div {CLASSES}L"))
        kept = more if k == ORDER else []
        own = own.select("lang", "code", *kept, (F.col("n") - F.col("d")).alias("own"), F.sum("n").over(context).alias("total"), F.sum("d").over(context).alias("back"))
        lower = F.lit(1.0 / CLASSES)
        if out is not None:
            out = out.select(F.col("lang").alias("_lang"), F.col("code").alias("_code"), F.col("p").alias("_p"), "base")
            own = own.join(out, (F.col("lang") == F.col("_lang")) & (F.col("code") % CLASSES ** (k - 1) == F.col("_code")))
            lower = F.col("_p")
        p = F.col("own") / F.col("total") + F.col("back") / F.col("total") * lower
        out = own.select("lang", "code", *kept, p.alias("p"), (p if k == 1 else F.col("base")).alias("base"))
    return out


def scored(docs):
    """doc_id, lang, the base statistics, mean negative log-probability ``loss`` (grams that no other document holds count by their last
    character alone), mean squared surprise and number of characters."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    n_blocks = max(1, -(-chars // BLOCK), min(2 * spark.sparkContext.defaultParallelism, chars // (BLOCK // 64)))
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("lang")  # as _key
    counts = task_grams(docs).groupBy(key, "code").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = probabilities(cut(counts, "grams"))
    texts = packed(docs, n_blocks)
    asked = block_grams(texts).join(found, ["lang", "code"])
    outside = F.when(F.col("docs") == 1, F.col("base")).otherwise(F.col("p"))
    asked = asked.select("block", "lang", "code", (-F.log("p")).cast("float").alias("own"), (-F.log(outside)).cast("float").alias("loss"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(own, table):
        known = {}
        for lang, t in table.groupby("lang", sort=False):
            t = t.sort_values("code")
            known[lang] = tuple(t[c].to_numpy() for c in ("code", "loss", "own"))
        rows = []
        for part in _unpacked(own["texts"]):
            for doc, lang, text in zip(*part):
                mean = square = 0.0
                if text:
                    code, loss, every = known[_key(lang)]
                    at = np.searchsorted(code, grams(text))
                    mean, square = float(loss[at].mean(dtype=np.float64)), float((every[at].astype(np.float64) ** 2).mean())
                rows.append((doc, lang, *base_statistics(text), mean, square, len(text or "")))
        return pd.DataFrame(rows, columns=["doc_id", "lang", *names, "loss", "square", "length"])

    schema = "doc_id string, lang string, " + ", ".join(f"{n} long" for n in names) + ", loss double, square double, length long"
    out = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInPandas(score, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def quality_rules(docs, lower=LOWER, upper=UPPER, short=SHORT, square=SQUARE):
    """doc_id, base statistics, base_failed, log-perplexity, the language's bands and kept."""
    own = cut(scored(docs), "scores")
    own = own.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    whole = own.filter(~F.col("base_failed") & (F.col("length") > 0))
    q = lambda c: F.percentile_approx(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))), 10_000).alias(c)
    spread = lambda c: (F.col(c)[2] - F.col(c)[0]) / 1.349
    band = whole.groupBy("lang").agg(q("loss"), q("square"))
    band = band.select(F.col("lang").alias("_lang"), F.col("loss")[1].alias("middle"), spread("loss").alias("spread"), F.col("square")[1].alias("_middle"), spread("square").alias("_spread"))
    own = own.join(F.broadcast(band), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    wider = F.sqrt(1 + short / F.greatest("length", F.lit(1)))
    unit = F.greatest("spread", F.lit(0.01)) * wider
    own = own.withColumn("lower", F.exp(F.col("middle") - lower * unit)).withColumn("upper", F.exp(F.col("middle") + upper * unit)).withColumn("perplexity", F.exp("loss"))
    own = own.withColumn("square_upper", F.col("_middle") + square * F.greatest("_spread", F.lit(0.03)) * wider)
    inside = F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")) & (F.col("square") <= F.col("square_upper")), F.lit(True))
    return own.withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "middle", "spread", "_middle", "_spread")
