"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks.

Targets share a multiple of all words by weight, none above twice its source. Blocks of UNIT words go to sources by highest quotients of the
targets, then inside a source to shards of documents by highest quotients of the shards' words. A shard's documents stand in a seeded order;
its quota is that many blocks in a row, round the end, from a seeded start, after as many whole rounds as fit. So at most two documents of
a shard are taken in part.

Defined results: a null or empty text has size 0 and nothing is taken; a null source is a source of its own, the last; repeated rows count
as documents each; an empty table gives an empty result. Only doc_id, text and source are read by ``plan``; ``take`` keeps all columns that
``docs`` has.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .common import WORD

UNIT, SHARD_DOCS, SEED = 32, 2048, 11
#: Sources are a short list that the driver works out targets for; more than this is an error, not a cut.
MAX_SOURCES = 200_000


def sainte_lague(votes, seats, caps=None):
    """Seats by highest quotients votes / (2 s + 1), at most ``caps`` each, ties to the earlier party.

    The quotients' order is that of a divisor: party i has floor(v / d + 1/2) seats at divisor d. d is found by halving, the few seats that
    are left go by quotient.
    """
    v = np.asarray(votes, np.float64)
    caps = np.full(len(v), seats, np.int64) if caps is None else np.asarray(caps, np.int64)
    caps = np.where(v > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(v), np.int64)
    at = lambda d: np.minimum(np.floor(np.minimum(v / d, 2.0**52) + 0.5), caps).astype(np.int64)
    low, high = v[v > 0].min() / (2.0 * seats + 2), 2.1 * v.max()
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() > seats else (low, mid)
    s = at(high)
    while (left := seats - int(s.sum())) > 0:
        q = np.where(s < caps, v / (2 * s + 1), -1)
        s[np.argsort(-q, kind="stable")[: min(left, int((q > 0).sum()))]] += 1
    return s


def targets(sizes, weights, factor=1.5, most=2.0):
    """Words wanted of each source: ``factor`` of all words by weight; what is above ``most`` times a source's size goes to the others."""
    n = len(sizes)
    out, open_, rest = [0.0] * n, set(range(n)), factor * sum(sizes)
    while open_:
        share = rest / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if weights[i] * share > most * sizes[i]]
        for i in full or sorted(open_):
            out[i] = float(most * sizes[i]) if full else weights[i] * share
            open_.discard(i)
            rest -= out[i] if full else 0.0
    return out


def plan(docs, weights=(3, 1, 2), factor=1.5, most=2, unit=UNIT, seed=SEED, keep=()):
    """Per document: doc_id, source, size, source_size, target, taken, and what is taken: ``rounds`` whole copies and the words
    [first, first + part) modulo its size-long text as up to two ranges (a0, a1), (b0, b1), counted from 0. Columns of ``docs`` named in
    ``keep`` are carried along."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("mark"), *keep), "sizes")
    spark = docs.sparkSession
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r.source is None, r.source or ""))
    want = targets([r["size"] for r in per], [weights[i % len(weights)] for i in range(len(per))], factor, most)
    quotas = sainte_lague(want, round(sum(want) / unit), [most * -(-r["size"] // unit) for r in per])
    schema = "source string, source_size long, target double, quota long, shards int"
    rows = [(r.source, r["size"], float(t), int(q), -(-r.docs // SHARD_DOCS)) for r, t, q in zip(per, want, quotas)]
    source = spark.createDataFrame(rows, schema)

    own = sized.withColumnRenamed("source", "s").join(F.broadcast(source), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    # the hash of the text stands for an id that is null, and tells rows of one id and size apart
    unnamed = F.when(F.col("doc_id").isNull(), F.col("mark"))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), unnamed)
    own = own.withColumn("draw", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", unnamed), "shards"))
    words = own.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))

    def deal(t):
        t = t.sort_values("shard").reset_index(drop=True)
        got = sainte_lague(t["words"], int(t["quota"].iloc[0]), most * -(-t["words"] // unit))
        return pd.DataFrame({"source": t["source"], "shard": t["shard"], "words": t["words"], "blocks": got})

    dealt = words.groupBy("source").applyInPandas(deal, "source string, shard long, words long, blocks long")
    dealt = dealt.select(F.col("source").alias("s"), F.col("shard").alias("h"), "words", "blocks")
    in_order = W.partitionBy("source", "shard").orderBy("draw", "doc_id", "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("before", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    own = own.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    n = F.greatest(F.ceil(F.col("words") / unit), F.lit(1))
    total = F.least(F.col("blocks") * unit, F.lit(most) * F.col("words"))
    own = own.withColumn("rounds", F.when(F.col("words") > 0, F.floor(total / F.col("words"))).otherwise(0).cast("long"))
    own = own.withColumn("run", (total - F.col("rounds") * F.col("words")).cast("long"))
    own = own.withColumn("begin", (F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), n) * unit).cast("long"))
    end, wrap = F.col("begin") + F.col("run"), F.greatest(F.col("begin") + F.col("run") - F.col("words"), F.lit(0))
    inside = lambda x: F.least(F.greatest(x - F.col("before"), F.lit(0)), F.col("size"))
    own = own.select("*", inside(F.lit(0)).alias("b0"), inside(wrap).alias("b1"), inside(F.col("begin")).alias("a0"), inside(F.least(end, F.col("words"))).alias("a1"))
    own = own.withColumn("taken", F.col("rounds") * F.col("size") + (F.col("a1") - F.col("a0")) + (F.col("b1") - F.col("b0")))
    return own.select("doc_id", "source", "size", "source_size", "target", "taken", "rounds", "a0", "a1", "b0", "b1", *keep)


def take(docs, **how):
    """The mix as documents: whole copies, and a text of the taken words where a document is taken in part. Columns as in ``docs``; n_chars,
    where there is one, follows the text. Each row is taken by its own plan row, found by a row number written beside it, so doc_id may repeat
    or be null."""
    docs = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    got = plan(docs, **how, keep=["_row"]).filter("taken > 0").withColumnRenamed("_row", "_at")
    parts = F.filter(F.array(F.struct(F.col("b0").alias("lo"), F.col("b1").alias("hi")), F.struct(F.col("a0").alias("lo"), F.col("a1").alias("hi"))), lambda x: x["lo"] < x["hi"])
    whole = F.exists(F.col("parts"), lambda x: (x["lo"] == 0) & (x["hi"] == F.col("size")))
    copies = F.array_repeat(F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>"), (F.col("rounds") + F.when(whole, 1).otherwise(0)).cast("int"))
    some = F.when(whole | (F.size("parts") == 0), F.array().cast("array<array<struct<lo:bigint,hi:bigint>>>")).otherwise(F.array(F.col("parts")))
    got = got.withColumn("parts", parts).select("_at", F.explode(F.concat(copies, some)).alias("_parts"))
    out = docs.join(got, F.col("_row") == F.col("_at"))
    ws = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    text = F.array_join(F.flatten(F.transform("_parts", lambda x: F.slice(ws, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))), " ")
    out = out.withColumn("text", F.when(F.col("_parts").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[c for c in docs.columns if c != "_row"])
