"""Exact top-k by MaxScore over shards of postings.

A row's non-zero weights are postings of terms; a term is a dimension and a sign, so the terms that can add to a query's score are those of its
own signs. Per shard and query, terms are ordered by the most they can add. Those whose bounds together stay under the k-th best score so
far are non-essential: rows that are only in their lists can't enter. The lists of the others are traversed and their rows' partial scores
added up; then the remaining lists are probed, largest bound first, for rows that are still competitive. Shards' best are merged.

Every query meets every shard, in blocks: shards and blocks of queries are dealt over tasks by the pair.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part, neither as row nor as query; vectors of
different lengths meet on the dimensions that both have; ties go to the smaller id; the query's own id is left out, and with it rows that
repeat the id; a query that repeats an id is answered once, by its smallest vector; fewer than k rows give all; an empty table gives none.
Other columns are not read.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

SHARD_ROWS, QUERY_BLOCK = 2048, 1024
#: Rows scored in full before the first bound.
WARM = 64


def quantised(rows, vector, scale):
    """``rows`` with weights floor(scale * component) where all components are finite numbers."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.withColumn("weights", F.transform(v, lambda x: F.floor(x * scale).cast("long"))).filter(F.col(vector).isNotNull() & (F.size(v) > 0) & fine)


class Shard:
    """Postings of one shard: by term the rows that have it and their weights; and the rows' weights for probing."""

    def __init__(self, ids, weights):
        order = np.argsort(ids, kind="stable")
        self.ids, self.weights = ids[order], np.ascontiguousarray(weights[order].T)
        self.postings = []
        for w in self.weights:
            for side in (w > 0, w < 0):
                at = np.flatnonzero(side)
                self.postings.append((at, w[at], int(np.abs(w[at]).max()) if len(at) else 0))

    def search(self, query, own, k):
        """The k best (score, id), ids ascending among equals; the id ``own`` left out."""
        dims = min(len(query), len(self.weights))
        query = query[:dims]
        used = np.flatnonzero(query)
        n = len(self.ids)
        warm = query @ self.weights[:dims, :WARM]
        warm = warm[self.ids[:WARM] != own]
        if n <= WARM or len(warm) < k:
            score = query @ self.weights[:dims]
            return self._best(score, np.flatnonzero(self.ids != own), k)
        floor = np.partition(warm, len(warm) - k)[len(warm) - k]
        term = 2 * used + (query[used] < 0)
        bound = np.abs(query[used]) * np.array([self.postings[t][2] for t in term], np.int64)
        up = np.argsort(bound, kind="stable")
        used, term, bound = used[up], term[up], bound[up]
        below = np.cumsum(bound)
        first = int(np.searchsorted(below, floor, side="left")) if floor > 0 else 0  # terms before it are non-essential: their sum is under the floor
        rest = int(below[first - 1]) if first else 0
        part, met = np.zeros(n, np.int64), np.zeros(n, bool)
        for d, t in zip(used[first:], term[first:]):
            at, w, _ = self.postings[t]
            part[at] += query[d] * w
            met[at] = True
        if floor <= 0:
            met[:] = True
        met[self.ids == own] = False
        rows = np.flatnonzero(met & (part + rest >= floor))
        # probing: first what the essential terms' other signs take away, then the non-essential lists, largest bound first
        part = part[rows]
        for d in used[first:][::-1]:
            w = self.weights[d, rows] * query[d]
            part += np.minimum(w, 0)
            keep = part + rest >= floor
            if not keep.all():
                rows, part = rows[keep], part[keep]
        for j in range(first - 1, -1, -1):
            rest -= int(bound[j])
            part += self.weights[used[j], rows] * query[used[j]]
            keep = part + rest >= floor
            if not keep.all():
                rows, part = rows[keep], part[keep]
        return self._best(part, None, k, rows)

    def _best(self, score, own, k, rows=None):
        rows = own if rows is None else rows
        score = score[rows] if own is not None else score
        order = np.lexsort((self.ids[rows], -score))[:k]
        return score[order], self.ids[rows[order]]


def top_k(rows, queries, k, shard_rows=SHARD_ROWS, block=QUERY_BLOCK):
    """(query_id, rank, vec_id, score): the k rows of highest inner product for each query. Both have (vec_id, weights)."""
    rows = cut(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "weights").filter("vec_id is not null"), "vectors")
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "weights").filter("vec_id is not null").groupBy("vec_id").agg(F.min("weights").alias("weights"))
    queries = cut(queries, "queries")
    n_shards = max(1, -(-rows.count() // shard_rows))
    n_blocks = max(1, -(-queries.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shards = rows.select("vec_id", "weights", F.pmod(F.xxhash64("vec_id", "weights"), F.lit(n_shards)).cast("int").alias("shard"), every(n_blocks).alias("block"))
    asked = queries.select("vec_id", "weights", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block"), every(n_shards).alias("shard"))

    def search(key, own, ask):
        out = []
        if len(own) and len(ask):
            dims = own["weights"].map(len)
            for size, part in own.groupby(dims):
                shard = Shard(part["vec_id"].to_numpy(np.int64), np.array(part["weights"].tolist(), np.int64).reshape(len(part), size))
                for q, w in zip(ask["vec_id"], ask["weights"]):
                    score, ids = shard.search(np.asarray(w, np.int64), q, k)
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = shards.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
