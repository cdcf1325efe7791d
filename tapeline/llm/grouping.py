"""Packing pieces into sequences by a grouping genetic algorithm.

Pieces are dealt over shards; each shard is packed by several islands. A solution is a set of bins. Crossover puts whole well-filled bins
of one parent into the other, takes out the bins that hold the same pieces, and best-fits the displaced ones. After each round an island
passes its elite to the next. The bins that stay poorly filled are opened and dealt anew over fewer shards, as long as that makes them
fewer. A shard whose bins are as few as its sum allows is done at once.

Defined results: pieces of length 0 are placed like others; a piece of the full length has a sequence of its own; a piece that is longer, of
negative or null length is an error; equal rows are placed each; an empty table gives an empty result. Other columns are kept.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..session import cut

SHARD_PIECES, ISLANDS, ROUNDS, POPULATION, GENERATIONS, ELITE = 4096, 2, 2, 5, 6, 2
#: Bins filled less than this share are opened and dealt anew.
WELL_FILLED = 0.97


class Bins:
    """Open bins by the room they have left; the smallest room that holds a piece is one bit search away."""

    def __init__(self, cap):
        self.cap, self.mask, self.by_room, self.count = cap, 0, [[] for _ in range(cap + 1)], 0

    def open(self, name, room):
        self.by_room[room].append(name)
        self.mask |= 1 << room
        self.count = max(self.count, name + 1)

    def put(self, length):
        """Best fit: the bin's name."""
        over = self.mask >> length
        if over:
            room = length + (over & -over).bit_length() - 1
            held = self.by_room[room]
            name = held.pop()
            if not held:
                self.mask ^= 1 << room
        else:
            name, room = self.count, self.cap
            self.count += 1
        room -= length
        self.by_room[room].append(name)
        self.mask |= 1 << room
        return name


def best_fit(lengths, order, cap, start=None):
    """Bin of each piece, put in the given order; ``start`` has the bins of pieces already placed (-1: not)."""
    bins = np.full(len(lengths), -1, np.int64) if start is None else start.copy()
    box = Bins(cap)
    placed = bins >= 0
    if placed.any():
        names, bins[placed] = np.unique(bins[placed], return_inverse=True)
        room = cap - np.bincount(bins[placed], lengths[placed], len(names)).astype(np.int64)
        for name, r in enumerate(room.tolist()):
            box.open(name, r)
    put = box.put
    bins[order] = [put(x) for x in lengths[order].tolist()]
    return bins


def fitness(bins, lengths, cap):
    """Mean squared fill: the higher, the fuller are the full bins."""
    fill = np.bincount(bins, lengths) / cap
    return float((fill**2).sum() / len(fill))


def crossover(a, b, lengths, cap, rng):
    """Bins of ``b``, the better filled the likelier, put whole into ``a``."""
    fill = np.bincount(b, lengths) / cap
    chance = np.where(fill >= WELL_FILLED, 0.5, 0.0)
    moved = (rng.random(len(fill)) < chance)[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[moved]] = True
    child = np.where(moved, b + a.max() + 1, np.where(hit[a], -1, a))
    loose = np.flatnonzero(child < 0)
    return best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], cap, child)


def mutated(a, lengths, cap, rng):
    """The worst bins and a few others opened, their pieces best-fitted in random order."""
    fill = np.bincount(a, lengths) / cap
    out = rng.random(len(fill)) < 0.03
    out[np.argsort(fill)[: max(2, len(fill) // 50)]] = True
    start = np.where(out[a], -1, a)
    loose = np.flatnonzero(start < 0)
    rng.shuffle(loose)
    return best_fit(lengths, loose, cap, start)


def evolve(lengths, cap, seed, given=(), size=POPULATION, generations=GENERATIONS, elite=ELITE):
    """The elite after some generations, the best first."""
    lengths = np.asarray(lengths, np.int64)
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // cap)
    rank = lambda x: (int(x.max()) + 1, -fitness(x, lengths, cap))
    down = np.argsort(-lengths, kind="stable")
    pool = [np.asarray(g, np.int64) for g in given] or [best_fit(lengths, down, cap)]
    best = min(pool, key=rank)
    if best.max() + 1 <= max(1, least):
        return [best]
    while len(pool) < size:
        pool.append(best_fit(lengths, np.argsort(-lengths * rng.uniform(0.8, 1.0, len(lengths)), kind="stable"), cap))
    for _ in range(generations):
        pool.sort(key=rank)
        if pool[0].max() + 1 <= least:
            break
        pool = pool[:size]
        i, j = rng.integers(0, max(1, size // 2)), rng.integers(0, size)
        pool += [crossover(pool[i], pool[j], lengths, cap, rng), crossover(pool[j], pool[0], lengths, cap, rng), mutated(pool[0], lengths, cap, rng)]
    pool.sort(key=rank)
    return pool[:elite]


_SOLVED = "shard long, island int, lengths array<int>, items array<long>, solutions array<array<int>>"


def _evolved(shards, cap, seed, n):
    def rows(batches):
        for t in batches:
            for r in t.itertuples(index=False):
                got = evolve(r.lengths, cap, [seed, r.shard, r.island], [] if r.solutions is None else list(r.solutions))
                yield pd.DataFrame([(r.shard, r.island, r.lengths, r.items, [g.astype(np.int32) for g in got])], columns=["shard", "island", "lengths", "items", "solutions"])

    return cut(shards.repartition(n, "shard", "island").mapInPandas(rows, _SOLVED), "islands")


def _packed(items, n_shards, cap, seed):
    """(item, length, shard, bin, offset, fill) of items (item, length) in one pass of all rounds."""
    own = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "item"), F.lit(n_shards)))
    shards = own.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("x"))
    shards = shards.select("shard", F.col("x.length").alias("lengths"), F.col("x.item").alias("items"))
    isles = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", "items", F.lit(None).cast("array<array<int>>").alias("solutions"))
    n = max(1, min(n_shards * ISLANDS, 4 * items.sparkSession.sparkContext.defaultParallelism))
    for k in range(ROUNDS):
        isles = _evolved(isles, cap, seed + k, n)
        if k < ROUNDS - 1:  # an island gets the elite of the one before it
            guests = isles.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("solutions").alias("guests"))
            isles = isles.join(guests, ["shard", "island"]).select("shard", "island", "lengths", "items", F.concat("solutions", "guests").alias("solutions"))
    bins = F.array_max(F.col("solutions")[0]) + 1
    best = isles.groupBy("shard").agg(F.min(F.struct(bins.alias("bins"), "island")).alias("x")).select("shard", F.col("x.island").alias("island"))

    def laid_out(batches):
        for t in batches:
            for r in t.itertuples(index=False):
                b, n = np.asarray(r.solutions[0], np.int64), np.asarray(r.lengths, np.int64)
                order = np.lexsort((np.arange(len(b)), b))
                ends = np.cumsum(n[order])
                first = np.searchsorted(b[order], b[order], side="left")
                offset = np.empty(len(b), np.int64)
                offset[order] = ends - n[order] - (ends - n[order])[first]
                yield pd.DataFrame({"item": np.asarray(r.items, np.int64), "length": n, "shard": r.shard, "bin": b, "offset": offset, "fill": np.bincount(b, n).astype(np.int64)[b]})

    return cut(isles.join(best, ["shard", "island"]).mapInPandas(laid_out, "item long, length int, shard long, bin long, offset long, fill long"), "packed")


def _free(columns, name):
    """``name``, made longer until no column has it."""
    while name in columns:
        name += "_"
    return name


def pack(pieces, cap, length="length", seed=5):
    """``pieces`` with sequence_id and offset (columns of these names are replaced, all others kept). The number of sequences is near the least
    possible; ids have gaps."""
    spark = pieces.sparkSession
    size = F.col(length).cast("int")
    item, bad, at, seq_at, off_at = (_free(pieces.columns, x) for x in ("_item", "_bad", "_at", "_sequence", "_offset"))
    # a piece's number is written with it: numbers given while reading would follow how a scan is cut, which can change between two reads
    named = cut(pieces.withColumn(bad, F.coalesce((size < 0) | (size > cap), F.lit(True))).withColumn(item, F.monotonically_increasing_id()), "pieces")
    if named.filter(F.col(bad)).limit(1).count():
        raise ValueError(f"a piece is longer than {cap} or has no length")
    items = named.filter(size < cap).select(F.col(item).alias("item"), size.alias("length"))
    placed, left = None, items.count()
    step = 0
    while left:
        n_shards = -(-left // SHARD_PIECES)
        got = _packed(items, n_shards, cap, seed + 101 * step)
        seq = ((F.col("shard") + F.lit(step << 40)) * F.lit(1 << 16) + F.col("bin") + 1).alias("sequence_id")
        poor = got.filter(F.col("fill") < int(WELL_FILLED * cap))
        again = poor.count() if n_shards > 1 else 0
        final = n_shards == 1 or again > 0.5 * left
        done = (got if final else got.filter(F.col("fill") >= int(WELL_FILLED * cap))).select("item", seq, "offset")
        placed = done if placed is None else placed.unionByName(done)
        if final:
            break
        items, left, step = poor.select("item", "length"), again, step + 1
    if placed is None:
        placed = spark.createDataFrame([], "item long, sequence_id long, offset long")
    out = named.join(placed.toDF(at, seq_at, off_at), F.col(item) == F.col(at), "left")
    full = size == cap
    out = out.withColumn("sequence_id", F.when(full, -F.col(item) - 1).otherwise(F.col(seq_at)))
    out = out.withColumn("offset", F.when(full, F.lit(0).cast("long")).otherwise(F.col(off_at)))
    return out.drop(item, at, seq_at, off_at, bad)
