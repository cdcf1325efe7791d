"""Ordered computation that stays spread out when one key holds most of the rows.

A plain ``Window.partitionBy(symbol)`` puts a hot symbol into one task. Everything here splits a key's
ordered rows into blocks, does the work per (key, block), and makes the blocks agree:

* ``positions``      dense row numbers from per-block counts
* ``in_blocks``      bounded frames (-before..+after) by copying edge rows into the neighbouring block
* ``running``        unbounded frames by carrying per-block partial aggregates forward
* ``decayed``        exponentially weighted sums, carried the same way
* ``even_blocks``    blocks of values by the data's own spread
* ``value_ranks``    exact ranks and quantiles from tie-collapsed value counts
* ``hash_rank``      exact order of md5 draws, blocked by digest prefix
* ``drawn``          sums over the first k of such an order; only one prefix is put in order
* ``cuts``           digests that the k-th lies between, so few rows are told apart

Blocks are functions of the ordering value only (a date, an hour, a value block, a digest prefix), so a
recomputed task always finds the same block. Every shuffle key includes the block.
"""

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

_CARRY = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}


def _cols(c):
    return [c] if isinstance(c, str) else list(c)


def positions(df, key, block, order, name="pos", start=0):
    """Dense position of each row within its key, ordered by (block, order). ``block`` must rise with ``order``."""
    key, order = _cols(key), _cols(order)
    counts = df.groupBy(*key, block).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*key).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offs = counts.select(*key, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inner = W.partitionBy(*key, block).orderBy(*order)
    return (
        df.join(offs, key + [block])
        .withColumn(name, (F.row_number().over(inner) - 1 + F.col("_off") + start).cast("bigint"))
        .drop("_off")
    )


def in_blocks(df, key, before, after, fn, pos="pos", size=4096):
    """Run ``fn(rows, window)`` on blocks of ``size`` positions that also hold the rows their frames reach.

    ``window`` is partitioned by (key, block) and ordered by ``pos``; frames may reach ``before`` rows back and
    ``after`` rows ahead. Copied edge rows are dropped again, so each input row appears once.
    """
    key = _cols(key)
    size = max(size, before + after + 1)
    lo = F.greatest(F.floor((F.col(pos) - after) / size), F.lit(0))
    hi = F.floor((F.col(pos) + before) / size)
    rows = df.withColumn("_block", F.explode(F.sequence(lo, hi)))
    out = fn(rows, W.partitionBy(*key, "_block").orderBy(pos))
    return out.filter(F.floor(F.col(pos) / size) == F.col("_block")).drop("_block")


def running(df, key, block, order, exclusive=False, **specs):
    """Running aggregates from the start of each key: ``name=("sum"|"count"|"max"|"min"|"last", column)``.

    Two levels: a window inside (key, block), and one carried value per (key, block). ``last`` skips NULLs.
    """
    key, order = _cols(key), _cols(order)
    aggs, carries, outs = [], [], []
    prior = W.partitionBy(*key).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    inner = W.partitionBy(*key, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    for name, (kind, c) in specs.items():
        x = F.col(c) if isinstance(c, str) else c
        p, q = f"_p_{name}", f"_c_{name}"
        if kind == "last":
            aggs.append(F.max_by(F.struct(x.alias("v")), F.when(x.isNotNull(), F.struct(*order))).alias(p))
            carries.append(F.last(F.col(p), True).over(prior).alias(q))
            outs.append((name, F.coalesce(F.last(x, True).over(inner), F.col(f"{q}.v")), q))
            continue
        fn = F.count if kind == "count" else _CARRY[kind]
        aggs.append(fn(x).alias(p))
        carries.append(_CARRY[kind](p).over(prior).alias(q))
        here, prev = fn(x).over(inner), F.col(q)
        if kind == "count":
            val = F.coalesce(here, F.lit(0)) + F.coalesce(prev, F.lit(0))
        elif kind == "sum":
            val = F.coalesce(here + prev, here, prev)
        else:
            val = (F.greatest if kind == "max" else F.least)(here, prev)
        outs.append((name, val, q))
    part = df.groupBy(*key, block).agg(*aggs)
    carry = part.select(*key, block, *carries)
    out = df.join(carry, key + [block])
    for name, val, _ in outs:
        out = out.withColumn(name, val)
    return out.drop(*[q for _, _, q in outs])


def decayed(df, key, pos, beta, **sums):
    """Running sums in which everything loses the factor ``beta`` at each step of ``pos``: s = beta s + x, from the start of each key.

    A step is an affine map, and so is a block of steps: inside a block the sum is a plain running sum of x beta^-i times beta^i, and a block
    hands on its last value times what the way to the next one costs. A block fades e^300 times, so what reaches over two whole blocks more
    is less than 1e-260 of itself and left out.
    """
    key = _cols(key)
    size = max(1, int(300 / -math.log(beta)))
    d = df.withColumn("_blk", F.floor(F.col(pos) / size)).withColumn("_i", F.col(pos) - F.col("_blk") * size)
    inner = W.partitionBy(*key, "_blk").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    fade = lambda steps: F.pow(F.lit(beta), steps)
    part = d.groupBy(*key, "_blk").agg(*[F.sum((F.col(c) if isinstance(c, str) else c) * fade(size - F.col("_i"))).alias(f"_t_{n}") for n, c in sums.items()])
    w = W.partitionBy(*key).orderBy("_blk")
    before, gap = F.lag("_blk").over(w), F.col("_blk") - F.lag("_blk").over(w) - 1
    before2, gap2 = F.lag("_blk", 2).over(w), F.col("_blk") - F.lag("_blk", 2).over(w) - 1
    carry = [(F.when(before.isNull(), 0.0).otherwise(F.lag(f"_t_{n}").over(w) * fade(gap * size)) + F.when(before2.isNull(), 0.0).otherwise(F.lag(f"_t_{n}", 2).over(w) * fade(gap2 * size))).alias(f"_c_{n}") for n in sums]
    out = d.join(part.select(*key, "_blk", *carry), key + ["_blk"])
    for n, c in sums.items():
        x = F.col(c) if isinstance(c, str) else c
        out = out.withColumn(n, (F.sum(x * fade(-F.col("_i"))).over(inner) + F.col(f"_c_{n}")) * fade(F.col("_i")))
    return out.drop("_blk", "_i", *[f"_c_{n}" for n in sums])


def last_before(df, key, block, order, **cols):
    """Last non-null value strictly before each row, per key."""
    return running(df, key, block, order, exclusive=True, **{n: ("last", c) for n, c in cols.items()})


def even_blocks(df, key, value, name="_b", target=4096):
    """A block number per row that rises with ``value`` and follows the data, whatever its scale or tail.

    Values first fall into eighths of powers of two; an eighth with more than ``target`` rows of a key is split evenly between its own
    least and largest value. Blocks depend on the rows only, so a recomputed task finds the same ones.
    """
    key = _cols(key)
    x = F.col(value).cast("double")
    step = F.floor(F.log2(F.abs(x)) * 8).cast("bigint") + 10_000
    d = df.withColumn("_o", F.when(x > 0, step).when(x < 0, -step).otherwise(F.lit(0)))
    info = d.groupBy(*key, "_o").agg(F.count(F.lit(1)).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    parts = F.ceil(F.col("_n") / target)
    sub = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), parts - 1)).otherwise(0)
    return d.join(info, key + ["_o"]).withColumn(name, F.col("_o") * (1 << 24) + sub).drop("_o", "_n", "_lo", "_hi")


def value_ranks(df, key, value, weight=None):
    """One row per (key, distinct value): n_eq, n_less, n_all. Ties collapse before any ordering; values are ordered in even blocks."""
    key = _cols(key)
    w = F.lit(1) if weight is None else F.col(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.sum(w).cast("bigint").alias("n_eq"))
    keys = key or ["_k"]
    rows = even_blocks(counts if key else counts.withColumn("_k", F.lit(0)), keys, value)
    # per block: the rows before it and the rows of the whole key
    part = rows.groupBy(*keys, "_b").agg(F.sum("n_eq").alias("_p"))
    of = W.partitionBy(*keys)
    part = part.select(*keys, "_b", F.sum("_p").over(of.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_c"), F.sum("_p").over(of).alias("n_all"))
    before = F.sum("n_eq").over(W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    out = rows.join(part, keys + ["_b"]).withColumn("n_less", (F.coalesce(before, F.lit(0)) + F.coalesce("_c", F.lit(0))).cast("bigint"))
    return out.select(*counts.columns, "n_all", "n_less")


def avg_ranks(df, key, value):
    """Average-tie 1-based rank per (key, distinct value), with the group size."""
    r = value_ranks(df, key, value)
    return r.withColumn("rank", F.col("n_less") + (F.col("n_eq") + 1) / 2.0)


def quantiles(df, key, value, **qs):
    """Exact linear-interpolation quantiles per key: ``name=0.5``. Spread over value ranges, not one task per key."""
    key = _cols(key)
    r = value_ranks(df, key, value)
    aggs = []
    for name, q in qs.items():
        h = F.lit(float(q)) * (F.col("n_all") - 1)
        lo, hi = F.floor(h), F.ceil(h)
        inside = lambda k: (F.col("n_less") <= k) & (k < F.col("n_less") + F.col("n_eq"))
        aggs += [
            F.max(F.when(inside(lo), F.col(value))).cast("double").alias(f"_{name}_lo"),
            F.max(F.when(inside(hi), F.col(value))).cast("double").alias(f"_{name}_hi"),
            F.max(h - lo).alias(f"_{name}_w"),
        ]
    out = r.groupBy(*key).agg(*aggs)
    return out.select(
        *key,
        *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_w")).alias(n) for n in qs],
    )


def order_stat(df, key, value, index, name):
    """The value at a 0-based order index given as a function of the group size."""
    key = _cols(key)
    r = value_ranks(df, key, value)
    k = index(F.col("n_all"))
    hit = (F.col("n_less") <= k) & (k < F.col("n_less") + F.col("n_eq"))
    return r.groupBy(*key).agg(F.max(F.when(hit, F.col(value))).alias(name))


def hash_rank(df, key, digest, name="draw_rank", width=2):
    """1-based order of hex digests within each key; digests are uniform, so prefixes make even blocks."""
    rows = df.withColumn("_px", F.substring(F.col(digest), 1, width))
    return positions(rows, key, "_px", digest, name=name, start=1).drop("_px")


def drawn(df, key, digest, k, by=(), width=2, near=None, **sums):
    """Sums over the first ``k`` rows of each key in digest order, per key and ``by``. ``k`` is a column that is equal within a key.

    Rows collapse to sums per digest prefix first; whole prefixes below k count as they are, and only the rows of the one prefix that k cuts
    are put in order. ``near``: two columns of digests, equal within a key, that k's own digest lies between (``cuts``). Then all rows below
    are one prefix, all above are one, and those between count by whole digest. If k is outside after all, that prefix is put in order.
    """
    key, by = _cols(key), _cols(by)
    rows = df.select(*key, *by, F.col(digest).alias("_h"), F.col(k).alias("_k"), *(near or ()), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in sums.items()])
    prefix = F.substring("_h", 1, width)
    if near:
        prefix = F.when(F.col("_h") < F.col(near[0]), "").when(F.col("_h") >= F.col(near[1]), "g").otherwise(F.col("_h"))
    rows = rows.withColumn("_px", prefix)
    total = [F.sum(n).alias(n) for n in sums]
    part = rows.groupBy(*key, *by, "_px", "_k").agg(F.count(F.lit(1)).alias("_n"), *total)
    below = F.sum("_n").over(W.partitionBy(*key).orderBy("_px").rangeBetween(W.unboundedPreceding, W.currentRow))
    here = F.sum("_n").over(W.partitionBy(*key, "_px"))
    part = part.withColumn("_upto", below).withColumn("_before", below - here)
    part = cut(part.filter(F.col("_before") < F.col("_k")), "prefixes")  # rows are hashed once for it, and once more below if a prefix is cut
    whole = part.filter(F.col("_upto") <= F.col("_k")).select(*key, *by, *sums)
    edge = part.filter(F.col("_upto") > F.col("_k")).select(*key, "_px", (F.col("_k") - F.col("_before")).alias("_rest")).distinct()
    if edge.isEmpty():
        return whole.groupBy(*key, *by).agg(*total)
    at = F.row_number().over(W.partitionBy(*key).orderBy("_h"))
    last = rows.join(small(edge), key + ["_px"]).withColumn("_at", at).filter(F.col("_at") <= F.col("_rest")).select(*key, *by, *sums)
    return whole.unionByName(last).groupBy(*key, *by).agg(*total)


def cuts(df, key, k, names=("_lo", "_hi")):
    """Rows with two digests that the k-th of their key lies between when the key's rows are put in order of digests: k of n uniform numbers are
    below k/n, six standard deviations more or less. ``k`` is a column that is equal within a key; rows without a key stay out."""
    key = _cols(key)
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_all"))
    df = df.join(small(n), key) if key else df.withColumn("_all", n.scalar())
    share = F.least(F.greatest(F.col(k) / F.col("_all"), F.lit(0.0)), F.lit(1.0))
    off = 6 * F.sqrt(share * (1 - share) / F.col("_all")) + F.lit(6.0) / F.col("_all")
    digits = lambda x: F.lpad(F.lower(F.hex(F.floor(x * (1 << 48)))), 12, "0")
    return df.withColumn(names[0], F.when(share - off <= 0, "").otherwise(digits(share - off))).withColumn(names[1], F.when(share + off >= 1, "g").otherwise(digits(share + off))).drop("_all")


def dealt(df, times, most=1 << 22):
    """Rows dealt evenly over so many tasks that none makes more than about ``most`` rows when each is repeated ``times`` times."""
    n = df.count()
    return df.repartition(max(1, min(n, max(df.sparkSession.sparkContext.defaultParallelism, -(-n * times // most)))))


def small(df, limit=1 << 20):
    """``df`` to be broadcast if it has at most ``limit`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def islands(df, key, block, order, flag, name="island"):
    """Number runs: the count of ``flag`` rows up to and including each row, per key."""
    return running(df, key, block, order, **{name: ("sum", F.when(F.col(flag), 1).otherwise(0))})
