"""Connected components by alternating stars, one written table per half step, nothing on the driver but two numbers."""

from pyspark.sql import functions as F

from ..session import cut


def _to_least(edges, keep):
    """Every node's neighbours of one side (``keep``: larger ones, or smaller ones and itself) are tied to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if keep == "larger" else both.filter("v < u")
    least = side.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if keep == "larger":
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges):
    """``edges`` (u, v: ids of one ordered type) to (u, root): each node that has an edge, with the smallest id it can reach.

    Loops, repeated and reversed edges are fine; no edges give no rows. The loop ends when a full step changes nothing; trees become stars in
    a number of steps that grows with the logarithm of their depth.
    """
    cur = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = None
    while True:
        got = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (got.n, got.s) == sign or not got.n:
            return cur.select("u", F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        sign = (got.n, got.s)
        cur = cut(_to_least(_to_least(cur, "larger"), "smaller"), "edges")
