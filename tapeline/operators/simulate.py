"""Random baselines and resampled paths, as (repetition x row) tables."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw_int, draws
from . import spread
from .joins import attach
from .stats import indexed, reps


def monte_carlo(hold, crash, row_id, block, n_paths=10_000, length=54, block_len=5, p_contam=0.2, seed=29, levers=(1.0, 2.0)):
    """Resampled trade paths: single trades, circular blocks, and blocks contaminated with a crash pool.

    Both pools carry (row_id, block, ret, mae). A path is ``length`` rows, so windows per path are small; pools are
    joined on their index, never broadcast. Metrics per path: total, maximum drawdown with the trough inside each
    trade, longest losing streak.
    """
    h, c = indexed(hold, row_id, block).select("idx", "ret", "mae"), indexed(crash, row_id, block).select("idx", "ret", "mae")
    size = h.agg(F.count(F.lit(1)).alias("nh")).withColumn("nc", c.agg(F.count(F.lit(1)).alias("n")).scalar())
    pool = h.withColumn("src", F.lit("h")).unionByName(c.withColumn("src", F.lit("c")))
    spark = hold.sparkSession
    grid = attach(spark.range(n_paths).withColumnRenamed("id", "path").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))), size, "_n")
    blk, off = F.floor(F.col("step") / block_len).cast("bigint"), F.col("step") % block_len
    nh, nc = F.col("_n.nh"), F.col("_n.nc")
    iid = draw_int(seed, nh, F.lit("iid"), "path", "step")
    hb = F.pmod(draw_int(seed, nh, F.lit("h"), "path", blk) + off, nh)
    cb = draw_int(seed, nc - block_len + 1, F.lit("c"), "path", blk) + off
    coin = draw_int(seed, F.lit(1000), F.lit("coin"), "path", blk) < int(p_contam * 1000)
    one = lambda s, src, i: F.struct(F.lit(s).alias("scheme"), src.alias("src"), i.cast("bigint").alias("idx"))
    d = grid.withColumn("_d", F.explode(F.array(
        one("iid", F.lit("h"), iid), one("block", F.lit("h"), hb), one("contam", F.when(coin, "c").otherwise("h"), F.when(coin, cb).otherwise(hb))))).select("path", "step", "_d.*")
    j = d.join(pool, ["src", "idx"]).withColumn("lev", F.explode(F.array(*[F.lit(float(x)) for x in levers])))
    r = F.col("lev") * F.col("ret")
    w = W.partitionBy("scheme", "lev", "path").orderBy("step")
    run = w.rowsBetween(W.unboundedPreceding, 0)
    j = j.withColumn("eq", F.exp(F.sum(F.log1p(r)).over(run))).withColumn("prev", F.coalesce(F.lag("eq").over(w), F.lit(1.0)))
    j = j.withColumn("trough", F.col("prev") * (1 + F.least(F.col("lev") * F.col("mae"), F.lit(0.0))))
    j = j.withColumn("peak", F.greatest(F.max("eq").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(1.0))).withColumn("peak", F.coalesce("peak", F.lit(1.0)))
    j = j.withColumn("dd", F.least(F.col("trough") / F.col("peak") - 1, F.col("eq") / F.greatest("peak", "eq") - 1))
    j = j.withColumn("_win", F.sum((F.col("ret") >= 0).cast("int")).over(run))
    streak = j.filter("ret < 0").groupBy("scheme", "lev", "path", "_win").agg(F.count(F.lit(1)).alias("k")).groupBy("scheme", "lev", "path").agg(F.max("k").alias("loss_streak"))
    m = j.groupBy("scheme", "lev", "path").agg((F.max_by("eq", "step") - 1).alias("total"), F.min("dd").alias("mdd"))
    return m.join(streak, ["scheme", "lev", "path"], "left").withColumn("loss_streak", F.coalesce("loss_streak", F.lit(0)))


def path_summary(paths):
    """Percentiles over the paths of each scheme and leverage (a fixed number of paths per group)."""
    return paths.groupBy("scheme", "lev").agg(
        *[F.percentile(c, F.lit(p)).alias(f"{c}_p{int(p * 100)}") for c in ("total", "mdd") for p in (0.05, 0.5, 0.95)], F.max("loss_streak").alias("worst_streak"))


def random_entries(settled, sizes, row_id, n=200, seed=31):
    """Random entries with the same geometry: k positions per symbol without replacement, n simulations.

    ``settled`` has one settled trade per possible entry, so a position drawn many times is settled once.
    """
    own = spread.dealt(spread.cuts(settled.select("symbol", row_id, "ret").join(sizes, "symbol"), "symbol", "k"), n)
    r = draws(own, n, seed, "symbol", row_id, name="sim")
    known = F.col("ret").isNotNull().cast("bigint")
    p = spread.drawn(r, ["sim", "symbol"], "_h", "k", near=("_lo", "_hi"), _s="ret", _won=(F.col("ret") > 0).cast("bigint"), _n_x=known)
    return p.select("symbol", "sim", F.try_divide("_won", "_n_x").alias("wr"), (F.try_divide("_s", "_n_x") * 1e4).alias("avg_bp"))


def against_real(sims, real):
    """Mean and 95th percentile over the simulations (a fixed number per symbol) and the share at or above the real value."""
    j = sims.join(real, "symbol")
    return j.groupBy("symbol").agg(
        F.avg("avg_bp").alias("rand_bp_mean"), F.percentile("avg_bp", F.lit(0.95)).alias("rand_bp_p95"), F.avg((F.col("avg_bp") >= F.col("real_bp")).cast("int")).alias("share_ge_real"))


def random_windows(episodes, daily, n=1000, seed=37, cost=-0.0008):
    """Off-state windows of the same lengths at random places: improvement = -(log return inside) + windows * cost.

    ``episodes``: (symbol, ep, dur). ``daily``: (symbol, pos, lr) with pos = 0..n-1. Overlapping windows merge.
    """
    size = daily.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"))
    e = reps(episodes.join(size, "symbol"), n)
    start = draw_int(seed, F.greatest(F.col("n_days") - F.col("dur"), F.lit(1)), "rep", "symbol", "ep")
    e = e.withColumn("_s", start).withColumn("pos", F.explode(F.sequence(F.col("_s"), F.least(F.col("_s") + F.col("dur"), F.col("n_days")) - 1)))
    days = e.select("rep", "symbol", "pos").distinct()
    w = W.partitionBy("rep", "symbol").orderBy("pos")
    d = days.withColumn("_new", F.coalesce((F.col("pos") - F.lag("pos").over(w) > 1).cast("int"), F.lit(1))).join(daily, ["symbol", "pos"])
    return d.groupBy("symbol", "rep").agg((-F.sum("lr") + F.sum("_new") * cost).alias("improvement"))
