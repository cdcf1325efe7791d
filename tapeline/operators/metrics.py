"""Trade, event and portfolio metrics."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rolling as R
from . import spread


def compounded(ret="ret"):
    return F.product(1 + F.col(ret)) - 1


def combo_metrics(trades, keys):
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), compounded().alias("total_return"),
        F.avg((F.col("hit") == "tp").cast("int")).alias("hit_tp_pct"), F.avg((F.col("hit") == "sl").cast("int")).alias("hit_sl_pct"),
        F.avg("ret").alias("avg_ret"))


def path_stats(trades, keys, block, order):
    """n, win rate, mean in bp, maximum drawdown and total per key; the running peak is two-level."""
    e = R.equity(trades, keys, block, order)
    e = R.drawdown(e, keys, block, order)
    return e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("ret") > 0).cast("int")).alias("wr"), (F.avg("ret") * 1e4).alias("avg_bp"),
        F.min("drawdown").alias("mdd"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("total"))


def trade_report(trades, keys, block, order):
    s = path_stats(trades, keys, block, order)
    b = trades.groupBy(*keys).agg(
        F.max("ret").alias("best"), F.min("ret").alias("worst"),
        F.avg((F.col("hit") == "tp").cast("int")).alias("tp_rate"), F.avg((F.col("hit") == "sl").cast("int")).alias("sl_rate"))
    return s.join(b, keys).join(spread.quantiles(trades, keys, "ret", median_ret=0.5), keys)


def worst_day(trades, key="symbol", day="et_date"):
    d = trades.groupBy(key, day).agg(compounded().alias("day_ret"))
    return d.groupBy(key).agg(F.min("day_ret").alias("worst_ret"), F.min_by(day, F.struct("day_ret", day)).alias("worst_day"))


def growth_rates(total, days, n_obs):
    """Annualised growth on 365, 365.25 and 252-observation bases, from a total factor."""
    return [(F.pow(total, 365.0 / days) - 1).alias("cagr_365"), (F.pow(total, 365.25 / days) - 1).alias("cagr_36525"), (F.pow(total, 252.0 / n_obs) - 1).alias("cagr_252")]


def mae(settled):
    """Worst close-to-entry excursion inside the holding window, at most 0."""
    inside = F.filter("path", lambda b: b["pos"] <= F.col("exit_pos"))
    worst = F.array_min(F.transform(inside, lambda b: b["close"] / F.col("entry_px") - 1))
    return settled.withColumn("mae", F.least(worst, F.lit(0.0)))


def layers(rows, score, ret, thresholds):
    """Nested layers (score >= threshold, first one unfiltered): count, mean, median, win rate, t-statistic."""
    arr = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(score) >= t)
    l = rows.withColumn("layer", F.explode(arr))
    a = l.groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(ret) * 1e4).alias("avg_bp"), F.avg((F.col(ret) > 0).cast("int")).alias("win_rate"),
        F.when(F.stddev_samp(ret) > 0, F.avg(ret) / F.stddev_samp(ret) * F.sqrt(F.count(F.lit(1)))).alias("t_stat"))
    return a.join(spread.quantiles(l, "layer", ret, median_ret=0.5), "layer")


def threshold_table(rows, score, label, thresholds):
    """Kept rows, retention and precision per threshold: conditional sums in one pass, no join."""
    n = F.count(F.lit(1))
    cells = [F.struct(F.lit(float(t)).alias("threshold"), F.sum((F.col(score) >= t).cast("int")).cast("bigint").alias("kept"),
                      F.sum(F.when(F.col(score) >= t, F.col(label))).alias("pos")) for t in thresholds]
    one = rows.agg(n.alias("n"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    out = one.select("n", F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cells))])).alias("c"))
    return out.select("c.threshold", "c.kept", (F.col("c.kept") / F.col("n")).alias("retention"), F.when(F.col("c.kept") > 0, F.col("c.pos") / F.col("c.kept")).alias("precision"))


def two_sample(rows, keys, flag, x):
    """ON against OFF: counts, means, difference, Welch t."""
    on, off = F.when(F.col(flag), F.col(x)), F.when(~F.col(flag), F.col(x))
    a = rows.groupBy(*keys).agg(
        F.count(on).alias("n_on"), F.count(off).alias("n_off"), F.avg(on).alias("m_on"), F.avg(off).alias("m_off"), F.var_samp(on).alias("_v1"), F.var_samp(off).alias("_v0"))
    a = a.withColumn("diff", F.col("m_on") - F.col("m_off"))
    return a.withColumn("welch_t", F.try_divide(F.col("diff"), F.sqrt(F.col("_v1") / F.col("n_on") + F.col("_v0") / F.col("n_off")))).drop("_v1", "_v0")


def contribution(trades, symbols, pnl="pnl"):
    g = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"), F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"), (F.avg("ret") * 1e4).alias("avg_bp"), F.sum(pnl).alias("pnl"))
    return symbols.join(g, "symbol", "left").withColumn("trades", F.coalesce("trades", F.lit(0))).withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))


def sliced_totals(rows, sets, cols, x):
    """Count, mean bp and positive share over several grouping sets in one pass."""
    return rows.groupingSets(sets, *cols).agg(F.count(F.lit(1)).alias("n"), (F.avg(x) * 1e4).alias("mean_bp"), F.avg((F.col(x) > 0).cast("int")).alias("pos_share"))


def lead_lag(events, triggers, days, channel, lookback=30):
    """Share of events with a precursor, the same share for every trading day, and lead statistics."""
    from .joins import precursor

    e = precursor(events, triggers, lookback)
    ev = e.agg(F.count(F.lit(1)).alias("n_events"), F.count("gap").alias("n_pre"), F.avg("gap").alias("mean_lead"), F.percentile("gap", F.lit(0.5)).alias("median_lead"))
    t = triggers.groupBy("symbol", F.col("act").alias("d")).agg(F.lit(1).alias("_t"))
    w = W.partitionBy("symbol").orderBy("d").rowsBetween(-lookback, -1)
    b = days.join(t, ["symbol", "d"], "left").withColumn("_any", F.coalesce(F.max("_t").over(w), F.lit(0))).filter(F.col("d") >= lookback)
    base = b.agg(F.avg("_any").alias("base_frac"))
    out = ev.withColumn("_b", base.select("base_frac").scalar())
    return out.select(F.lit(channel).alias("channel"), "n_events", "n_pre", (F.col("n_pre") / F.col("n_events")).alias("frac"), F.col("_b").alias("base_frac"), "mean_lead", "median_lead")


def conditional_means(events, triggers, returns, lookbacks, windows):
    """Mean forward return with and without a precursor for every (lookback, window). One as-of join serves all."""
    from .joins import precursor

    e = precursor(events, triggers, max(lookbacks)).withColumn("gap", F.coalesce("gap", F.lit(1 << 30)))
    e = e.join(returns, ["symbol", "act"])
    e = e.withColumn("lookback", F.explode(F.array(*[F.lit(n) for n in lookbacks]))).filter(F.col("act") >= F.col("lookback"))
    e = e.withColumn("win", F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"r{w}").alias("r")) for w in windows])))
    r = F.col("win.r")
    e = e.filter(r.isNotNull()).withColumn("pre", F.col("gap") <= F.col("lookback"))
    return e.groupBy("lookback", F.col("win.w").alias("window")).agg(
        F.count(F.when(F.col("pre"), 1)).alias("n_pre"), F.count(F.when(~F.col("pre"), 1)).alias("n_nopre"),
        (F.avg(F.when(F.col("pre"), r)) * 1e4).alias("mean_pre_bp"), (F.avg(F.when(~F.col("pre"), r)) * 1e4).alias("mean_nopre_bp"))


def histogram(df, x, bins=40):
    """Equal-width bins between the minimum and maximum, the last one closed."""
    from .joins import attach

    d = attach(df.filter(F.col(x).isNotNull()), df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")), "_r")
    width = (F.col("_r.hi") - F.col("_r.lo")) / bins
    b = F.least(F.floor((F.col(x) - F.col("_r.lo")) / width), F.lit(bins - 1)).cast("int")
    return d.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def vol_regime_counts(bars, events, n=78):
    """Volatility tercile at each event's trough, counted. Terciles are exact and spread over value ranges."""
    from ..functions.numeric import guarded

    v = spread.in_blocks(bars, "symbol", n + 1, 0, lambda r, w: r.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1).withColumn(
        "vol", guarded(F.stddev_samp, F.col("_r"), w.rowsBetween(-(n - 1), 0), n)))
    q = spread.quantiles(v, "symbol", "vol", q1=1 / 3, q2=2 / 3)
    j = events.join(v.select("symbol", "pos", "vol"), ["symbol", "pos"]).join(q, "symbol").filter("vol IS NOT NULL")
    lab = F.when(F.col("vol") <= F.col("q1"), "low").when(F.col("vol") <= F.col("q2"), "mid").otherwise("high")
    return j.groupBy("symbol", lab.alias("regime")).agg(F.count(F.lit(1)).alias("n"))


def xirr(flows, key, date, amount, lo=-0.99, hi=10.0, steps=64):
    """Money-weighted return per key by bisection over its dated flows (one entry per day: bounded by the calendar).

    64 halvings of the interval go below the spacing of doubles, so further steps change nothing.
    """
    d = flows.groupBy(key, date).agg(F.sum(amount).alias("_a"))
    g = d.groupBy(key).agg(F.collect_list(F.struct(F.col(date).alias("d"), F.col("_a").alias("a"))).alias("f"), F.min(date).alias("d0"))
    g = g.withColumn("f", F.transform("f", lambda x: F.struct((F.datediff(x["d"], F.col("d0")) / 365.25).alias("t"), x["a"].alias("a"))))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        npv = F.aggregate("f", F.lit(0.0), lambda acc, x: acc + x["a"] / F.pow(1 + mid, x["t"]))
        return F.struct(F.when(npv > 0, mid).otherwise(s["lo"]).alias("lo"), F.when(npv > 0, s["hi"]).otherwise(mid).alias("hi"))

    r = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")), step, lambda s: (s["lo"] + s["hi"]) / 2)
    return g.select(key, r.alias("irr"))


def equal_weight(daily):
    """Mean of per-symbol normalised closes on every calendar day of the pool, gaps filled forward."""
    first = daily.groupBy("symbol").agg(F.min_by("open", "et_date").alias("_o"))
    dates = daily.select("et_date").distinct()
    # each symbol's gap days: for its days, the stretch up to its next day; dates are few, symbols spread the work
    w = W.partitionBy("symbol").orderBy("et_date")
    d = daily.join(first, "symbol").select("symbol", "et_date", (F.col("close") / F.col("_o")).alias("v"))
    d = d.withColumn("_until", F.coalesce(F.date_sub(F.lead("et_date").over(w), 1), F.lit(None)))
    last = dates.agg(F.max("et_date").alias("m"))
    d = d.withColumn("_until", F.coalesce("_until", last.scalar()))
    filled = d.select("v", F.explode(F.sequence("et_date", "_until")).alias("et_date"))
    return filled.groupBy("et_date").agg(F.avg("v").alias("pool"), F.count(F.lit(1)).alias("n")).join(dates, "et_date", "left_semi")


def peer_excess(rows, min_symbols=11, day="et_date", ret="r"):
    """Return less the mean of the day's other symbols; NULL when too few symbols trade that day."""
    g = rows.groupBy(day).agg(F.sum(ret).alias("_s"), F.count(ret).alias("_n"))
    j = rows.join(g, day)
    ex = F.col(ret) - (F.col("_s") - F.col(ret)) / (F.col("_n") - 1)
    return j.withColumn("excess", F.when(F.col("_n") >= min_symbols, ex)).drop("_s", "_n")


def reduce_restore(actions, cost=-0.0005):
    """Pair each REDUCE with the RESTORE right after it: return over the pair and right / wrong counts."""
    w = W.partitionBy("symbol").orderBy("d")
    p = actions.withColumn("_n", F.lead("action").over(w)).withColumn("_p", F.lead("price").over(w)).filter("action = 'REDUCE' AND _n = 'RESTORE'")
    r = F.col("_p") / F.col("price") - 1
    return p.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum((r < cost).cast("int")).cast("bigint").alias("n_right"), F.sum((r >= cost).cast("int")).cast("bigint").alias("n_wrong"), F.avg(r).alias("mean_ret"))


def buy_and_hold(daily, fee=0.0001):
    """Total after a fee on both sides, maximum drawdown and the longest stretch of days below the peak."""
    w = W.partitionBy("symbol").orderBy("et_date").rowsBetween(W.unboundedPreceding, 0)
    d = daily.withColumn("_pk", F.max("close").over(w))
    d = d.withColumn("_pkd", F.last(F.when(F.col("close") >= F.col("_pk"), F.col("et_date")), True).over(w))
    g = d.groupBy("symbol").agg(
        F.min_by("close", "et_date").alias("_a"), F.max_by("close", "et_date").alias("_z"), F.min(F.col("close") / F.col("_pk") - 1).alias("mdd"),
        F.max(F.datediff("et_date", "_pkd")).alias("underwater_days"), F.datediff(F.max("et_date"), F.min("et_date")).alias("_days"))
    total = F.col("_z") * (1 - fee) / (F.col("_a") * (1 + fee))
    return g.select("symbol", (total - 1).alias("total"), (F.pow(total, 365.25 / F.col("_days")) - 1).alias("cagr"), "mdd", "underwater_days")
