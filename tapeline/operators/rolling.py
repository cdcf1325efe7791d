"""Rolling statistics, switches and running quantities.

Intraday series go through ``spread.in_blocks`` / ``spread.running`` (a symbol may be most of the table).
Daily panels hold at most ~366 rows per symbol and year, so they use one window per symbol.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clip, guarded, pct_rank_last
from . import spread
from .bars import intraday_return
from .expanding import expanding_quantile


def by_day(key="symbol", order="et_date"):
    return W.partitionBy(key).orderBy(order)


def realised_vol(bars, n=20, k=10):
    """Standard deviation of intraday returns over n bars with at least k observations."""
    return spread.in_blocks(intraday_return(bars), "symbol", n - 1, 0, lambda r, w: r.withColumn(
        "rv20", guarded(F.stddev_samp, F.col("iret"), w.rowsBetween(-(n - 1), 0), k)))


def volume_ratio(bars, n=20, k=10):
    """Volume over the mean of the n bars before it."""
    return spread.in_blocks(bars, "symbol", n, 0, lambda r, w: r.withColumn(
        "vol_ratio", F.try_divide(F.col("volume"), guarded(F.avg, F.col("volume"), w.rowsBetween(-n, -1), k))))


def prev_day_return(bars, daily):
    """Close-to-close return of the day before, joined by date."""
    w = by_day()
    d = daily.select("symbol", "et_date", (F.lag("close", 1).over(w) / F.lag("close", 2).over(w) - 1).alias("prev_day_ret"))
    return bars.join(d, ["symbol", "et_date"], "left")


def local_extrema(bars, lb, lf):
    """Peak and trough marks: close >= max (<= min) over lb bars back and lf ahead, ties count, incomplete frames excluded."""
    def mark(r, w):
        f = w.rowsBetween(-lb, lf)
        full = F.count("close").over(f) == lb + lf + 1
        return r.withColumn("is_peak", full & (F.col("close") >= F.max("close").over(f))).withColumn(
            "is_trough", full & (F.col("close") <= F.min("close").over(f)))

    return spread.in_blocks(bars, "symbol", lb, lf, mark)


def atr_threshold(bars, n=14, mult=1.2):
    """Previous bar's ATR share of price times a multiplier."""
    def calc(r, w):
        pc = F.lag("close").over(w)
        r = r.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
        r = r.withColumn("_a", guarded(F.avg, F.col("_tr"), w.rowsBetween(-(n - 1), 0), n) / F.col("close"))
        return r.withColumn("atr_thr", F.lag("_a").over(w) * mult).drop("_tr", "_a")

    return spread.in_blocks(bars, "symbol", n + 1, 0, calc)


def daily_signals(daily, donchian=(10, 20, 55), pulls=(20, 50), band=0.01, streaks=(3, 4, 5), moves=(0.03, 0.05)):
    """Four signal families in two directions, long form: one row per (day, family, param, direction) that fires."""
    w = by_day()
    c, out = F.col("close"), []
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    prior = lambda n: w.rowsBetween(-n, -1)

    def add(fam, p, d, cond):
        out.append(F.struct(F.lit(fam).alias("family"), F.lit(float(p)).alias("param"), F.lit(d).alias("direction"), cond.alias("on")))

    for n in donchian:
        add("donchian", n, 1, c > guarded(F.max, F.col("high"), prior(n), n))
        add("donchian", n, -1, c < guarded(F.min, F.col("low"), prior(n), n))
    for n in pulls:
        rel = c / guarded(F.avg, c, last(n), n) - 1
        add("ma_pull", n, 1, (rel > 0) & (rel < band))
        add("ma_pull", n, -1, (rel < 0) & (rel > -band))
    prev = F.lag("close").over(w)
    d1 = daily.withColumn("_dn", F.when(c < prev, 1).otherwise(0)).withColumn("_up", F.when(c > prev, 1).otherwise(0)).withColumn("_r", c / prev - 1)
    for k in streaks:
        add("streak", k, 1, (F.count(F.lit(1)).over(last(k)) == k) & (F.sum("_dn").over(last(k)) == k))
        add("streak", k, -1, (F.count(F.lit(1)).over(last(k)) == k) & (F.sum("_up").over(last(k)) == k))
    for t in moves:
        add("big_move", t, 1, F.col("_r") < -t)
        add("big_move", t, -1, F.col("_r") > t)
    s = d1.withColumn("_all", F.array(*out))
    s = s.withColumn("_s", F.explode(F.filter("_all", lambda x: F.coalesce(x["on"], F.lit(False)))))
    return s.select(*daily.columns, "_s.family", "_s.param", "_s.direction")


def bear_switches(daily, long=200, short=50, high=252, dd=-0.20):
    """S1..S4, decided by yesterday's close; NULL (not enough history) means not off."""
    w = by_day()
    f = lambda n: w.rowsBetween(-(n - 1), 0)
    sma = guarded(F.avg, F.col("close"), f(long), long)
    fast = guarded(F.avg, F.col("close"), f(short), short)
    hi = guarded(F.max, F.col("close"), f(high), high)
    raw = daily.withColumn("_s1", F.coalesce(F.col("close") < sma, F.lit(False))).withColumn(
        "_s2", F.coalesce(F.col("close") / hi - 1 < dd, F.lit(False))).withColumn("_s3", F.coalesce(fast < sma, F.lit(False)))
    raw = raw.withColumn("_s4", F.col("_s1") | F.col("_s2"))
    for k in (1, 2, 3, 4):
        raw = raw.withColumn(f"s{k}_off", F.coalesce(F.lag(f"_s{k}").over(w), F.lit(False)))
    return raw.drop("_s1", "_s2", "_s3", "_s4")


def equity(trades, key, block, order, ret="ret"):
    """Compounded equity after each trade."""
    out = spread.running(trades, key, block, order, _lg=("sum", F.log1p(F.col(ret))))
    return out.withColumn("equity", F.exp("_lg")).drop("_lg")


def drawdown(path, key, block, order, value="equity"):
    """Running peak and the drawdown from it."""
    out = spread.running(path, key, block, order, peak=("max", value))
    return out.withColumn("drawdown", F.col(value) / F.col("peak") - 1)


def forward_return(daily, n):
    """Enter at this day's open, leave at the close n-1 days on."""
    return daily.withColumn("fwd_ret", F.lead("close", n - 1).over(by_day()) / F.col("open") - 1)


def spine(counts, key="symbol", date="et_date", value="n"):
    """Fill missing days between the first and last date of each key with zero."""
    ends = counts.groupBy(key).agg(F.min(date).alias("_a"), F.max(date).alias("_z"))
    days = ends.select(key, F.explode(F.sequence("_a", "_z")).alias(date))
    return days.join(counts, [key, date], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def density_threshold(daily_counts, q=0.9, n=365, k=180, key="symbol", value="n"):
    """Causal density: today's count strictly above the q-quantile of the n days before it."""
    f = by_day(key).rowsBetween(-n, -1)
    thr = F.when(F.count(value).over(f) >= k, F.percentile(value, F.lit(q)).over(f))
    return daily_counts.withColumn("thr", thr).withColumn("dense", F.coalesce(F.col(value) > F.col("thr"), F.lit(False)))


def runs(df, key, block, order, cond, **aggs):
    """Gaps and islands: one row per maximal run of rows where ``cond`` holds."""
    key = [key] if isinstance(key, str) else list(key)
    r = spread.running(df.withColumn("_on", F.coalesce(cond, F.lit(False))), key, block, order,
                       run_id=("count", F.when(~F.col("_on"), 1)))
    extra = [a.alias(n) for n, a in aggs.items()]
    return r.filter("_on").groupBy(*key, "run_id").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"), *extra)


def obv_signals(daily, z=2.0):
    """On-balance volume: divergence, absorption and net inflow flags."""
    w = by_day()
    f = lambda n: w.rowsBetween(-(n - 1), 0)
    p = lambda n: w.rowsBetween(-n, -1)
    c, vol = F.col("close"), F.col("volume")
    d = daily.withColumn("ret1", c / F.lag("close").over(w) - 1)
    d = d.withColumn("obv", F.sum(F.signum(F.coalesce("ret1", F.lit(0.0))) * vol).over(w.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("obv5", F.col("obv") - F.lag("obv", 5).over(w)).withColumn("ret5", F.abs(c / F.lag("close", 5).over(w) - 1)).withColumn("aret", F.abs("ret1"))
    zs = lambda x: F.try_divide(F.col(x) - guarded(F.avg, F.col(x), p(60), 60), guarded(F.stddev_samp, F.col(x), p(60), 60))
    div = (c <= guarded(F.min, c, f(20), 20)) & (pct_rank_last(F.col("obv"), f(20), 20) >= 0.25)
    absorb = (zs("volume") >= z) & (F.col("aret") <= 0.75 * guarded(F.avg, F.col("aret"), p(20), 20))
    med = F.when(F.count("ret5").over(p(60)) >= 60, F.percentile("ret5", F.lit(0.5)).over(p(60)))
    inflow = (zs("obv5") >= z) & (F.col("ret5") <= med)
    f0 = lambda x: F.coalesce(x, F.lit(False))
    return d.withColumn("sig_div", f0(div)).withColumn("sig_absorb", f0(absorb)).withColumn("sig_inflow", f0(inflow))


def zscore_past(df, value, n=26, k=13, key="symbol", order="et_date"):
    f = by_day(key, order).rowsBetween(-n, -1)
    return df.withColumn("z", F.try_divide(F.col(value) - guarded(F.avg, F.col(value), f, k), guarded(F.stddev_samp, F.col(value), f, k)))


def vol_regime(daily, n=20, rank_n=252):
    """Yesterday's volatility percentile in its trailing year and yesterday's distance from the 252-day high."""
    w = by_day()
    d = daily.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    d = d.withColumn("_v", guarded(F.stddev_samp, F.col("_r"), w.rowsBetween(-(n - 1), 0), n))
    d = d.withColumn("_p", pct_rank_last(F.col("_v"), w.rowsBetween(-(rank_n - 1), 0), rank_n))
    d = d.withColumn("_dd", F.col("close") / guarded(F.max, F.col("close"), w.rowsBetween(-(rank_n - 1), 0), rank_n) - 1)
    return d.withColumn("vol_pct", F.lag("_p").over(w)).withColumn("dd252", F.lag("_dd").over(w)).drop("_r", "_v", "_p", "_dd")


def pit_features(daily):
    """Market-side features of a pit day, all known at its close."""
    w = by_day()
    c = F.col("close")
    prior60 = w.rowsBetween(-60, -1)
    d = daily.withColumn("_r", c / F.lag("close").over(w) - 1)
    peak_d = F.max_by("d", F.struct(c, -F.col("d"))).over(prior60)
    v60 = F.avg("volume").over(w.rowsBetween(-65, -6))
    return (
        d.withColumn("dd_60", (c / F.max("close").over(prior60) - 1) * 100)
        .withColumn("days_from_peak", F.col("d") - peak_d)
        .withColumn("ret_30", (c / F.lag("close", 30).over(w) - 1) * 100)
        .withColumn("vol20_ann", guarded(F.stddev_samp, F.col("_r"), w.rowsBetween(-19, 0), 20) * F.sqrt(F.lit(252.0)) * 100)
        .withColumn("dist_200", (c / guarded(F.avg, c, w.rowsBetween(-199, 0), 120) - 1) * 100)
        .withColumn("volume_pct", pct_rank_last(F.col("volume"), w.rowsBetween(-251, 0), 126) * 100)
        .withColumn("vol_5_60", F.avg("volume").over(w.rowsBetween(-4, 0)) / F.nullif(v60, F.lit(0.0)))
        .drop("_r")
    )


def rsi(daily, n=14, adjust=True, pos="d"):
    """RSI from exponential means of the rises and falls between closes. ``adjust`` picks the weighting: a mean over decayed weights, or a
    recursion that begins with the first change as it is; adjust=False reads an undefined value as 100. ``pos`` numbers a symbol's days from 0.

    Only the ratio of both means counts, so each is a decayed running sum, carried over blocks of days (``spread.decayed``).
    """
    change = F.col("close") - F.lag("close").over(by_day())
    weight = F.lit(1.0) if adjust else F.when(F.col(pos) == 1, 1.0).otherwise(1.0 / n)
    x = daily.select("symbol", "et_date", pos, (change * weight).alias("_x"))
    zero = F.lit(0.0)
    x = spread.decayed(x, "symbol", pos, 1 - 1 / n, _up=F.greatest(F.coalesce("_x", zero), zero), _dn=F.greatest(-F.coalesce("_x", zero), zero))
    known = F.when((F.col(pos) >= n) & (F.col("_dn") > 0), 100 - 100 / (1 + F.col("_up") / F.col("_dn")))
    if adjust:
        value = F.coalesce(known, F.when((F.col(pos) >= n) & (F.col("_up") > 0), 100.0))
    else:
        value = F.coalesce(known, F.lit(100.0))
    return x.select("symbol", "et_date", value.alias("rsi"))


def swing_high(bars, w_half):
    """High is the maximum of a full centred window."""
    def mark(r, w):
        f = w.rowsBetween(-w_half, w_half)
        return r.withColumn("swing_high", (F.count("high").over(f) == 2 * w_half + 1) & (F.col("high") >= F.max("high").over(f)))

    return spread.in_blocks(bars, "symbol", w_half, w_half, mark)


def vol_scale(daily, n=20, lo=0.5, hi=2.0):
    """Median volatility so far over current volatility, clipped; 1 while unknown."""
    w = by_day()
    d = daily.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    d = d.withColumn("_v", guarded(F.stddev_samp, F.col("_r"), w.rowsBetween(-(n - 1), 0), n))
    d = expanding_quantile(d, "symbol", "et_date", "_v", 0.5, "_med")
    return d.withColumn("scale", F.coalesce(clip(F.try_divide("_med", "_v"), lo, hi), F.lit(1.0))).drop("_r", "_v", "_med")


def partial_drawdown(daily, n=252):
    """Distance from the high of the last n days, or of as many as exist."""
    return daily.withColumn("dd", (F.col("close") / F.max("close").over(by_day().rowsBetween(-(n - 1), 0)) - 1) * 100)


def all_time_high(daily):
    return daily.withColumn("ath_dist", F.col("close") / F.max("close").over(by_day().rowsBetween(W.unboundedPreceding, 0)) - 1)


def trailing_failures(polls):
    """Per source, failed polls after the last successful one: two partial aggregates, no ordered window."""
    ok = polls.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.struct("polled_at", "poll_id"))).alias("_ok"), F.max("polled_at").alias("last_poll"))
    p = polls.join(ok, "source_id")
    after = F.col("_ok").isNull() | (F.struct("polled_at", "poll_id") > F.col("_ok"))
    return p.groupBy("source_id", "last_poll").agg(F.sum(after.cast("int")).cast("bigint").alias("failures"))


def zero_output_alerts(polls, n):
    """Ok-and-empty streaks: one alert per source and day, on the first poll whose streak reaches n."""
    hour = F.to_date("polled_at")
    p = spread.positions(polls.withColumn("_d", hour), "source_id", "_d", ["polled_at", "poll_id"])
    bad = ~(F.col("ok") & (F.col("n_new") == 0))
    s = spread.running(p, "source_id", "_d", ["polled_at", "poll_id"], _last=("max", F.when(bad, F.col("pos"))))
    s = s.withColumn("streak", F.col("pos") - F.coalesce("_last", F.lit(-1)))
    return s.filter(F.col("streak") >= n).groupBy("source_id", F.col("_d").alias("day")).agg(
        F.min("polled_at").alias("alert_at"), F.min_by("streak", "polled_at").alias("streak"))


def top_n_per_source(events, n, limit):
    """Newest n per source, then the newest of those overall (the per-group limit runs before the shuffle)."""
    w = W.partitionBy("source_id").orderBy(F.desc("observed_time"), F.desc("event_id"))
    top = events.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return top.orderBy(F.desc("observed_time"), F.desc("event_id")).limit(limit)


def latest_poll(polls):
    return polls.groupBy("source_id").agg(F.max_by(F.struct("poll_id", "polled_at", "ok", "n_seen"), F.struct("polled_at", "poll_id")).alias("p")).select("source_id", "p.*")


def dip_entries(bars, d):
    """Close crosses below the running day high times (1-d); entry is the next bar of the same day."""
    w = W.partitionBy("symbol", "et_date").orderBy("ts")
    hi = F.max("high").over(w.rowsBetween(W.unboundedPreceding, 0))
    b = bars.withColumn("_below", F.col("close") <= hi * (1 - d))
    b = b.withColumn("cross", F.col("_below") & ~F.coalesce(F.lag("_below").over(w), F.lit(False)))
    b = b.withColumn("entry_ts", F.lead("ts").over(w)).withColumn("entry_open", F.lead("open").over(w))
    return b.filter(F.col("cross") & F.col("entry_ts").isNotNull()).drop("_below", "cross")


def overlay_return(daily, off, beta=1.0, cash_rate=0.04, cost=0.001):
    """exposure * r + (1 - exposure) * cash - cost * |change of exposure|."""
    w = by_day()
    d = daily.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1).withColumn("expo", F.when(F.col(off), 0.0).otherwise(beta))
    chg = F.coalesce(F.abs(F.col("expo") - F.lag("expo").over(w)), F.lit(0.0))
    return d.withColumn("ret", F.col("expo") * F.col("_r") + (1 - F.col("expo")) * cash_rate / 252 - chg * cost).drop("_r")


def nav_drawdown(path, equity="equity", flow="flow"):
    """Unit value that ignores deposits: nav *= equity / (previous equity + flow)."""
    w = by_day()
    base = F.lag(equity).over(w) + F.col(flow)
    step = F.when(base > 0, F.col(equity) / base).otherwise(1.0)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    p = path.withColumn("_s", F.log(F.coalesce(step, F.lit(1.0)))).withColumn("nav", F.exp(F.sum("_s").over(run)))
    return p.withColumn("nav_dd", F.col("nav") / F.max("nav").over(run) - 1).drop("_s")


def periodic_investment(daily, deposit, slip=0.0002, fee=0.0001):
    """Deposit on each month's first trading day, invested at that open: shares are a running sum."""
    w = by_day()
    first = F.coalesce(F.trunc("et_date", "month") != F.trunc(F.lag("et_date").over(w), "month"), F.lit(True))
    d = daily.withColumn("flow", F.when(first, float(deposit)).otherwise(0.0))
    bought = F.col("flow") * (1 - fee) / (F.col("open") * (1 + slip))
    d = d.withColumn("shares", F.sum(bought).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return d.withColumn("equity", F.col("shares") * F.col("close"))


def cash_balance(daily, deposit, rate):
    """Each deposit grows at (1+rate)^(days/365.25). Discounting deposits to day zero turns it into a running sum."""
    w = by_day()
    first = F.coalesce(F.trunc("et_date", "month") != F.trunc(F.lag("et_date").over(w), "month"), F.lit(True))
    t = F.datediff("et_date", F.min("et_date").over(W.partitionBy("symbol"))) / 365.25
    growth = F.pow(F.lit(1.0 + rate), t)
    pv = F.when(first, deposit / growth).otherwise(0.0)
    return daily.withColumn("_pv", pv).withColumn("balance", F.sum("_pv").over(w.rowsBetween(W.unboundedPreceding, 0)) * growth).drop("_pv")


def post_trend(daily_counts, n=30, base_n=365, key="symbol", value="n"):
    """Second-half mean over first-half mean of the window, and the window mean over its prior-year base."""
    w = by_day(key)
    win = w.rowsBetween(-n, 0)
    half = (n + 1) // 2
    first, second = w.rowsBetween(-n, -n + half - 1), w.rowsBetween(-n + half, 0)
    full = F.count(value).over(win) == n + 1
    base = F.avg(value).over(w.rowsBetween(-n - base_n, -n - 1))
    a, b = F.avg(value).over(first), F.avg(value).over(second)
    return daily_counts.withColumn("mean_win", F.when(full, F.avg(value).over(win))).withColumn(
        "trend_ratio", F.when(full & (a > 0), b / a)).withColumn("vs_base", F.when(full & (base > 0), F.avg(value).over(win) / base))
