"""State overlays: triggers, persistent off-states, episodes, the daily detector, scoring of interpretations.

All inputs are daily per symbol, so per-symbol windows are bounded by the calendar.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finance as fin
from ..functions import times as tm
from .asof import asof_backward, asof_forward
from .expanding import expanding_quantile
from .joins import precursor


def by_d(key="symbol"):
    return W.partitionBy(key).orderBy("d")


def triggers(dense, jumps, logic, lookback=20):
    """AND: dense days with a jump before them; OR: either leg; or one leg alone. Distinct (symbol, act)."""
    both = precursor(dense, jumps, lookback).filter("has_pre").select("symbol", "act")
    legs = {"AND": [both], "OR": [dense.select("symbol", "act"), jumps.select("symbol", "act")],
            "dense_only": [dense.select("symbol", "act")], "jump_only": [jumps.select("symbol", "act")]}[logic]
    out = legs[0]
    for x in legs[1:]:
        out = out.unionByName(x)
    return out.distinct()


def off_days(daily, trig, end):
    """Day is off while any earlier trigger's end lies beyond it. ``end`` is a column on the triggers (exclusive);
    overlapping windows extend each other, which is a running maximum."""
    e = trig.withColumn("_end", end).groupBy("symbol", F.col("act").alias("d")).agg(F.max("_end").alias("_end"))
    j = daily.join(e, ["symbol", "d"], "left")
    run = F.max("_end").over(by_d().rowsBetween(W.unboundedPreceding, 0))
    return j.withColumn("off", F.coalesce(F.col("d") < run, F.lit(False))).drop("_end")


def until_reversal(daily, trig, releases):
    """Off until the act day of the next release with a falling reading (or the end of the data)."""
    opens = daily.select("symbol", F.col("d").alias("act"), "open_time")
    down = releases.filter("change_pct < 0 AND act_d IS NOT NULL").select("symbol", "published", F.col("act_d").alias("rev"))
    t = asof_forward(trig.join(opens, ["symbol", "act"]), down, "symbol", "open_time", "published", ["rev"], strict=True)
    return off_days(daily, t, F.coalesce("rev", F.lit(1 << 40)))


def overlay_equity(daily, off="off", slip=fin.SLIP, fee=fin.FEE):
    """Hold or cash, switched at the open with costs: one factor per day from (state, previous state)."""
    w = by_d()
    prev = F.lag(off).over(w)
    c0 = F.lag("close").over(w)
    enter, leave = (1 - fee) / (1 + slip), (1 - slip) * (1 - fee)
    hold = ~F.col(off)
    factor = (
        F.when(prev.isNull(), F.when(hold, enter * F.col("close") / F.col("open")).otherwise(1.0))
        .when(hold & ~prev, F.col("close") / c0).when(~hold & ~prev, F.col("open") / c0 * leave)
        .when(hold & prev, enter * F.col("close") / F.col("open")).otherwise(1.0)
    )
    d = daily.withColumn("_f", factor).withColumn("switched", F.coalesce((prev != F.col(off)).cast("int"), F.lit(0)))
    return d.withColumn("equity", F.exp(F.sum(F.log("_f")).over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_f")


def episode_stats(daily, off="off", judge=-0.0005):
    """Episodes of the off state: count, right share (price fell over the episode), mean return, days."""
    w = by_d()
    g = daily.withColumn("_g", F.col("d") - F.row_number().over(W.partitionBy("symbol", off).orderBy("d"))).filter(off)
    ep = g.groupBy("symbol", "_g").agg((F.max_by("close", "d") / F.min_by("open", "d") - 1).alias("r"), F.count(F.lit(1)).alias("n"))
    return ep.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_eps"), F.sum((F.col("r") < judge).cast("int")).cast("bigint").alias("n_right"), F.avg("r").alias("mean_ep_ret"),
        F.sum("n").alias("off_days"))


def segment_eval(daily, off="off"):
    """Episode statistics with the overlay's total return against buy-and-hold."""
    o = overlay_equity(daily, off).groupBy("symbol").agg((F.max_by("equity", "d") - 1).alias("overlay_total"), F.sum("switched").alias("switches"))
    h = overlay_equity(daily.withColumn("_never", F.lit(False)), "_never").groupBy("symbol").agg((F.max_by("equity", "d") - 1).alias("bh_total"))
    out = o.join(h, "symbol").join(episode_stats(daily, off), "symbol", "left")
    return out.withColumn("cover_diff", F.col("overlay_total") - F.col("bh_total"))


def switch_latency(daily, off, lo, hi, ret):
    """Days from the window's peak to the first off day, from its bottom to reopening, and the loss share before."""
    win = daily.filter(F.col("et_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    pk = win.groupBy("symbol").agg(F.max_by("d", F.struct(F.col("close"), -F.col("d"))).alias("peak_d"), F.exp(F.sum(F.log1p(ret))).alias("_all"))
    bt = win.join(pk, "symbol").filter("d >= peak_d").groupBy("symbol").agg(F.min_by("d", F.struct("close", "d")).alias("bottom_d"))
    ends = pk.join(bt, "symbol")
    j = daily.join(ends, "symbol")
    a = j.groupBy("symbol", "peak_d", "bottom_d", "_all").agg(
        F.min(F.when((F.col("d") >= F.col("peak_d")) & F.col(off), F.col("d"))).alias("off_d"),
        F.min(F.when((F.col("d") >= F.col("bottom_d")) & ~F.col(off), F.col("d"))).alias("open_d"))
    k = win.join(a.select("symbol", "off_d"), "symbol").groupBy("symbol").agg(
        F.coalesce(F.exp(F.sum(F.when(F.col("d") < F.col("off_d"), F.log1p(ret)))), F.lit(1.0)).alias("_b"))
    out = a.join(k, "symbol")
    total = F.col("_all") - 1
    return out.select(
        "symbol", "peak_d", "bottom_d", (F.col("off_d") - F.col("peak_d")).alias("off_lag"),
        F.when(F.col("open_d") >= F.col("off_d"), F.col("open_d") - F.col("bottom_d")).alias("reopen_lag"),
        F.when(total < 0, (F.col("_b") - 1) / total).alias("loss_share"))


def detector_daily(days, counts, jumps, q=0.9, calib=20, persist=20, lookback=20):
    """Daily detector state from post counts (NULL = blind day) and credible jump releases.

    A trading day judges the natural days since the previous trading day. Its threshold is the quantile of all
    counts before that window; signals start after ``calib`` days with any count; a dense day with a recent jump
    published before its end starts or extends an off window of ``persist`` trading days.
    """
    c = expanding_quantile(counts, "symbol", "et_date", "n", q, "thr_before", inclusive=False)
    c = asof_forward(c, days.select("symbol", F.col("et_date").alias("t_date"), F.col("d").alias("t")), "symbol", "et_date", "t_date", ["t"], strict=True).filter("t IS NOT NULL")
    c = c.withColumn("day_end", tm.plus_seconds(F.date_add("et_date", 1).cast("timestamp_ntz"), 5 * 3600 - 1))
    c = asof_backward(c, jumps, "symbol", "day_end", "time", ["act"], strict=True, prefix="jump_")
    wt = W.partitionBy("symbol", "t").orderBy("et_date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    c = c.withColumn("thr", F.first("thr_before").over(wt))
    hit = (F.col("n") > F.col("thr")) & (F.col("jump_act") >= F.col("t") - lookback)
    row = c.groupBy("symbol", F.col("t").alias("d")).agg(
        F.max("n").alias("max_n"), F.first("thr").alias("thr"), (F.count("n") > 0).alias("valid"), F.max(F.coalesce(hit, F.lit(False))).alias("hit"))
    s = days.select("symbol", "et_date", "d").join(row, ["symbol", "d"], "left")
    wd = by_d()
    n_eff = F.coalesce(F.sum(F.coalesce(F.col("valid"), F.lit(False)).cast("int")).over(wd.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("n_eff_before", n_eff).withColumn("active", F.col("n_eff_before") >= calib)
    s = s.withColumn("triggered", F.col("active") & F.coalesce("hit", F.lit(False)))
    until = F.max(F.when(F.col("triggered"), F.col("d") + persist - 1)).over(wd.rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumn("_u", until)
    state = F.when(~F.col("active"), "CALIBRATING").when(F.col("_u") >= F.col("d"), "RISK_OFF").otherwise("RISK_ON")
    return s.withColumn("state", state).select("symbol", "et_date", "d", "n_eff_before", "triggered", "state")


def shadow_daily(days, jumps, persist=30):
    """Single-leg shadow: every credible jump opens a window at its act day; state, trigger and open-window count."""
    ev = jumps.groupBy("symbol", F.col("act").alias("d")).agg(F.count(F.lit(1)).alias("_n"))
    j = days.select("symbol", "et_date", "d").join(ev, ["symbol", "d"], "left")
    n = F.coalesce(F.sum("_n").over(by_d().rowsBetween(-(persist - 1), 0)), F.lit(0))
    return j.withColumn("n_active", n).withColumn("triggered", F.col("_n").isNotNull()).withColumn(
        "state", F.when(F.col("n_active") > 0, "RISK_OFF").otherwise("RISK_ON")).drop("_n")


def effective_baseline(rows):
    """Rows whose count map has any value, and distinct days that are NULL in some map. ``rows`` carry window MAP<DATE,INT>."""
    eff = rows.groupBy("symbol").agg(F.sum((F.size(F.map_filter("window", lambda k, v: v.isNotNull())) > 0).cast("int")).cast("bigint").alias("n_effective"))
    blind = rows.select("symbol", F.explode("window").alias("day", "n")).groupBy("symbol").agg(F.count_distinct(F.when(F.col("n").isNull(), F.col("day"))).alias("n_blind"))
    return eff.join(blind, "symbol", "left").withColumn("n_blind", F.coalesce("n_blind", F.lit(0)))


def score_interpretations(interps, daily, done_before):
    """D1 = first session opening at or after the anchor; its return and the 5-session return, judged by direction.

    A session counts when its close + 5 minutes is not after ``done_before`` (the earlier of now and the fetch time).
    """
    w = W.partitionBy("symbol").orderBy("et_date")
    done = F.lit(done_before).cast("timestamp_ntz")
    s = daily.select(
        "symbol", F.col("et_date").alias("d1_date"), "open_time", (F.col("close") / F.col("open") - 1).alias("_r1"), (F.lead("close", 4).over(w) / F.col("open") - 1).alias("_r5"),
        (tm.plus_seconds("close_time", 300) <= done).alias("_ok1"), (tm.plus_seconds(F.lead("close_time", 4).over(w), 300) <= done).alias("_ok5"))
    j = asof_forward(interps, s, "symbol", "created", "open_time", ["d1_date", "_r1", "_r5", "_ok1", "_ok5"], strict=False)
    r1 = F.when(F.col("_ok1"), F.col("_r1"))
    r5 = F.when(F.col("_ok1") & F.col("_ok5"), F.col("_r5"))
    j = j.withColumn("ret_1d", r1).withColumn("ret_5d", r5)
    directional = F.col("direction").isin("bullish", "bearish")

    def judge(r):
        right = F.when(F.col("direction") == "bullish", r > 0).otherwise(r < 0)
        return F.when(directional, F.when(r.isNull(), "pending").when(right, "hit").otherwise("miss"))

    return j.withColumn("score_1d", judge(F.col("ret_1d"))).withColumn("score_5d", judge(F.col("ret_5d"))).drop("_r1", "_r5", "_ok1", "_ok5")


def merge_scores(old, new, key="event_id", tol=1e-9):
    """Write-once merge: stored values stay, NULLs fill, pending may become final; neutral scores stay NULL."""
    j = old.alias("o").join(new.alias("n"), key, "full_outer")
    known = F.col("o._row").isNotNull()
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)

    def score(c):
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        return F.when(~known, n).when((o == "pending") & n.isin("hit", "miss"), n).otherwise(o).alias(c)

    return j.select(key, keep("d1_date"), keep("ret_1d"), keep("ret_5d"), score("score_1d"), score("score_5d"))


def score_conflicts(old, new, key="event_id", tol=1e-9):
    """Recomputed values that disagree with a frozen one: one row per (key, field)."""
    j = old.alias("o").join(new.alias("n"), key)
    num = lambda c: F.abs(F.col(f"o.{c}") - F.col(f"n.{c}")) > tol
    fin_ = lambda c: F.col(f"o.{c}").isin("hit", "miss") & F.col(f"n.{c}").isin("hit", "miss") & (F.col(f"o.{c}") != F.col(f"n.{c}"))
    checks = [("d1_date", F.col("o.d1_date") != F.col("n.d1_date")), ("ret_1d", num("ret_1d")), ("ret_5d", num("ret_5d")), ("score_1d", fin_("score_1d")), ("score_5d", fin_("score_5d"))]
    arr = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks])
    return j.select(key, F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("field"))


def to_score(interps, scores, key="event_id"):
    """Interpretations that are new or not settled yet."""
    settled = scores.filter("ret_1d IS NOT NULL AND ret_5d IS NOT NULL").select(key)
    return interps.join(settled, key, "left_anti")
