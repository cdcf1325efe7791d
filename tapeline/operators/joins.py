"""Event and panel joins built on equi-joins and the as-of stream of ``asof``."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times as tm
from .asof import asof_backward, asof_forward


def attach(df, one_row, name="tot"):
    """Attach a one-row aggregate as a struct through a scalar subquery."""
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns)).scalar())


def act_day(events, daily, key="symbol", time="event_time", max_gap_days=None):
    """First trading day whose open is strictly later than the event; NULL when it is too far away."""
    out = asof_forward(events, daily, key, time, "open_time", ["et_date", "d"], strict=True, prefix="act_")
    if max_gap_days is None:
        return out
    ok = F.datediff("act_et_date", tm.et_date(time)) <= max_gap_days
    return out.withColumn("act_d", F.when(ok, F.col("act_d"))).withColumn("act_et_date", F.when(ok, F.col("act_et_date")))


def precursor(events, triggers, lookback, key="symbol"):
    """Latest trigger strictly before each event. A trigger's act day rises with its time, so that one decides:
    flag = its act day is within ``lookback`` of the event's, gap = the distance. Both sides have (time, act)."""
    out = asof_backward(events, triggers, key, "time", "time", ["act"], strict=True, prefix="pre_")
    near = F.col("pre_act") >= F.col("act") - lookback
    return out.withColumn("has_pre", F.coalesce(near, F.lit(False))).withColumn("gap", F.when(near, F.col("act") - F.col("pre_act"))).drop("pre_act")


def inner_bars(fine, width_min):
    """Each fine bar with the coarse bucket it lies in; join on (symbol, bucket)."""
    us = width_min * 60_000_000
    return fine.withColumn("bucket", tm.from_micros(F.floor(tm.micros("ts") / us) * us))


def next_bucket_bars(coarse, fine, width_min):
    """Fine bars inside the bucket that follows each coarse bar, same ET day."""
    c = coarse.select("symbol", "et_date", tm.plus_seconds("ts", width_min * 60).alias("bucket"), F.col("ts").alias("signal_ts"), F.col("close").alias("signal_close"))
    return inner_bars(fine, width_min).join(c, ["symbol", "et_date", "bucket"])


def entry_bar(coarse, fine, width_min):
    """First fine bar at or after the end of each coarse bucket, if it lies in the same ET day."""
    c = coarse.withColumn("end_ts", tm.plus_seconds("ts", width_min * 60))
    f = fine.select("symbol", F.col("ts").alias("entry_ts"), F.col("et_date").alias("entry_date"), F.col("open").alias("entry_open"))
    out = asof_forward(c, f, "symbol", "end_ts", "entry_ts", ["entry_ts", "entry_date", "entry_open"], strict=False)
    return out.filter(F.col("entry_date") == F.col("et_date")).drop("entry_date")


def by_day_flag(trades, flags, flag, default):
    return trades.join(flags.select("symbol", "et_date", flag), ["symbol", "et_date"], "left").withColumn(flag, F.coalesce(flag, F.lit(default)))


def exact_lookup(events, bars, max_missing=0.05):
    """Event times must exist among the bars. Returns the matches; fails when more than ``max_missing`` are absent.
    The check is one aggregate row."""
    j = events.join(bars.select("symbol", "ts", F.col("close").alias("bar_close")), ["symbol", "ts"], "left")
    miss = j.agg(F.avg(F.col("bar_close").isNull().cast("int")).alias("m")).first()["m"]
    if miss is not None and miss > max_missing:
        raise ValueError(f"{miss:.1%} of event times have no bar: events and bars cover different periods")
    return j.filter(F.col("bar_close").isNotNull())


def oi_changes(chain, top=5):
    """Open-interest change of the latest snapshot against the one before, largest moves first."""
    days = chain.select("snapshot_date").distinct().orderBy(F.desc("snapshot_date")).limit(2)
    ends = days.agg(F.max("snapshot_date").alias("cur"), F.min("snapshot_date").alias("prev"))
    c = attach(chain, ends, "_e")
    cur = c.filter((F.col("snapshot_date") == F.col("_e.cur")) & F.col("oi").isNotNull()).select("contract", F.col("oi").alias("oi_now"))
    prev = c.filter(F.col("snapshot_date") == F.col("_e.prev")).select("contract", F.col("oi").alias("oi_prev"))
    d = cur.join(prev, "contract", "left").withColumn("d_oi", F.col("oi_now") - F.coalesce("oi_prev", F.lit(0)))
    return d.orderBy(F.desc(F.abs("d_oi")), "contract").limit(top).select("contract", "oi_now", "d_oi")


def trade_diff(a, b, keys, tol=1e-9):
    """Full-outer comparison of two trade streams with one status per entry."""
    x = a.select(*keys, F.col("direction").alias("dir_a"), F.col("ret").alias("ret_a"))
    y = b.select(*keys, F.col("direction").alias("dir_b"), F.col("ret").alias("ret_b"))
    j = x.join(y, keys, "full_outer")
    st = (
        F.when(F.col("ret_b").isNull(), "only_a").when(F.col("ret_a").isNull(), "only_b")
        .when(F.col("dir_a") != F.col("dir_b"), "direction").when(F.abs(F.col("ret_a") - F.col("ret_b")) >= tol, "ret").otherwise("same")
    )
    return j.withColumn("status", st)


def prob_parity(ref, new, keys):
    """Per reference row the nearest recomputed probability of the same entry; then the worst gap and missing entries."""
    # neighbours by value instead of all pairs: the nearest is the last at or below, or the first at or above
    r = ref.withColumn("_k", F.concat_ws("|", *[F.col(k).cast("string") for k in keys])).withColumn("_p", F.floor(F.col("prob") * 1e12).cast("bigint"))
    n = new.withColumn("_k", F.concat_ws("|", *[F.col(k).cast("string") for k in keys])).select("_k", F.floor(F.col("prob") * 1e12).cast("bigint").alias("_q"), F.col("prob").alias("near"))
    lo = asof_backward(r, n, "_k", "_p", "_q", ["near"], unit="values", prefix="lo_")
    both = asof_forward(lo, n, "_k", "_p", "_q", ["near"], strict=False, unit="values", prefix="hi_")
    return both.withColumn("diff", F.least(F.abs(F.col("prob") - F.col("lo_near")), F.abs(F.col("hi_near") - F.col("prob")))).agg(
        F.count(F.lit(1)).alias("n_ref"), F.max("diff").alias("max_diff"), F.sum(F.col("diff").isNull().cast("int")).cast("bigint").alias("missing"))


def divergence(main, shadow):
    """Same-day disagreement of two state series; calibrating days are counted apart."""
    j = main.select("symbol", "et_date", F.col("state").alias("a")).join(shadow.select("symbol", "et_date", F.col("state").alias("b")), ["symbol", "et_date"])
    cal = F.col("a") == "CALIBRATING"
    return j.groupBy("symbol").agg(
        F.sum((~cal & (F.col("a") != F.col("b"))).cast("int")).cast("bigint").alias("n_diverged"),
        F.sum(cal.cast("int")).cast("bigint").alias("n_calibrating"), F.count(F.lit(1)).alias("n_days"))


def merge_states(days, history, live):
    """Live state wins, then history (or its blind mark), then 'blind' for days nobody covers."""
    h = history.select("symbol", "et_date", F.col("state").alias("_h"), F.col("blind").alias("_b"))
    l = live.select("symbol", "et_date", F.col("state").alias("_l"))
    j = days.join(h, ["symbol", "et_date"], "left").join(l, ["symbol", "et_date"], "left")
    src = F.when(F.col("_l").isNotNull(), "live").when(F.col("_h").isNotNull() & ~F.col("_b"), "history").otherwise("blind")
    return j.withColumn("src", src).withColumn("state", F.coalesce("_l", "_h", F.lit(""))).drop("_h", "_b", "_l")


def nearest_vectors(points, id_col, vector, current_id=None, k=3):
    """Nearest points to one current point (the newest id unless given) on z-scored dimensions; missing dimensions rescale the distance.

    ``vector`` is an array of any length with NULL where a dimension is missing. Moments come from one aggregate by dimension and are
    attached as one row of arrays; the top k is a limited sort, so nothing is paired up.
    """
    ids = points.agg(F.max(id_col).alias("id")) if current_id is None else None
    is_now = F.col(id_col) == (F.lit(current_id) if ids is None else ids.scalar())
    dims = points.select(F.posexplode(vector).alias("i", "x"))
    mom = dims.groupBy("i").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    mom = mom.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")).alias("sd")))), lambda m: m["sd"]).alias("sd"))
    cur = points.filter(is_now).agg(F.max_by(vector, id_col).alias("x"))
    p = attach(attach(points, mom, "_m"), cur, "_x")
    diff = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.col("_x.x").alias("c"), F.col("_m.sd").alias("sd")), lambda z: (z["x"] - z["c"]) / z["sd"])
    there = F.filter("_d", lambda d: d.isNotNull())
    d = p.withColumn("_d", diff).withColumn("_n", F.size(there)).filter((F.col("_n") > 0) & ~is_now)
    sq = F.aggregate(there, F.lit(0.0), lambda acc, x: acc + x * x)
    d = d.withColumn("dist", F.sqrt(sq * F.size(vector) / F.col("_n")))
    return d.orderBy("dist", id_col).limit(k).select(id_col, "dist")


def nearest_point(events, points, key="symbol", pos="d"):
    """Signed distance from each event to the closest point of its key on the ordinal axis (ties take the earlier)."""
    pts = points.select(key, F.col(pos).alias("point"))
    both = asof_forward(asof_backward(events, pts, key, pos, "point", ["point"], prefix="b_"), pts, key, pos, "point", ["point"], prefix="f_")
    back, fwd = F.col(pos) - F.col("b_point"), F.col("f_point") - F.col(pos)
    dist = F.when(fwd.isNull() | (back <= fwd), back).otherwise(-fwd)
    return both.withColumn("distance", dist).drop("b_point", "f_point")


def before_after(old, new, keys, cols):
    """Metric tables before and after a correction: rows where any metric changed, with differences."""
    j = old.select(*keys, *[F.col(c).alias(f"{c}_old") for c in cols]).join(new.select(*keys, *[F.col(c).alias(f"{c}_new") for c in cols]), keys)
    changed = F.lit(False)
    for c in cols:
        j = j.withColumn(f"{c}_delta", F.col(f"{c}_new") - F.col(f"{c}_old"))
        changed = changed | (F.abs(F.col(f"{c}_delta")) > 1e-9)
    return j.filter(changed)


def merge_prices(history, newer, tol=0.01):
    """History extended by a newer source. If the two disagree on the history's last day, its symbol's history is dropped."""
    last = history.groupBy("symbol").agg(F.max("et_date").alias("last_day"), F.max_by("close", "et_date").alias("last_close"))
    chk = last.join(newer.select("symbol", F.col("et_date").alias("last_day"), F.col("close").alias("new_close")), ["symbol", "last_day"], "left")
    chk = chk.select("symbol", "last_day", F.coalesce(F.abs(F.col("new_close") / F.col("last_close") - 1) > tol, F.lit(False)).alias("broken"))
    h = history.join(chk.filter(~F.col("broken")).select("symbol"), "symbol", "left_semi").withColumn("src", F.lit("history"))
    n = newer.join(chk, "symbol", "left").filter(F.col("last_day").isNull() | F.col("broken") | (F.col("et_date") > F.col("last_day")))
    return h.select("symbol", "et_date", "close", "src").unionByName(n.select("symbol", "et_date", "close", F.lit("newer").alias("src")))


def recent_jumps(releases_with_act, days, lookback=20, jump=10.0, guard=80.0):
    """For each day the jump releases whose act day lies within ``lookback`` trading days; suspects are marked.

    Each release is copied to the days it is recent for (a literal span of lookback + 1 ordinals), then equi-joined.
    """
    r = releases_with_act.filter((F.col("change_pct") >= jump) & F.col("act_d").isNotNull()).withColumn("suspect", F.col("change_pct") >= guard)
    r = r.withColumn("d", F.explode(F.sequence(F.col("act_d"), F.col("act_d") + lookback)))
    return r.select("symbol", "d", "published", "change_pct", "suspect").join(days.select("symbol", "d", "et_date"), ["symbol", "d"])
