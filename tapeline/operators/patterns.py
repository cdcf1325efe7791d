"""Sequential price patterns: V shapes, zigzag swings, pits and tops.

Each operator first finds candidates in parallel, then runs a small ordered fold over the few candidates left.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from . import chain, spread
from .settle import non_overlap


def v_candidates(bars, drops):
    """Per peak bar and drop size: the re-anchored peak and the first masked trough of the same ET day.

    ``bars`` carry pos, et_date, ts, close, is_peak, is_trough. A day's bars become one array (a day has a fixed
    number of bars), and each peak folds over the rest of its own day. A drop may last as many bars as the symbol's median day has.
    """
    bar = F.struct("pos", "ts", "close", "is_trough")
    day = bars.groupBy("symbol", "et_date").agg(
        F.array_sort(F.collect_list(bar)).alias("day"), F.collect_list(F.when(F.col("is_peak"), F.col("pos"))).alias("peaks"))
    limit = day.groupBy("symbol").agg(F.floor(F.percentile(F.size("day"), 0.5)).alias("_limit"))
    p = day.select("symbol", "et_date", "day", F.explode("peaks").alias("peak_pos")).join(limit, "symbol")
    p = p.withColumn("_i", F.array_position(F.transform("day", lambda b: b["pos"]), F.col("peak_pos")).cast("int"))
    p = p.withColumn("_from", F.get("day", F.col("_i") - 1)).withColumn("_rest", F.slice("day", F.col("_i") + 1, F.size("day")))
    p = p.drop("day").withColumn("x", F.explode(F.array(*[F.lit(float(x)) for x in drops])))
    none = F.lit(None).cast(bars.select(bar.alias("b")).schema["b"].dataType)
    start = F.struct(F.col("_from").alias("peak"), none.alias("trough"), F.lit(False).alias("stop"))

    def step(acc, b):
        peak = acc["peak"]
        far = (b["pos"] - peak["pos"]) > F.col("_limit")
        higher = b["close"] > peak["close"]
        found = b["is_trough"] & ((peak["close"] - b["close"]) / peak["close"] >= F.col("x"))
        nxt = F.when(far, F.struct(peak.alias("peak"), none.alias("trough"), F.lit(True).alias("stop"))).when(
            higher, F.struct(b.alias("peak"), none.alias("trough"), F.lit(False).alias("stop"))).when(
            found, F.struct(peak.alias("peak"), b.alias("trough"), F.lit(True).alias("stop"))).otherwise(acc)
        return F.when(acc["stop"], acc).otherwise(nxt)

    r = p.withColumn("_r", F.aggregate("_rest", start, step)).filter(F.col("_r.trough").isNotNull())
    return r.select(
        "symbol", "et_date", "x", "peak_pos", F.col("_r.peak.pos").alias("anchor_pos"), F.col("_r.peak.ts").alias("peak_t"), F.col("_r.peak.close").alias("peak_p"),
        F.col("_r.trough.pos").alias("trough_pos"), F.col("_r.trough.ts").alias("trough_t"), F.col("_r.trough.close").alias("trough_p"))


def v_rebounds(cands, bars, rebounds, horizons):
    """For each candidate, rebound size and horizon: the first close at or above trough * (1 + y) within T bars
    (days may be crossed), and whether the whole window lies inside the data."""
    t_max = max(horizons)
    b = spread.in_blocks(bars, "symbol", 0, t_max, lambda r, w: r.withColumn(
        "ahead", F.collect_list(F.struct("pos", "ts", "close")).over(w.rowsBetween(1, t_max))).filter("is_trough"))
    j = cands.join(b.select("symbol", F.col("pos").alias("trough_pos"), "ahead"), ["symbol", "trough_pos"])
    j = j.withColumn("y", F.explode(F.array(*[F.lit(float(y)) for y in rebounds]))).withColumn("T", F.explode(F.array(*[F.lit(t) for t in horizons])))
    hit = F.get(F.filter(F.slice("ahead", F.lit(1), F.col("T")), lambda b: (b["close"] - F.col("trough_p")) / F.col("trough_p") >= F.col("y")), F.lit(0))
    j = j.withColumn("_h", hit).withColumn("complete", F.size("ahead") >= F.col("T"))
    return j.withColumn("rebound_pos", F.col("_h.pos")).withColumn("rebound_t", F.col("_h.ts")).withColumn("rebound_p", F.col("_h.close")).drop("ahead", "_h")


def v_events(cands):
    """Scan order: after a rebound the scan resumes behind it; timeouts do not block, need a complete window,
    and count once per (anchor, trough)."""
    c = cands.withColumn("_end", F.coalesce("rebound_pos", "peak_pos"))
    kept = non_overlap(c, ["symbol", "x", "y", "T"], "peak_pos", "_end", "et_date")
    kept = kept.filter(F.col("rebound_pos").isNotNull() | F.col("complete"))
    w = W.partitionBy("symbol", "x", "y", "T", "anchor_pos", "trough_pos", F.col("rebound_pos").isNull()).orderBy("peak_pos")
    kept = kept.withColumn("_n", F.row_number().over(w)).filter(F.col("rebound_pos").isNotNull() | (F.col("_n") == 1))
    return kept.select(
        "symbol", "et_date", "x", "y", "T", "peak_t", "peak_p", "trough_t", "trough_p", "rebound_t", "rebound_p",
        ((F.col("peak_p") - F.col("trough_p")) / F.col("peak_p")).alias("drop_pct"),
        ((F.col("rebound_p") - F.col("trough_p")) / F.col("trough_p")).alias("rebound_pct"),
        (F.col("trough_pos") - F.col("anchor_pos")).alias("bars_to_trough"), (F.col("rebound_pos") - F.col("trough_pos")).alias("bars_to_rebound"),
        F.when(F.col("rebound_pos").isNotNull(), "rebounded").otherwise("timeout").alias("outcome"), "anchor_pos", "trough_pos")


def dedup_events(events, combo, keys=("symbol", "anchor_pos", "trough_pos")):
    """One row per physical event: the loosest combo that saw it, and how many did."""
    row = F.struct(*[c for c in events.columns if c not in keys])
    g = events.groupBy(*keys).agg(F.min_by(row, F.struct(*combo)).alias("_r"), F.count(F.lit(1)).alias("n_param_combos"))
    return g.select(*keys, "_r.*", "n_param_combos")


# ------------------------------------------------------------------ zigzag

def zigzag(bars, thresholds, size=chain.SIZE):
    """Percent-reversal pivots per (symbol, threshold): symbol, theta, n, pos, ts, price, kind.

    A leg is open from the first bar that is ``theta`` away from the series' first price. From there on the state is (trend, extreme); blocks of
    ``size`` bars are summed up as maps of it and composed (``chain``), so no task walks a whole symbol. The first bar is a pivot too.
    """
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    base = bars.groupBy("symbol").agg(F.min(F.struct("pos", "close", "ts")).alias("ref"))
    rows = cut(bars.select("symbol", "et_date", "pos", "ts", "close").join(base, "symbol"), "path").withColumn("theta", grid)
    move = (F.col("close") - F.col("ref.close")) / F.col("ref.close")
    first = rows.filter(F.abs(move) >= F.col("theta")).groupBy("symbol", "theta").agg(F.min(F.struct("pos", "close", F.signum(move).alias("trend"))).alias("_f"))
    start = first.select("symbol", "theta", F.array("_f.trend", "_f.close", F.col("_f.pos").cast("double")).alias("state"))
    path = rows.join(first, ["symbol", "theta"]).filter(F.col("pos") >= F.col("_f.pos"))
    legs = cut(chain.percent_turns(path, ["symbol", "theta"], "theta", "pos", "close", start, size), "legs")
    kind = F.when(F.col("trend") > 0, "H").otherwise("L").alias("kind")
    ends = legs.filter("last").select("symbol", "theta", "trend")
    head = base.withColumn("theta", grid).join(ends, ["symbol", "theta"], "left").select(
        "symbol", "theta", "ref.pos", F.col("ref.close").alias("price"), F.when(F.col("trend") < 0, "H").otherwise("L").alias("kind"))
    pivots = legs.select("symbol", "theta", "pos", "price", kind).unionByName(head)
    pivots = pivots.join(bars.select("symbol", "pos", "ts"), ["symbol", "pos"]).withColumn("_b", chain.block_of("pos", size))
    return spread.positions(pivots, ["symbol", "theta"], "_b", "pos", name="n").select("symbol", "theta", "n", "pos", "ts", "price", "kind")


def zigzag_atr(daily, thr="thr"):
    """Zigzag with a threshold per bar; NULL holds the trend; neighbouring pivots of one kind merge into the more extreme.
    Works on daily bars (a bounded number per symbol)."""
    import pandas as pd

    def run(key, pdf):
        pdf = pdf.sort_values("d")
        rows = list(zip(pdf["d"].tolist(), pdf["close"].tolist(), pdf[thr].tolist()))
        piv, trend, ext = [], 1, rows[0]
        for cur in rows[1:]:
            if (cur[1] - ext[1]) * trend > 0:
                ext = cur
            elif cur[2] == cur[2] and cur[2] is not None and trend * (ext[1] - cur[1]) / ext[1] >= cur[2]:
                piv.append((ext, "H" if trend == 1 else "L"))
                trend, ext = -trend, cur
        piv.append((ext, "H" if trend == 1 else "L"))
        out = []
        for e, k in piv:
            if out and out[-1][1] == k:
                if (e[1] - out[-1][0][1]) * (1 if k == "H" else -1) > 0:
                    out[-1] = (e, k)
                continue
            out.append((e, k))
        return pd.DataFrame([(key[0], n, e[0], e[1], k) for n, (e, k) in enumerate(out)], columns=["symbol", "n", "d", "price", "kind"])

    return daily.select("symbol", "d", "close", thr).groupBy("symbol").applyInPandas(run, "symbol string, n bigint, d bigint, price double, kind string")


def hlh(pivots, xs, ys, part, pos="pos", ts=None):
    """High-low-high triples with drop >= x and rebound >= y, for every (x, y)."""
    w = W.partitionBy(*part).orderBy("n")
    take = ["kind", "price", pos] + ([ts] if ts else [])
    p = pivots
    for k, name in ((0, "peak"), (1, "trough"), (2, "rebound")):
        p = p.withColumn(name, F.lead(F.struct(*take), k).over(w) if k else F.struct(*take))
    p = p.filter("peak.kind = 'H' AND trough.kind = 'L' AND rebound.kind = 'H'")
    p = p.withColumn("drop_pct", (F.col("peak.price") - F.col("trough.price")) / F.col("peak.price")).withColumn(
        "rebound_pct", (F.col("rebound.price") - F.col("trough.price")) / F.col("trough.price"))
    p = p.withColumn("X", F.explode(F.array(*[F.lit(float(x)) for x in xs]))).withColumn("Y", F.explode(F.array(*[F.lit(float(y)) for y in ys])))
    p = p.filter("drop_pct >= X AND rebound_pct >= Y")
    cols = [F.col(f"{a}.{pos}").alias(f"{a}_pos") for a in ("peak", "trough", "rebound")]
    if ts:
        cols += [F.col(f"{a}.{ts}").alias(f"{a}_t") for a in ("peak", "trough", "rebound")]
    cols += [F.col(f"{a}.price").alias(f"{a}_p") for a in ("peak", "trough", "rebound")]
    return p.select(*part, "X", "Y", *cols, "drop_pct", "rebound_pct", (F.col(f"rebound.{pos}") - F.col(f"trough.{pos}")).alias("bars_to_rebound"))


# ------------------------------------------------------------------ pits and tops

# fixed values: detection and labelling constants of pits (sign +1) and tops (sign -1)
TURN = {"lookback": 60, "half": 5, "gap": 20, "band": 0.10, "wave": 60, "wave_band": 0.05, "fwd": 60}


def _lows(found, sign, c):
    """One (d, close) per cluster of a chain's candidates: the deepest, the earlier of equals. A candidate belongs to the cluster before it if it
    comes soon after the last one and the price between has not left the cluster's depth by more than the band."""
    point = lambda x: F.struct(x["d"].alias("d"), x["close"].alias("close"))
    none = F.transform(F.slice(found, 1, 0), point)

    def step(acc, x):
        deepest = F.element_at(acc["lows"], -1)
        near = (x["d"] - acc["d"] <= c["gap"]) & (sign * x["between"] < sign * (deepest["close"] * (1 + sign * c["band"])))
        better = F.when(sign * x["close"] < sign * deepest["close"], point(x)).otherwise(deepest)
        lows = F.when(near, F.concat(F.slice(acc["lows"], 1, F.size(acc["lows"]) - 1), F.array(better))).otherwise(F.concat(acc["lows"], F.array(point(x))))
        return F.struct(x["d"].alias("d"), lows.alias("lows"))

    first = F.struct(F.get(found, F.lit(0))["d"].alias("d"), F.concat(none, F.array(point(F.get(found, F.lit(0))))).alias("lows"))
    return F.aggregate(F.slice(found, F.lit(2), F.size(found)), first, step, lambda acc: acc["lows"])


def _waves(lows, sign, c):
    """Of clusters within a wave of the one kept last, one much shallower goes, one much deeper stays beside it, and of two alike the deeper stays."""

    def step(kept, x):
        last = F.element_at(kept, -1)
        rise = sign * (x["close"] / last["close"] - 1)
        apart = (x["d"] - last["d"] > c["wave"]) | (rise < -c["wave_band"])
        swap = (rise <= c["wave_band"]) & (sign * x["close"] < sign * last["close"])
        return F.when(F.size(kept) == 0, F.array(x)).when(apart, F.concat(kept, F.array(x))).when(
            swap, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

    return F.aggregate(lows, F.slice(lows, 1, 0), step)


def turning_points(daily, sign, depth, turn=None):
    """Pits (sign=1) or tops (sign=-1): candidates by windows, then clusters and waves over the few candidates.

    'Deeper' means that sign * close is lower.
    """
    c = {**TURN, **(turn or {})}
    w = W.partitionBy("symbol").orderBy("d")
    prior = w.rowsBetween(-c["lookback"], -1)
    full = F.count("close").over(prior) >= c["lookback"]
    cen = w.rowsBetween(-c["half"], c["half"])
    if sign > 0:
        far = F.col("close") / F.max("close").over(prior) - 1 <= -depth
        local = F.col("close") == F.min("close").over(cen)
    else:
        far = F.col("close") / F.min("close").over(prior) - 1 >= depth
        local = F.col("close") == F.max("close").over(cen)
    b = daily.withColumn("cand", full & far & local)
    # the opposite extreme between one candidate and the next, both included
    seg = F.coalesce(F.sum(F.col("cand").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    b = b.withColumn("_seg", seg)
    ext = (F.max if sign > 0 else F.min)("close").over(W.partitionBy("symbol", "_seg"))
    k = b.withColumn("_ext", ext).filter("cand")
    k = k.withColumn("_prev", F.lag("close").over(w)).withColumn("between", (F.greatest if sign > 0 else F.least)("_ext", F.coalesce("_prev", "_ext")))

    # candidates further apart than a wave can't bear on each other: each such chain is folded by itself
    new = F.coalesce(F.col("d") - F.lag("d").over(w) > max(c["wave"], c["gap"]), F.lit(True))
    k = k.withColumn("_chain", F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    chains = k.groupBy("symbol", "_chain").agg(F.array_sort(F.collect_list(F.struct("d", "close", "between"))).alias("c"))
    pts = chains.select("symbol", F.explode(_waves(_lows("c", sign, c), sign, c)).alias("p")).select("symbol", "p.d")
    wf = w.rowsBetween(1, c["fwd"])
    rich = daily.withColumn("ahead", F.collect_list("close").over(wf)).withColumn("ref_close", (F.max if sign > 0 else F.min)("close").over(prior)).withColumn(
        "ref_d", F.max_by("d", F.struct(F.col("close") * sign, -F.col("d"))).over(prior))
    return rich.join(pts, ["symbol", "d"], "left_semi")


def _first_index(arr, pred):
    return F.get(F.filter(F.transform(arr, lambda x, i: F.when(pred(x), i + 1)), lambda i: i.isNotNull()), F.lit(0))


def pit_labels(pits, rebound=0.25, new_low=0.10, weak=0.10, fwd=60):
    """true: the rebound comes first; false: a new low first, or a weak 60 days; truncated: not enough days; else mid."""
    c = F.col("close")
    p = pits.withColumn("t_reb", _first_index("ahead", lambda x: x >= c * (1 + rebound))).withColumn("t_low", _first_index("ahead", lambda x: x <= c * (1 - new_low)))
    low_first = F.col("t_low").isNotNull() & (F.col("t_reb").isNull() | (F.col("t_low") < F.col("t_reb")))
    label = F.when(low_first, "false").when(F.col("t_reb").isNotNull(), "true").when(F.size("ahead") < fwd, "truncated").when(
        F.array_max("ahead") / c - 1 < weak, "false").otherwise("mid")
    return p.withColumn("label", label).withColumn("n_fwd", F.size("ahead")).drop("ahead")


def top_labels(tops, fall=0.20, new_high=0.10, fwd=60):
    """true: the fall comes first and no close above the top before it; false: a new high first; truncated; else mid."""
    c = F.col("close")
    p = tops.withColumn("t_fall", _first_index("ahead", lambda x: x <= c * (1 - fall))).withColumn("t_high", _first_index("ahead", lambda x: x >= c * (1 + new_high)))
    high_first = F.col("t_high").isNotNull() & (F.col("t_fall").isNull() | (F.col("t_high") < F.col("t_fall")))
    before = F.array_max(F.slice("ahead", F.lit(1), F.col("t_fall") - 1))
    label = F.when(high_first, "false").when(F.col("t_fall").isNotNull(), F.when(F.coalesce(before, c) <= c, "true").otherwise("mid")).when(
        F.size("ahead") < fwd, "truncated").otherwise("mid")
    return p.withColumn("label", label).withColumn("n_fwd", F.size("ahead")).drop("ahead")


def layered_fills(events, levels=((0.0, 1), (0.05, 2), (0.10, 2)), tp=0.02, bar_min=5, slice_cap=2000.0):
    """Five slices per swing leg at 0 / -5 / -10 %; fill time interpolated on the way down; target or mark at the rebound."""
    from ..functions import times as tm

    drop = (F.col("peak_p") - F.col("trough_p")) / F.col("peak_p")
    rows, sid = [], 0
    for lvl, n in levels:
        for _ in range(n):
            sid += 1
            rows.append(F.struct(F.lit(sid).alias("slice_id"), F.lit(float(lvl)).alias("lvl")))
    e = events.withColumn("drop_pct", drop).withColumn("_s", F.explode(F.array(*rows))).filter(F.col("drop_pct") >= F.col("_s.lvl"))
    lvl = F.col("_s.lvl")
    p_entry = F.col("peak_p") * (1 - lvl)
    share = F.when(lvl == 0, 0.0).otherwise(lvl / F.col("drop_pct"))
    us = tm.micros("peak_t") + F.floor((tm.micros("trough_t") - tm.micros("peak_t")) * share)
    hit = F.col("rebound_p") >= p_entry * (1 + tp)
    pnl = F.when(hit, slice_cap * tp).otherwise(slice_cap * (F.col("rebound_p") / p_entry - 1))
    hold = F.ceil((tm.micros("rebound_t") - us) / (60_000_000 * bar_min))
    return e.withColumn("slice_id", F.col("_s.slice_id")).withColumn("p_entry", p_entry).withColumn("hit_tp", hit).withColumn("pnl", pnl).withColumn("hold_bars", hold).drop("_s")


def first_passage(daily, center, band, up, down, horizon=60, min_n=30):
    """From starts whose 252-high drawdown is near ``center``: share that first reaches up, down, or neither."""
    w = W.partitionBy("symbol").orderBy("d")
    dd = (F.col("close") / F.max("close").over(w.rowsBetween(-251, 0)) - 1) * 100
    d = daily.withColumn("dd", dd).withColumn("ahead", F.collect_list("close").over(w.rowsBetween(1, horizon)))
    near = (F.col("dd") >= -band) if center >= -band else (F.abs(F.col("dd") - center) <= band)
    d = d.filter(near & (F.size("ahead") == horizon))
    hi, lo = F.col("close") * (1 + up / 100), F.col("close") * (1 + down / 100)
    first = F.get(F.filter("ahead", lambda x: (x <= lo) | (x >= hi)), F.lit(0))
    d = d.withColumn("hit", F.when(first.isNull(), "none").when(first <= lo, "dn").otherwise("up"))
    share = lambda k: (F.sum((F.col("hit") == k).cast("int")) / F.count(F.lit(1)) * 100).alias(k)
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), share("up"), share("dn"), share("none")).filter(F.col("n") >= min_n)
