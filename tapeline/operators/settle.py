"""Settlement of entries against the bars that follow.

An entry row carries its own path: the next T bars as an array, filled by a bounded forward frame inside a block
(``spread.in_blocks``). Every (tp, sl) setting is then a row-local expression, so parameter grids cost no shuffle.
"""

from pyspark.sql import functions as F

from ..functions import finance as fin
from ..functions import times as tm
from ..session import cut
from . import chain, spread

BAR = ["pos", "ts", "et_date", "open", "high", "low", "close"]


def forward_paths(bars, horizon, is_entry, same_day=True, key="symbol", cols=BAR):
    """Entry rows with ``path``: their own bar and up to horizon-1 bars after it, cut at the end of the ET day."""
    def collect(r, w):
        return r.withColumn("path", F.collect_list(F.struct(*cols)).over(w.rowsBetween(0, horizon - 1))).filter(is_entry)

    out = spread.in_blocks(bars, key, 0, horizon - 1, collect)
    if same_day:
        out = out.withColumn("raw_len", F.size("path")).withColumn("path", F.filter("path", lambda b: b["et_date"] == F.col("et_date")))
    return out


def bracket(paths, tp, sl, slip=fin.SLIP, fee=fin.FEE, entry=None, path="path"):
    """First take-profit / stop / close per entry, pessimistic.

    Precedence inside a bar: open at or beyond the target fills at the open; else the stop (a gap fills at the open,
    with slippage); else a strict cross of the target. ``tp`` / ``sl`` are columns or numbers; NULL tp = none.
    """
    d = F.col("direction")
    tp = tp if not isinstance(tp, (int, float)) else F.lit(float(tp))
    sl = sl if not isinstance(sl, (int, float)) else F.lit(float(sl))
    raw = entry if entry is not None else F.col(path)[0]["open"]
    p = paths.withColumn("entry_px", fin.entry_fill(raw, d, slip))
    p = p.withColumn("_tp", F.col("entry_px") * (1 + tp * d)).withColumn("_sl", F.col("entry_px") * (1 - sl * d))

    good = lambda b: F.when(d == 1, b["high"]).otherwise(b["low"])
    bad = lambda b: F.when(d == 1, b["low"]).otherwise(b["high"])
    tp_px, sl_px = F.col("_tp"), F.col("_sl")
    gap_tp = lambda b: F.coalesce(d * b["open"] >= d * tp_px, F.lit(False))
    stop = lambda b: (d * b["open"] <= d * sl_px) | (d * bad(b) <= d * sl_px)
    cross = lambda b: F.coalesce(d * good(b) > d * tp_px, F.lit(False))
    p = p.withColumn("_b", F.get(F.filter(path, lambda b: gap_tp(b) | stop(b) | cross(b)), F.lit(0)))
    p = p.withColumn("_last", F.element_at(path, -1))
    b, last = F.col("_b"), F.col("_last")
    hit = F.when(b.isNull(), "close").when(gap_tp(b), "tp").when(stop(b), "sl").otherwise("tp")
    fill_tp = d * F.greatest(d * b["open"], d * tp_px)
    fill_sl = d * F.least(d * b["open"], d * sl_px) * (1 - slip * d)
    px = F.when(F.col("hit") == "close", last["close"]).when(F.col("hit") == "tp", fill_tp).otherwise(fill_sl)
    p = p.withColumn("hit", hit).withColumn("exit_px", px).withColumn("exit_pos", F.coalesce(b["pos"], last["pos"])).withColumn("exit_ts", F.coalesce(b["ts"], last["ts"]))
    return p.withColumn("ret", fin.net_return(F.col("entry_px"), F.col("exit_px"), d, fee)).drop("_tp", "_sl", "_b", "_last")


def trailing(paths, trail, slip=fin.SLIP, fee=fin.FEE):
    """Trailing stop: the stop at each bar comes from the best price through the bar before it."""
    d = F.col("direction")
    trail = trail if not isinstance(trail, (int, float)) else F.lit(float(trail))
    p = paths.withColumn("entry_px", fin.entry_fill(F.col("path")[0]["open"], d, slip))
    best = F.transform("path", lambda b, i: F.greatest(d * F.col("entry_px"), F.array_max(F.transform(F.slice("path", F.lit(1), i), lambda q: F.when(d == 1, q["high"]).otherwise(-q["low"])))))
    p = p.withColumn("_best", best)
    # in signed prices the stop is best * (1 - trail) for longs and best * (1 + trail) for shorts
    stops = F.transform("_best", lambda x: x * (1 - d * trail))
    p = p.withColumn("_z", F.arrays_zip(F.col("path").alias("b"), stops.alias("s")))
    open_hit = lambda z: d * z["b"]["open"] <= z["s"]
    bar_hit = lambda z: F.when(d == 1, z["b"]["low"]).otherwise(-z["b"]["high"]) <= z["s"]
    p = p.withColumn("_h", F.get(F.filter("_z", lambda z: open_hit(z) | bar_hit(z)), F.lit(0))).withColumn("_last", F.element_at("path", -1))
    h = F.col("_h")
    px = F.when(h.isNull(), F.col("_last.close")).when(open_hit(h), h["b"]["open"] * (1 - slip * d)).otherwise(d * h["s"] * (1 - slip * d))
    p = p.withColumn("hit", F.when(h.isNull(), "close").otherwise("sl")).withColumn("exit_px", px)
    p = p.withColumn("exit_pos", F.coalesce(h["b"]["pos"], F.col("_last.pos"))).withColumn("exit_ts", F.coalesce(h["b"]["ts"], F.col("_last.ts")))
    return p.withColumn("ret", fin.net_return(F.col("entry_px"), F.col("exit_px"), d, fee)).drop("_best", "_z", "_h", "_last")


def triple_barrier(paths, tp, sl, horizon):
    """Label of a long entry: 1 when the target is touched first, 0 otherwise; both in one bar or a day end give 0.
    NULL (dropped by callers) when the data, not the day, ended before the horizon without a touch."""
    e = F.col("path")[0]["open"]
    up, dn = e * (1 + tp), e * (1 - sl)
    first = F.get(F.filter("path", lambda b: (b["high"] >= up) | (b["low"] <= dn)), F.lit(0))
    p = paths.withColumn("_f", first)
    cut = (F.col("raw_len") < horizon) & (F.size("path") == F.col("raw_len"))
    label = (
        F.when(F.col("_f").isNotNull(), F.when((F.col("_f.high") >= up) & ~(F.col("_f.low") <= dn), 1).otherwise(0))
        .when(cut, F.lit(None).cast("int")).otherwise(0)
    )
    return p.withColumn("label", label).drop("_f")


def non_overlap(trades, key, start, end, block, seed=None, size=chain.SIZE):
    """Keep a trade only if it starts after the last kept one ended (one position at a time).

    Which trade follows a trade is the first one that starts after its end, so a block of trades maps "busy until" coming in to "busy until" going
    out; blocks of ``size`` trades are composed (``chain``), however long trades overlap without a break. ``block`` is a column that rises with
    ``start`` (for positions). Equal starts go by end, then by the whole row. ``seed``: the end of a position already open (a number or column).
    """
    key = [key] if isinstance(key, str) else list(key)
    row = F.struct(*trades.columns)
    t = trades if seed is None else trades.filter(F.col(start) > seed)
    t = t.withColumn("_start", _number(trades, start)).withColumn("_end", _number(trades, end))
    t = cut(spread.positions(t, key, block, ["_start", "_end", row], name="_order"), "trades")
    kept = chain.one_at_a_time(t, key, "_start", "_end", "_order", size=size)
    return t.join(kept, key + ["_order"], "left_semi").select(*trades.columns)


def _number(df, col):
    """A position or time as a number that orders the same."""
    kind = df.schema[col].dataType.typeName()
    return tm.micros(col) if kind.startswith("timestamp") else F.unix_date(col) if kind == "date" else F.col(col)


def momentum_entries(bars, trigger, std_k=None, std_n=20):
    """Bars whose previous bar's intraday return reaches a fixed trigger or k standard deviations; direction by sign."""
    from pyspark.sql import Window as W

    from ..functions.numeric import guarded
    from .bars import intraday_return

    w = W.partitionBy("symbol", "et_date").orderBy("ts")
    b = intraday_return(bars).withColumn("sig", F.lag("iret").over(w))
    thr = F.lit(float(trigger)) if std_k is None else F.col("_thr")
    if std_k is not None:
        b = spread.in_blocks(b, "symbol", std_n + 1, 0, lambda r, ww: r.withColumn(
            "_v", guarded(F.stddev_samp, F.col("iret"), ww.rowsBetween(-(std_n - 1), 0), max(2, std_n // 2))).withColumn("_thr", F.lag("_v").over(ww) * std_k).drop("_v"))
    on = F.col("sig").isNotNull() & thr.isNotNull() & (F.abs("sig") >= thr)
    return b.withColumn("direction", F.when(on, F.when(F.col("sig") > 0, 1).otherwise(-1)))


def mark_to_market(trades, daily, direction=1):
    """Daily equity of one-position trades: marks inside a trade, realised at its exit, flat in between.

    Trades carry (symbol, entry_d, exit_d, entry_px, ret); each is spread over its holding days and equi-joined.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("symbol").orderBy("entry_d")
    t = trades.withColumn("_lg", F.log1p("ret")).withColumn("_after", F.exp(F.sum("_lg").over(w))).withColumn("_before", F.col("_after") / (1 + F.col("ret")))
    held = t.withColumn("d", F.explode(F.sequence("entry_d", "exit_d"))).select("symbol", "d", "exit_d", "entry_px", "_after", "_before")
    j = daily.join(held, ["symbol", "d"], "left")
    mark = F.when(F.col("d") == F.col("exit_d"), F.col("_after")).when(
        F.col("exit_d").isNotNull(), F.col("_before") * (1 + direction * (F.col("close") / F.col("entry_px") - 1)))
    ff = W.partitionBy("symbol").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    return j.withColumn("_m", mark).withColumn("equity", F.coalesce(F.last("_m", True).over(ff), F.lit(1.0))).drop("_m", "_after", "_before", "exit_d", "entry_px")


def portfolio_path(trades, bars, capital):
    """Portfolio mark-to-market by differences: cash and position deltas at entry, marks and exit, then running sums.

    Trades carry (symbol, entry_pos, exit_pos, entry_px, alloc, ret). Output: one row per time with equity and count.
    """
    t = trades.withColumn("pos", F.explode(F.sequence("entry_pos", "exit_pos")))
    j = t.join(bars.select("symbol", "pos", "ts", "close"), ["symbol", "pos"])
    is_in, is_out = F.col("pos") == F.col("entry_pos"), F.col("pos") == F.col("exit_pos")
    value = F.when(~is_out, F.col("alloc") * F.col("close") / F.col("entry_px")).otherwise(0.0)
    from pyspark.sql import Window as W

    w = W.partitionBy("symbol", "entry_pos").orderBy("pos")
    j = j.withColumn("_v", value).withColumn("_dp", F.col("_v") - F.coalesce(F.lag("_v").over(w), F.lit(0.0)))
    cash = F.when(is_in, -F.col("alloc")).otherwise(0.0) + F.when(is_out, F.col("alloc") * (1 + F.col("ret"))).otherwise(0.0)
    cnt = is_in.cast("int") - is_out.cast("int")
    d = j.groupBy("ts").agg(F.sum(cash + F.col("_dp")).alias("delta"), F.sum(cnt).alias("dc"))
    d = d.withColumn("_all", F.lit(0)).withColumn("_day", F.to_date("ts"))
    out = spread.running(d, "_all", "_day", "ts", _eq=("sum", "delta"), n_open=("sum", "dc"))
    return out.select("ts", (F.col("_eq") + capital).alias("equity"), "n_open")
