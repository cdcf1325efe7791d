"""Window-function queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times as tm
from ..operators import bars as B
from ..operators import rolling as R
from ..operators import spread
from ..sources.tables import table
from . import views as v
from .projections import IRET
from .registry import query

PW = "PARTITION BY symbol ORDER BY et_date"
BW = "PARTITION BY symbol ORDER BY ts"


def bars15(spark, sf):
    return v.with_pos(v.bars_15m(spark, sf))


@query("win_01_realised_vol", f"SELECT symbol, ts, CASE WHEN count(iret) OVER w >= 10 THEN stddev_samp(iret) OVER w END AS rv20 FROM (SELECT *, {IRET} AS iret FROM {{{{bars_15m}}}}) WINDOW w AS ({BW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", dbl="rv20", dp=7)
def win_01(spark, sf):
    return R.realised_vol(bars15(spark, sf)).select("symbol", "ts", "rv20")


@query("win_02_volume_ratio", f"SELECT symbol, ts, CASE WHEN count(volume) OVER w >= 10 THEN volume / avg(volume) OVER w END AS vol_ratio FROM {{{{bars_15m}}}} WINDOW w AS ({BW} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", dbl="vol_ratio")
def win_02(spark, sf):
    return R.volume_ratio(bars15(spark, sf)).select("symbol", "ts", "vol_ratio")


@query("win_03_day_position", "SELECT symbol, ts, row_number() OVER w - 1 AS bars_since_open, first_value(open) OVER w AS day_open FROM {{bars_15m}} WINDOW w AS (PARTITION BY symbol, et_date ORDER BY ts)")
def win_03(spark, sf):
    return B.day_position(v.bars_15m(spark, sf)).select("symbol", "ts", "bars_since_open", "day_open")


@query("win_04_prev_day_return", f"SELECT b.symbol, b.ts, prev_day_ret FROM {{{{bars_1h}}}} b LEFT JOIN (SELECT symbol, et_date, lag(close, 1) OVER ({PW}) / lag(close, 2) OVER ({PW}) - 1 AS prev_day_ret FROM {{{{bars_day}}}}) USING (symbol, et_date)", dbl="prev_day_ret")
def win_04(spark, sf):
    return R.prev_day_return(v.bars_1h(spark, sf), v.bars_day(spark, sf)).select("symbol", "ts", "prev_day_ret")


@query("win_05_local_extrema", f"SELECT symbol, ts, count(*) OVER w = 7 AND close >= max(close) OVER w AS is_peak, count(*) OVER w = 7 AND close <= min(close) OVER w AS is_trough FROM {{{{bars_15m}}}} WINDOW w AS ({BW} ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)")
def win_05(spark, sf):
    return R.local_extrema(bars15(spark, sf), 4, 2).select("symbol", "ts", "is_peak", "is_trough")


@query("win_06_atr_threshold", f"""SELECT symbol, ts, 1.2 * lag(a) OVER ({BW}) AS atr_thr FROM (SELECT symbol, ts, CASE WHEN count(tr) OVER w >= 14 THEN avg(tr) OVER w END / close AS a FROM
    (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({BW})), abs(low - lag(close) OVER ({BW}))) AS tr FROM {{{{bars_15m}}}}) WINDOW w AS ({BW} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))""", dbl="atr_thr", dp=7)
def win_06(spark, sf):
    return R.atr_threshold(bars15(spark, sf)).select("symbol", "ts", "atr_thr")


def _sig_sql():
    out = []
    for n in (10, 20, 55):
        f = f"({PW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        out.append(("donchian", n, 1, f"count(*) OVER {f} >= {n} AND close > max(high) OVER {f}"))
        out.append(("donchian", n, -1, f"count(*) OVER {f} >= {n} AND close < min(low) OVER {f}"))
    for n in (20, 50):
        f = f"({PW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        out.append(("ma_pull", n, 1, f"count(*) OVER {f} >= {n} AND close / avg(close) OVER {f} - 1 > 0 AND close / avg(close) OVER {f} - 1 < 0.1"))
        out.append(("ma_pull", n, -1, f"count(*) OVER {f} >= {n} AND close / avg(close) OVER {f} - 1 < 0 AND close / avg(close) OVER {f} - 1 > -0.1"))
    for k in (3, 4, 5):
        up = " AND ".join(f"lag(close, {i}) OVER ({PW}) > lag(close, {i + 1}) OVER ({PW})" for i in range(k))
        out.append(("streak", k, 1, up.replace(">", "<")))
        out.append(("streak", k, -1, up))
    for t in (0.3, 0.5):
        out.append(("big_move", t, 1, f"close / lag(close) OVER ({PW}) - 1 < -{t}"))
        out.append(("big_move", t, -1, f"close / lag(close) OVER ({PW}) - 1 > {t}"))
    return " UNION ALL ".join(f"SELECT symbol, et_date, '{fam}' AS family, {p}::DOUBLE AS param, {d} AS direction FROM (SELECT *, {c} AS ok FROM {{{{panel_day}}}}) WHERE ok" for fam, p, d, c in out)


@query("win_07_daily_signals", _sig_sql(), dbl="param")
def win_07(spark, sf):
    return R.daily_signals(v.panel_day(spark, sf), band=0.1, moves=(0.3, 0.5)).select("symbol", "et_date", "family", "param", "direction")


def switches_sql(src="panel_day", a=200, b=50, h=252, dd=-0.2):
    f = lambda n: f"({PW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""SELECT symbol, et_date, d, open, close, volume, coalesce(lag(x1) OVER ({PW}), false) AS s1_off, coalesce(lag(x2) OVER ({PW}), false) AS s2_off, coalesce(lag(x3) OVER ({PW}), false) AS s3_off,
    coalesce(lag(x1 OR x2) OVER ({PW}), false) AS s4_off FROM (SELECT symbol, et_date, d, open, close, volume,
    count(*) OVER {f(a)} >= {a} AND close < avg(close) OVER {f(a)} AS x1, count(*) OVER {f(h)} >= {h} AND close / max(close) OVER {f(h)} - 1 < {dd} AS x2,
    count(*) OVER {f(a)} >= {a} AND avg(close) OVER {f(b)} < avg(close) OVER {f(a)} AS x3 FROM {{{{{src}}}}})"""


SW = switches_sql(dd=-0.8)


@query("win_08_bear_switches", f"SELECT symbol, et_date, s1_off, s2_off, s3_off, s4_off FROM ({SW})")
def win_08(spark, sf):
    return R.bear_switches(v.panel_day(spark, sf), dd=-0.8).select("symbol", "et_date", "s1_off", "s2_off", "s3_off", "s4_off")


@query("win_08_off_days", f"SELECT symbol, count(*) AS n_days, count(*) FILTER (WHERE s2_off) AS off_days FROM ({switches_sql('bars_day', 5, 3, 5, -0.5)}) GROUP BY symbol")
def win_08b(spark, sf):
    """Events to hourly bars to daily bars to the drawdown switch to off days per symbol."""
    s = R.bear_switches(v.bars_day(spark, sf), long=5, short=3, high=5, dd=-0.5)
    return s.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_days"), F.sum(F.col("s2_off").cast("int")).cast("bigint").alias("off_days"))


TRADES = "SELECT symbol, ts, et_date, (close - open) / open * 0.0005 AS ret FROM {{bars_1h}}"
EQ = f"SELECT *, exp(sum(ln(1 + ret)) OVER ({BW})) AS equity FROM ({TRADES})"


def bar_trades(spark, sf):
    return v.bars_1h(spark, sf).select("symbol", "ts", "et_date", ((F.col("close") - F.col("open")) / F.col("open") * 0.0005).alias("ret"))


def bar_equity(spark, sf):
    return R.equity(bar_trades(spark, sf), "symbol", "et_date", "ts")


@query("win_09_drawdown", f"SELECT symbol, ts, equity / max(equity) OVER ({BW}) - 1 AS drawdown FROM ({EQ})", dbl="drawdown")
def win_09(spark, sf):
    return R.drawdown(bar_equity(spark, sf), "symbol", "et_date", "ts").select("symbol", "ts", "drawdown")


@query("win_10_equity", f"SELECT symbol, ts, equity FROM ({EQ})", dbl="equity", dp=7)
def win_10(spark, sf):
    return bar_equity(spark, sf).select("symbol", "ts", "equity")


@query("win_11_forward_return", f"SELECT symbol, et_date, lead(close, 19) OVER ({PW}) / open - 1 AS fwd_ret FROM {{{{panel_day}}}}", dbl="fwd_ret")
def win_11(spark, sf):
    return R.forward_return(v.panel_day(spark, sf), 20).select("symbol", "et_date", "fwd_ret")


SPINE = """SELECT symbol, et_date, coalesce(n, 0) AS n FROM (SELECT symbol, CAST(unnest(generate_series(min(et_date), max(et_date), INTERVAL 1 DAY)) AS DATE) AS et_date FROM {{panel_day}} GROUP BY symbol)
    LEFT JOIN (SELECT symbol, et_date, CAST(volume AS BIGINT) AS n FROM {{panel_day}}) USING (symbol, et_date)"""
DENSE = f"SELECT *, coalesce(n > thr, false) AS dense FROM (SELECT *, CASE WHEN count(n) OVER w >= 180 THEN quantile_cont(n, 0.9) OVER w END AS thr FROM ({SPINE}) WINDOW w AS ({PW} ROWS BETWEEN 365 PRECEDING AND 1 PRECEDING))"


def daily_counts(spark, sf):
    return R.spine(v.panel_day(spark, sf).select("symbol", "et_date", F.col("volume").cast("bigint").alias("n")))


@query("win_12_density_threshold", f"SELECT symbol, et_date, n, thr, dense FROM ({DENSE})", dbl="thr")
def win_12(spark, sf):
    return R.density_threshold(daily_counts(spark, sf))


OFF_RUNS = f"""SELECT symbol, min(d) AS start, max(d) AS "end", count(*) AS length FROM (SELECT *, d - row_number() OVER ({PW}) AS g FROM ({SW}) WHERE s2_off) GROUP BY symbol, g"""


def off_runs(spark, sf):
    s = R.bear_switches(v.panel_day(spark, sf), dd=-0.8)
    return R.runs(s.withColumn("_y", F.year("et_date")), "symbol", "_y", "d", F.col("s2_off"))


@query("win_13_episodes", OFF_RUNS)
def win_13(spark, sf):
    return off_runs(spark, sf).select("symbol", "start", "end", "length")


@query("win_14_longest_underwater", f"""SELECT symbol, max(length) AS longest FROM (SELECT symbol, g, count(*) AS length FROM (SELECT *, d - row_number() OVER ({PW}) AS g FROM
    (SELECT symbol, et_date, d, close < max(close) OVER ({PW}) AS under FROM {{{{panel_day}}}}) WHERE under) GROUP BY 1, 2) GROUP BY symbol""")
def win_14(spark, sf):
    p = v.panel_day(spark, sf).withColumn("_y", F.year("et_date"))
    p = R.drawdown(p, "symbol", "_y", "d", "close")
    return R.runs(p, "symbol", "_y", "d", F.col("drawdown") < 0).groupBy("symbol").agg(F.max("length").alias("longest"))


@query("win_15_loss_streak", f"""SELECT symbol, max(length) AS streak FROM (SELECT symbol, g, count(*) AS length FROM (SELECT *, pos - row_number() OVER ({BW}) AS g FROM
    (SELECT symbol, ts, pos, close < open AS loss FROM {{{{bars_1h}}}}) WHERE loss) GROUP BY 1, 2) GROUP BY symbol""")
def win_15(spark, sf):
    return R.runs(bar_trades(spark, sf), "symbol", "et_date", "ts", F.col("ret") < 0).groupBy("symbol").agg(F.max("length").alias("streak"))


def _obv_sql(z):
    return f"""WITH a AS (SELECT *, close / lag(close) OVER ({PW}) - 1 AS ret1 FROM {{{{panel_day}}}}),
    b AS (SELECT *, sum(sign(coalesce(ret1, 0)) * volume) OVER ({PW}) AS obv, abs(close / lag(close, 5) OVER ({PW}) - 1) AS ret5, abs(ret1) AS aret FROM a),
    c AS (SELECT *, obv - lag(obv, 5) OVER ({PW}) AS obv5 FROM b),
    e AS (SELECT *, list(obv) OVER w20 AS l20, count(*) OVER w20 AS n20, min(close) OVER w20 AS m20, avg(volume) OVER p60 AS vm, stddev_samp(volume) OVER p60 AS vs, count(volume) OVER p60 AS vn,
      avg(obv5) OVER p60 AS om, stddev_samp(obv5) OVER p60 AS os, count(obv5) OVER p60 AS onn, avg(aret) OVER p20 AS am, count(aret) OVER p20 AS an, quantile_cont(ret5, 0.5) OVER p60 AS md, count(ret5) OVER p60 AS mn FROM c
      WINDOW w20 AS ({PW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p60 AS ({PW} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), p20 AS ({PW} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
    SELECT symbol, et_date, obv, coalesce(n20 >= 20 AND close <= m20 AND (len(list_filter(l20, lambda v: v < obv)) + (len(list_filter(l20, lambda v: v = obv)) + 1) / 2.0) / 20.0 >= 0.25, false) AS sig_div,
    coalesce(vn >= 60 AND vs <> 0 AND (volume - vm) / vs >= {z} AND an >= 20 AND aret <= 0.75 * am, false) AS sig_absorb, coalesce(onn >= 60 AND os <> 0 AND (obv5 - om) / os >= {z} AND mn >= 60 AND ret5 <= md, false) AS sig_inflow FROM e"""


@query("win_16_obv_signals", _obv_sql(1.0), dbl="obv")
def win_16(spark, sf):
    return R.obv_signals(v.panel_day(spark, sf), 1.0).select("symbol", "et_date", "obv", "sig_div", "sig_absorb", "sig_inflow")


@query("win_17_zscore_past", """SELECT symbol, week_start, CASE WHEN count(volume) OVER w >= 13 AND stddev_samp(volume) OVER w <> 0 THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w END AS z FROM
    (SELECT symbol, CAST(date_trunc('week', et_date) AS DATE) AS week_start, sum(volume) AS volume FROM {{panel_day}} GROUP BY 1, 2) WINDOW w AS (PARTITION BY symbol ORDER BY week_start ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)""", dbl="z", dp=7)
def win_17(spark, sf):
    from ..sources.readers import weekly_volume

    return R.zscore_past(weekly_volume(v.panel_day(spark, sf)), "volume", order="week_start").select("symbol", "week_start", "z")


RANKF = "(len(list_filter(l, lambda q: q < x)) + (len(list_filter(l, lambda q: q = x)) + 1) / 2.0) / len(l)"
VOLREG = f"""WITH a AS (SELECT *, close / lag(close) OVER ({PW}) - 1 AS r FROM {{{{panel_day}}}}),
    b AS (SELECT *, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w END AS x FROM a WINDOW w AS ({PW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    c AS (SELECT *, list_filter(list(x) OVER w, lambda q: q IS NOT NULL) AS l, CASE WHEN count(*) OVER w >= 252 THEN close / max(close) OVER w - 1 END AS dd FROM b WINDOW w AS ({PW} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
    SELECT symbol, et_date, lag(CASE WHEN len(l) >= 252 THEN {RANKF} END) OVER ({PW}) AS vol_pct, lag(dd) OVER ({PW}) AS dd252 FROM c"""


@query("win_18_vol_regime", VOLREG, dbl="vol_pct dd252", dp=7)
def win_18(spark, sf):
    return R.vol_regime(v.panel_day(spark, sf)).select("symbol", "et_date", "vol_pct", "dd252")


PITF = f"""WITH a AS (SELECT *, close / lag(close) OVER ({PW}) - 1 AS r, volume AS x FROM {{{{panel_day}}}}),
    b AS (SELECT *, list(volume) OVER w252 AS l FROM a WINDOW w252 AS ({PW} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))
    SELECT symbol, et_date, (close / max(close) OVER p60 - 1) * 100 AS dd_60, d - arg_max(d, close) OVER p60 AS days_from_peak, (close / lag(close, 30) OVER ({PW}) - 1) * 100 AS ret_30,
    CASE WHEN count(r) OVER w20 >= 20 THEN stddev_samp(r) OVER w20 * sqrt(252) * 100 END AS vol20_ann, CASE WHEN count(*) OVER w200 >= 120 THEN (close / avg(close) OVER w200 - 1) * 100 END AS dist_200,
    CASE WHEN len(l) >= 126 THEN {RANKF} * 100 END AS volume_pct, avg(volume) OVER w5 / nullif(avg(volume) OVER v60, 0) AS vol_5_60 FROM b
    WINDOW p60 AS ({PW} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), w20 AS ({PW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w200 AS ({PW} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW),
    w5 AS ({PW} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), v60 AS ({PW} ROWS BETWEEN 65 PRECEDING AND 6 PRECEDING)"""


@query("win_19_pit_features", PITF, dbl="dd_60 ret_30 vol20_ann dist_200 volume_pct vol_5_60", dp=6)
def win_19(spark, sf):
    return R.pit_features(v.panel_day(spark, sf)).select("symbol", "et_date", "dd_60", "days_from_peak", "ret_30", "vol20_ann", "dist_200", "volume_pct", "vol_5_60")


def _rsi_sql(adjust):
    # adjust=True: normalising weights cancel in the ratio. adjust=False: the first delta keeps full weight.
    wt = "pow(13.0 / 14, b.d - a.d)" if adjust else "CASE WHEN a.d = 1 THEN pow(13.0 / 14, b.d - 1) ELSE pow(13.0 / 14, b.d - a.d) / 14 END"
    val = "CASE WHEN b.d >= 14 AND sum(dn) > 0 THEN 100 - 100 / (1 + sum(up) / sum(dn)) " + ("WHEN b.d >= 14 AND sum(up) > 0 THEN 100 END" if adjust else "ELSE 100 END")
    return f"""WITH x AS (SELECT symbol, et_date, d, close - lag(close) OVER ({PW}) AS dl FROM {{{{panel_day}}}})
    SELECT symbol, et_date, {val} AS rsi FROM (SELECT b.symbol, b.et_date, b.d, greatest(a.dl, 0) * {wt} AS up, greatest(-a.dl, 0) * {wt} AS dn FROM x b LEFT JOIN x a ON a.symbol = b.symbol AND a.d <= b.d AND a.d >= 1 AND b.d - a.d < 600) b
    GROUP BY symbol, et_date, d"""


@query("win_20_rsi", _rsi_sql(True), dbl="rsi", dp=6)
def win_20(spark, sf):
    return R.rsi(v.panel_day(spark, sf))


@query("win_20_rsi_wilder", _rsi_sql(False), dbl="rsi", dp=6)
def win_20b(spark, sf):
    return R.rsi(v.panel_day(spark, sf), adjust=False)


@query("win_21_swing_high", f"SELECT symbol, ts, count(*) OVER w = 11 AND high >= max(high) OVER w AS swing_high FROM {{{{bars_15m}}}} WINDOW w AS ({BW} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)")
def win_21(spark, sf):
    return R.swing_high(bars15(spark, sf), 5).select("symbol", "ts", "swing_high")


@query("win_22_vol_scale", f"""WITH a AS (SELECT *, close / lag(close) OVER ({PW}) - 1 AS r FROM {{{{panel_day}}}}),
    b AS (SELECT symbol, et_date, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w END AS x FROM a WINDOW w AS ({PW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT symbol, et_date, coalesce(least(greatest(quantile_cont(x, 0.5) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(x, 0), 0.5), 2.0), 1.0) AS scale
    FROM b""", dbl="scale", dp=7)
def win_22(spark, sf):
    return R.vol_scale(v.panel_day(spark, sf)).select("symbol", "et_date", "scale")


@query("win_23_partial_drawdown", f"SELECT symbol, et_date, (close / max(close) OVER ({PW} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1) * 100 AS dd FROM {{{{panel_day}}}}", dbl="dd", dp=7)
def win_23(spark, sf):
    return R.partial_drawdown(v.panel_day(spark, sf)).select("symbol", "et_date", "dd")


def polls_x(spark, sf):
    """Polls with a longer failing tail, so streaks show."""
    p = v.polls(spark, sf)
    tail = F.col("polled_at") >= F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    return p.withColumn("ok", F.when(tail & F.col("source_id").isin("edgar", "x_nitter"), False).otherwise(F.col("ok")))


POLLSX = "SELECT source_id, polled_at, poll_id, n_seen, n_new, CASE WHEN polled_at >= TIMESTAMP '2024-01-29 12:00:00' AND source_id IN ('edgar', 'x_nitter') THEN false ELSE ok END AS ok FROM {{polls}}"


@query("win_24_failure_streak", f"SELECT source_id, max(polled_at) AS last_poll, count(*) FILTER (WHERE polled_at > coalesce(lo, TIMESTAMP '1900-01-01')) AS failures FROM (SELECT *, max(CASE WHEN ok THEN polled_at END) OVER (PARTITION BY source_id) AS lo FROM ({POLLSX})) GROUP BY source_id")
def win_24(spark, sf):
    return R.trailing_failures(polls_x(spark, sf))


@query("win_25_zero_output", """WITH p AS (SELECT *, ok AND n_new = 0 AS z, row_number() OVER (PARTITION BY source_id ORDER BY polled_at) AS rn FROM {{polls}}),
    s AS (SELECT *, rn - coalesce(max(CASE WHEN NOT z THEN rn END) OVER (PARTITION BY source_id ORDER BY polled_at), 0) AS streak FROM p)
    SELECT source_id, polled_at::DATE AS day, min(polled_at) AS alert_at, arg_min(streak, polled_at) AS streak FROM s WHERE streak >= 3 GROUP BY 1, 2""")
def win_25(spark, sf):
    return R.zero_output_alerts(v.polls(spark, sf), 3)


@query("win_26_top_per_source", """SELECT source_id, event_id, observed_time, rn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY observed_time DESC, event_id DESC) AS rn FROM {{dated}})
    WHERE rn <= 5 ORDER BY observed_time DESC, event_id DESC LIMIT 18""")
def win_26(spark, sf):
    return R.top_n_per_source(v.dated(spark, sf), 5, 18).select("source_id", "event_id", "observed_time", "rn")


@query("win_27_latest_poll", "SELECT source_id, poll_id, polled_at, ok, n_seen FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY polled_at DESC, poll_id DESC) AS rn FROM {{polls}}) WHERE rn = 1")
def win_27(spark, sf):
    return R.latest_poll(v.polls(spark, sf))


@query("win_28_gap_count", """SELECT symbol, et_date, sum(coalesce((epoch_us(ts) - epoch_us(pt)) // 900000000 - 1, 0))::BIGINT AS missing FROM
    (SELECT *, lag(ts) OVER (PARTITION BY symbol, et_date ORDER BY ts) AS pt FROM {{bars_15m}}) GROUP BY 1, 2""")
def win_28(spark, sf):
    return B.gap_count(v.bars_15m(spark, sf), 15).groupBy("symbol", "et_date").agg(F.sum("missing").alias("missing"))


DIPS = """SELECT symbol, ts, et_date, entry_ts, entry_open FROM (SELECT *, lag(below) OVER w AS pb, lead(ts) OVER w AS entry_ts, lead(open) OVER w AS entry_open FROM (SELECT *, close <= max(high) OVER (PARTITION BY symbol, et_date ORDER BY ts) * (1 - 0.6) AS below FROM {{bars_15m}})
    WINDOW w AS (PARTITION BY symbol, et_date ORDER BY ts)) WHERE below AND NOT coalesce(pb, false) AND entry_ts IS NOT NULL"""


@query("win_29_dip_entries", DIPS)
def win_29(spark, sf):
    return R.dip_entries(v.bars_15m(spark, sf), 0.6).select("symbol", "ts", "et_date", "entry_ts", "entry_open")


OVERLAY = f"""SELECT symbol, et_date, expo, expo * r + (1 - expo) * 0.04 / 252 - coalesce(abs(expo - lag(expo) OVER ({PW})), 0) * 0.001 AS ret FROM
    (SELECT symbol, et_date, close / lag(close) OVER ({PW}) - 1 AS r, CASE WHEN s2_off THEN 0.0 ELSE 1.0 END AS expo FROM ({SW}))"""


@query("win_30_overlay_return", OVERLAY, dbl="expo ret")
def win_30(spark, sf):
    return R.overlay_return(R.bear_switches(v.panel_day(spark, sf), dd=-0.8), "s2_off").select("symbol", "et_date", "expo", "ret")


DCA = f"""SELECT symbol, et_date, d, flow, shares, shares * close AS equity FROM (SELECT *, sum(flow * (1 - 0.0001) / (open * (1 + 0.0002))) OVER ({PW}) AS shares FROM
    (SELECT *, CASE WHEN d = 0 OR date_trunc('month', et_date) <> date_trunc('month', lag(et_date) OVER ({PW})) THEN 800.0 ELSE 0.0 END AS flow FROM {{{{panel_day}}}}))"""


@query("win_31_nav_drawdown", f"""SELECT symbol, et_date, nav, nav / max(nav) OVER ({PW}) - 1 AS nav_dd FROM (SELECT *, exp(sum(ln(coalesce(CASE WHEN base > 0 THEN equity / base ELSE 1 END, 1))) OVER ({PW})) AS nav
    FROM (SELECT *, lag(equity) OVER ({PW}) + flow AS base FROM ({DCA})))""", dbl="nav nav_dd", dp=6)
def win_31(spark, sf):
    return R.nav_drawdown(R.periodic_investment(v.panel_day(spark, sf), 800)).select("symbol", "et_date", "nav", "nav_dd")


@query("win_34_post_trend", f"""SELECT symbol, et_date, CASE WHEN c = 31 THEN mw END AS mean_win, CASE WHEN c = 31 AND a > 0 THEN b / a END AS trend_ratio, CASE WHEN c = 31 AND bs > 0 THEN mw / bs END AS vs_base FROM (
    SELECT symbol, et_date, count(n) OVER w AS c, avg(n) OVER w AS mw, avg(n) OVER ({PW} ROWS BETWEEN 30 PRECEDING AND 16 PRECEDING) AS a, avg(n) OVER ({PW} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS b,
    avg(n) OVER ({PW} ROWS BETWEEN 395 PRECEDING AND 31 PRECEDING) AS bs FROM ({SPINE}) WINDOW w AS ({PW} ROWS BETWEEN 30 PRECEDING AND CURRENT ROW))""", dbl="mean_win trend_ratio vs_base", dp=7)
def win_34(spark, sf):
    return R.post_trend(daily_counts(spark, sf)).select("symbol", "et_date", "mean_win", "trend_ratio", "vs_base")


@query("win_35_all_time_high", f"SELECT symbol, et_date, close / max(close) OVER ({PW}) - 1 AS ath_dist FROM {{{{panel_day}}}}", dbl="ath_dist")
def win_35(spark, sf):
    return R.all_time_high(v.panel_day(spark, sf)).select("symbol", "et_date", "ath_dist")


@query("win_36_periodic_investment", f"SELECT symbol, et_date, flow, shares, equity FROM ({DCA})", dbl="flow shares equity", dp=5)
def win_36(spark, sf):
    return R.periodic_investment(v.panel_day(spark, sf), 800).select("symbol", "et_date", "flow", "shares", "equity")


@query("win_37_cash_balance", f"""WITH f AS (SELECT symbol, et_date FROM ({DCA}) WHERE flow > 0)
    SELECT p.symbol, p.et_date, sum(800 * pow(1.04, (p.et_date - f.et_date) / 365.25)) AS balance FROM {{{{panel_day}}}} p JOIN f ON f.symbol = p.symbol AND f.et_date <= p.et_date GROUP BY 1, 2""", dbl="balance", dp=5)
def win_37(spark, sf):
    return R.cash_balance(v.panel_day(spark, sf), 800.0, 0.04).select("symbol", "et_date", "balance")
