"""Aggregation queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finance as fin
from ..functions import numeric as nm
from ..functions import times as tm
from ..operators import bars as B
from ..operators import metrics as M
from ..operators import patterns as P
from ..operators import rolling as R
from ..operators import settle as S
from ..operators import spread
from ..operators import states as ST
from ..operators import store as E
from ..sources.tables import table
from . import sequences as q
from . import views as v
from .joins import DAYT, DENSE_EV, JUMPS, chain, days, dense_events, jump_events
from .projections import ET_EV, FACT_SQL, POS_SQL, REC_SQL, score_parts
from .registry import query
from .windows import PW, SW


# ---------------------------------------------------------------- bars
@query("bar_01_daily_bars", "SELECT symbol, et_date, open, high, low, close, volume, open_time, close_time FROM {{bars_day}}")
def bar_01(spark, sf):
    return B.daily_bars(v.bars_1h(spark, sf))


@query("bar_02_resample", """SELECT symbol, make_timestamp(a + bk * 3600000000) AS ts, et_date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_sub FROM (
    SELECT *, (epoch_us(ts) - a) // 3600000000 AS bk FROM (SELECT *, epoch_us(min(ts) OVER (PARTITION BY symbol, et_date)) AS a FROM {{bars_15m}})) GROUP BY symbol, et_date, a, bk HAVING count(*) >= 0.8 * 60 / 15""")
def bar_02(spark, sf):
    return B.resample(v.bars_15m(spark, sf), 60, 15)


@query("bar_03_bars_per_day", "SELECT symbol, quantile_cont(n, 0.5) AS bars_per_day FROM (SELECT symbol, et_date, count(*) AS n FROM {{bars_15m}} GROUP BY 1, 2) GROUP BY symbol", dbl="bars_per_day")
def bar_03(spark, sf):
    n = v.bars_15m(spark, sf).groupBy("symbol", "et_date").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("symbol").agg(F.percentile("n", F.lit(0.5)).alias("bars_per_day"))


@query("bar_04_weekly_close", "SELECT symbol, et_date + CAST((12 - isodow(et_date)) % 7 AS INTEGER) AS week_end, arg_max(close, et_date) AS close FROM {{panel_day}} GROUP BY 1, 2")
def bar_04(spark, sf):
    # weeks end on Friday
    end = F.next_day(F.date_sub("et_date", 1), "FRI")
    return v.panel_day(spark, sf).groupBy("symbol", end.alias("week_end")).agg(F.max_by("close", "et_date").alias("close"))


@query("bar_05_volume_by_day", "SELECT symbol, et_date, sum(volume) AS volume FROM {{bars_15m}} GROUP BY 1, 2")
def bar_05(spark, sf):
    return v.bars_15m(spark, sf).groupBy("symbol", "et_date").agg(F.sum("volume").alias("volume"))


# ---------------------------------------------------------------- pattern summaries
@query("agg_01_v_grid_summary", f"""SELECT x, y, "T", count(*) FILTER (WHERE outcome = 'rebounded') AS v_count, count(*) FILTER (WHERE outcome = 'timeout') AS timeout_count, count(*) AS trigger_count, count(*) FILTER (WHERE outcome = 'timeout') / count(*) AS timeout_rate,
    avg(drop_pct) AS avg_drop, avg(rebound_pct) AS avg_rebound, quantile_cont(bars_to_rebound, 0.5) AS median_bars, quantile_cont(bars_to_rebound, 0.9) AS p90_bars FROM ({q.VEV}) GROUP BY 1, 2, 3""", dbl="x y timeout_rate avg_drop avg_rebound median_bars p90_bars", dp=7)
def agg_01(spark, sf):
    e = q.v_all(spark, sf)
    ok = F.col("outcome") == "rebounded"
    a = e.groupBy("x", "y", "T").agg(
        F.count(F.when(ok, 1)).alias("v_count"), F.count(F.when(~ok, 1)).alias("timeout_count"), F.count(F.lit(1)).alias("trigger_count"),
        F.avg((~ok).cast("int")).alias("timeout_rate"), F.avg("drop_pct").alias("avg_drop"), F.avg("rebound_pct").alias("avg_rebound"),
        # bars to a rebound is at most T, so the exact percentile keeps T counters
        F.percentile("bars_to_rebound", F.lit(0.5)).alias("median_bars"), F.percentile("bars_to_rebound", F.lit(0.9)).alias("p90_bars"))
    return a


@query("agg_02_v_dedup", f"""SELECT symbol, anchor_pos, trough_pos, x, y, "T", outcome, n_param_combos FROM (SELECT *, count(*) OVER (PARTITION BY symbol, anchor_pos, trough_pos) AS n_param_combos,
    row_number() OVER (PARTITION BY symbol, anchor_pos, trough_pos ORDER BY outcome, x, y, "T") AS rn FROM ({q.VEV})) WHERE rn = 1""", dbl="x y")
def agg_02(spark, sf):
    return P.dedup_events(q.v_all(spark, sf), ["outcome", "x", "y", "T"]).select("symbol", "anchor_pos", "trough_pos", "x", "y", "T", "outcome", "n_param_combos")


UNIQ_T = f"SELECT u.*, b.ts AS trough_t, b.et_date FROM ({q.HDEDUP}) u JOIN {{{{bars_1h}}}} b ON b.symbol = u.symbol AND b.pos = u.trough_pos"


@query("agg_03_event_counts", " UNION ALL ".join(f"SELECT symbol, '{g}' AS grain, date_trunc('{g}', et_date)::DATE AS bucket, count(*) AS n FROM ({UNIQ_T}) GROUP BY 1, 3" for g in ("day", "week", "month")))
def agg_03(spark, sf):
    u = q.hlh_unique(spark, sf).withColumn("et_date", tm.et_date("trough_t"))
    g = F.explode(F.array(*[F.struct(F.lit(x).alias("grain"), F.to_date(F.date_trunc(x, "et_date")).alias("bucket")) for x in ("day", "week", "month")]))
    return u.withColumn("_g", g).groupBy("symbol", "_g.grain", "_g.bucket").agg(F.count(F.lit(1)).alias("n"))


@query("agg_04_describe_quantiles", " UNION ALL ".join(f"SELECT theta, \"X\", \"Y\", '{c}' AS name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.1) AS p10, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.9) AS p90, max({c}) AS max FROM ({q.HLH}) h GROUP BY 1, 2, 3" for c in ("drop_pct", "rebound_pct")),
       dbl="theta X Y mean std min p10 p50 p90 max", dp=7)
def agg_04(spark, sf):
    key = ["theta", "X", "Y", "name"]
    u = q.hlh(spark, sf).select(*key[:3], F.expr("stack(2, 'drop_pct', drop_pct, 'rebound_pct', rebound_pct) AS (name, size)"))
    a = u.groupBy(*key).agg(F.count("size").alias("n"), F.avg("size").alias("mean"), F.stddev_samp("size").alias("std"), F.min("size").alias("min"), F.max("size").alias("max"))
    return a.join(spread.quantiles(u, key, "size", p10=0.1, p50=0.5, p90=0.9), key)


@query("agg_05_vol_regime_counts", f"""WITH v0 AS (SELECT symbol, pos, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w END AS vol FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM {{{{bars_1h}}}}) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    qq AS (SELECT symbol, quantile_cont(vol, 0.3333333333333333) AS q1, quantile_cont(vol, 0.6666666666666666) AS q2 FROM v0 GROUP BY symbol)
    SELECT symbol, CASE WHEN vol <= q1 THEN 'low' WHEN vol <= q2 THEN 'mid' ELSE 'high' END AS regime, count(*) AS n FROM ({q.HDEDUP}) u JOIN v0 USING (symbol) JOIN qq USING (symbol) WHERE v0.pos = u.trough_pos AND vol IS NOT NULL GROUP BY 1, 2""")
def agg_05(spark, sf):
    ev = q.hlh_unique(spark, sf).select("symbol", F.col("trough_pos").alias("pos"))
    return M.vol_regime_counts(v.with_pos(v.bars_1h(spark, sf)), ev, 20)


ET_TS = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


@query("agg_06_time_heatmap", f"SELECT extract(hour FROM {ET_TS})::INTEGER AS hour, " + ", ".join(f"count(*) FILTER (WHERE extract(minute FROM {ET_TS}) // 5 = {i}) AS s{i}" for i in range(12)) + " FROM events GROUP BY 1")
def agg_06(spark, sf):
    e = table(spark, sf, "events", "ts").withColumn("_m", tm.et_minute("ts"))
    e = e.withColumn("slot", F.concat(F.lit("s"), F.floor(F.col("_m") % 60 / 5).cast("string")))
    p = e.groupBy(F.floor(F.col("_m") / 60).cast("int").alias("hour")).pivot("slot", [f"s{i}" for i in range(12)])
    return p.agg(F.count(F.lit(1))).na.fill(0)


@query("agg_07_histogram", "SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) GROUP BY 1")
def agg_07(spark, sf):
    return M.histogram(table(spark, sf, "lineitem", "l_extendedprice"), "l_extendedprice")


@query("agg_08_daily_by_theta", f"SELECT theta, b.et_date, count(*) AS n FROM ({q.HLH}) h JOIN {{{{bars_1h}}}} b ON b.symbol = h.symbol AND b.pos = h.rebound_pos GROUP BY 1, 2", dbl="theta")
def agg_08(spark, sf):
    return q.hlh(spark, sf).groupBy("theta", tm.et_date("rebound_t").alias("et_date")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- trades. Returns are scaled down: the fixture prices are noise.
SC = "0.0005"
GEO_SQL = "SELECT symbol, et_date, pos, direction, tp, sl, hit, exit_pos, entry_px, ret * " + SC + " AS ret FROM (" + q.settle_sql(
    f"SELECT m.*, g.* FROM ({q.MOM}) m, (SELECT unnest([0.1, 0.2, 0.5]::DOUBLE[]) AS tp, unnest([0.1, 0.1, 0.3]::DOUBLE[]) AS sl) g", q.BARS15, 8, "tp", "sl") + ")"


def geo_trades(spark, sf):
    p = nm.grid_rows(S.forward_paths(q.mom(spark, sf), 8, F.col("direction").isNotNull()), ["tp", "sl"], q.GEO)
    t = S.bracket(p, F.col("tp"), F.col("sl"))
    return t.select("symbol", "et_date", "pos", "direction", "tp", "sl", "hit", "exit_pos", "entry_px", (F.col("ret") * 0.0005).alias("ret"))


@query("agg_09_combo_metrics", f"SELECT tp, sl, count(*) AS trades, product(1 + ret) - 1 AS total_return, avg((hit = 'tp')::INT) AS hit_tp_pct, avg((hit = 'sl')::INT) AS hit_sl_pct, avg(ret) AS avg_ret FROM ({GEO_SQL}) GROUP BY 1, 2", dbl="tp sl total_return hit_tp_pct hit_sl_pct avg_ret", dp=8)
def agg_09(spark, sf):
    return M.combo_metrics(geo_trades(spark, sf), ["tp", "sl"])


KEPT_S = f"SELECT symbol, et_date, pos, direction, hit, ret * {SC} AS ret, CASE WHEN et_date >= DATE '2024-01-16' THEN 'holdout' ELSE 'train' END AS segment FROM ({q.KEPT})"


def kept(spark, sf):
    t = q.kept_trades(spark, sf).withColumn("ret", F.col("ret") * 0.0005)
    return t.withColumn("segment", F.when(F.col("et_date") >= F.lit("2024-01-16").cast("date"), "holdout").otherwise("train"))


def stats_sql(t, keys, extra=""):
    return f"""SELECT {keys}, count(*) AS n, avg((ret > 0)::INT) AS wr, avg(ret) * 1e4 AS avg_bp, min(eq / pk - 1) AS mdd, exp(sum(ln(1 + ret))) - 1 AS total {extra} FROM (SELECT *, max(eq) OVER (PARTITION BY {keys} ORDER BY pos) AS pk FROM (
    SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY {keys} ORDER BY pos)) AS eq FROM ({t}))) GROUP BY {keys}"""


@query("agg_10_segment_stats", stats_sql(KEPT_S, "symbol, segment"), dbl="wr avg_bp mdd total", dp=7)
def agg_10(spark, sf):
    return M.path_stats(kept(spark, sf), ["symbol", "segment"], "et_date", "pos")


@query("agg_11_trade_report", stats_sql(KEPT_S, "symbol", ", max(ret) AS best, min(ret) AS worst, avg((hit = 'tp')::INT) AS tp_rate, avg((hit = 'sl')::INT) AS sl_rate, quantile_cont(ret, 0.5) AS median_ret"), dbl="wr avg_bp mdd total best worst tp_rate sl_rate median_ret", dp=7)
def agg_11(spark, sf):
    return M.trade_report(kept(spark, sf), ["symbol"], "et_date", "pos")


DSIM_S = f"SELECT symbol, et_date, direction, pos AS entry_d, exit_pos AS exit_d, exit_pos - pos + 1 AS hold_days, hit, ret * {SC} AS ret FROM ({q.DSIM})"


def dsim(spark, sf):
    return q.daily_sim(spark, sf).withColumn("ret", F.col("ret") * 0.0005).withColumn("hold_days", F.col("exit_d") - F.col("entry_d") + 1)


@query("agg_12_monthly_return", f"SELECT symbol, date_trunc('month', et_date)::DATE AS month, product(1 + ret) - 1 AS ret FROM ({DSIM_S}) GROUP BY 1, 2", dbl="ret", dp=8)
def agg_12(spark, sf):
    return dsim(spark, sf).groupBy("symbol", F.trunc("et_date", "month").alias("month")).agg(M.compounded().alias("ret"))


@query("agg_13_worst_day", f"SELECT symbol, min(r) AS worst_ret, arg_min(et_date, {{'r': r, 'd': et_date}}) AS worst_day FROM (SELECT symbol, et_date, product(1 + ret) - 1 AS r FROM ({KEPT_S}) GROUP BY 1, 2) GROUP BY symbol", dbl="worst_ret", dp=8)
def agg_13(spark, sf):
    return M.worst_day(kept(spark, sf))


@query("agg_14_growth_rates", "SELECT symbol, pow(t, 365.0 / days) - 1 AS cagr_365, pow(t, 365.25 / days) - 1 AS cagr_36525, pow(t, 252.0 / n) - 1 AS cagr_252 FROM (SELECT symbol, arg_max(close, et_date) / arg_min(close, et_date) AS t, max(et_date) - min(et_date) AS days, count(*) AS n FROM {{panel_day}} GROUP BY symbol)", dbl="cagr_365 cagr_36525 cagr_252", dp=8)
def agg_14(spark, sf):
    g = v.panel_day(spark, sf).groupBy("symbol").agg(
        (F.max_by("close", "et_date") / F.min_by("close", "et_date")).alias("t"), F.datediff(F.max("et_date"), F.min("et_date")).alias("days"), F.count(F.lit(1)).alias("n"))
    return g.select("symbol", *M.growth_rates(F.col("t"), F.col("days"), F.col("n")))


@query("agg_15_mae", f"SELECT t.symbol, t.pos, least(min(b.close / t.entry_px - 1), 0) AS mae FROM (SELECT * FROM ({q.BRACK}) WHERE direction = 1) t JOIN {{{{bars_15m}}}} b ON b.symbol = t.symbol AND b.pos BETWEEN t.pos AND t.exit_pos GROUP BY 1, 2", dbl="mae", dp=8)
def agg_15(spark, sf):
    return M.mae(q.mom_trades(spark, sf).filter("direction = 1")).select("symbol", "pos", "mae")


PROBS = "SELECT event_id, symbol, (event_id % 1000) / 1000.0 AS prob, (price - 12) / 1000 AS ret FROM {{ticks}}"


def probs(spark, sf):
    return v.ticks(spark, sf).select("event_id", "symbol", (F.col("event_id") % 1000 / 1000.0).alias("prob"), ((F.col("price") - 12) / 1000).alias("ret"))


@query("agg_16_prob_layers", f"SELECT layer, count(*) AS n, avg(ret) * 1e4 AS avg_bp, avg((ret > 0)::INT) AS win_rate, avg(ret) / stddev_samp(ret) * sqrt(count(*)) AS t_stat, quantile_cont(ret, 0.5) AS median_ret FROM ({PROBS}), (SELECT unnest([0.0, 0.5, 0.6, 0.7]::DOUBLE[]) AS layer) WHERE prob >= layer GROUP BY layer", dbl="layer avg_bp win_rate t_stat median_ret", dp=7)
def agg_16(spark, sf):
    return M.layers(probs(spark, sf), "prob", "ret", [0.0, 0.5, 0.6, 0.7])


@query("agg_17_threshold_table", "SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS kept, count(*) FILTER (WHERE score >= threshold) / count(*) AS retention, avg(label) FILTER (WHERE score >= threshold) AS precision FROM {{scored}}, (SELECT unnest([200, 500, 1000, 3000, 10000000]::DOUBLE[]) AS threshold) GROUP BY threshold", dbl="threshold retention precision")
def agg_17(spark, sf):
    return M.threshold_table(v.scored(spark, sf), "score", "label", [200, 500, 1000, 3000, 10_000_000])


FLAGGED = f"SELECT symbol, s1_off AS flag, CASE WHEN et_date >= DATE '1999-01-01' THEN 'valid' ELSE 'train' END AS segment, close / open - 1 AS ret FROM ({SW})"


def flagged(spark, sf):
    s = R.bear_switches(v.panel_day(spark, sf), dd=-0.8)
    return s.select("symbol", F.col("s1_off").alias("flag"), F.when(F.col("et_date") >= F.lit("1999-01-01").cast("date"), "valid").otherwise("train").alias("segment"), (F.col("close") / F.col("open") - 1).alias("ret"))


@query("agg_18_two_sample", f"""SELECT segment, n_on, n_off, m_on, m_off, m_on - m_off AS diff, (m_on - m_off) / sqrt(v1 / n_on + v0 / n_off) AS welch_t FROM (SELECT segment, count(*) FILTER (WHERE flag) AS n_on, count(*) FILTER (WHERE NOT flag) AS n_off, avg(ret) FILTER (WHERE flag) AS m_on, avg(ret) FILTER (WHERE NOT flag) AS m_off,
    var_samp(ret) FILTER (WHERE flag) AS v1, var_samp(ret) FILTER (WHERE NOT flag) AS v0 FROM ({FLAGGED}) GROUP BY 1)""", dbl="m_on m_off diff welch_t", dp=7)
def agg_18(spark, sf):
    return M.two_sample(flagged(spark, sf), ["segment"], "flag", "ret")


@query("agg_19_contribution", f"SELECT s.symbol, coalesce(trades, 0) AS trades, win_rate, avg_bp, coalesce(pnl, 0) AS pnl FROM (SELECT DISTINCT symbol FROM {{{{bars_15m}}}}) s LEFT JOIN (SELECT symbol, count(*) AS trades, avg((ret > 0)::INT) AS win_rate, avg(ret) * 1e4 AS avg_bp, sum(ret * 1000) AS pnl FROM ({KEPT_S}) WHERE symbol <> 'view' GROUP BY 1) t USING (symbol)", dbl="win_rate avg_bp pnl", dp=6)
def agg_19(spark, sf):
    t = kept(spark, sf).filter("symbol <> 'view'").withColumn("pnl", F.col("ret") * 1000)
    return M.contribution(t, v.bars_15m(spark, sf).select("symbol").distinct())


SLI = "SELECT year(et_date) AS yr, CASE WHEN d % 3 = 0 THEN 'intraday' ELSE 'after_hours' END AS timing, symbol, close / open - 1 AS x FROM {{panel_day}}"


@query("agg_20_grouping_sets", f"SELECT yr, timing, symbol, count(*) AS n, avg(x) * 1e4 AS mean_bp, avg((x > 0)::INT) AS pos_share FROM ({SLI}) GROUP BY GROUPING SETS ((yr), (timing), (symbol))", dbl="mean_bp pos_share", dp=4)
def agg_20(spark, sf):
    p = v.panel_day(spark, sf).select(F.year("et_date").alias("yr"), F.when(F.col("d") % 3 == 0, "intraday").otherwise("after_hours").alias("timing"), "symbol", (F.col("close") / F.col("open") - 1).alias("x"))
    return M.sliced_totals(p, [["yr"], ["timing"], ["symbol"]], ["yr", "timing", "symbol"], "x")


def _ll(name, j):
    return f"""SELECT '{name}' AS channel, count(*) AS n_events, count(gap) AS n_pre, count(gap) / count(*) AS frac, (SELECT avg((EXISTS (SELECT 1 FROM ({j}) j WHERE j.symbol = p.symbol AND j.act BETWEEN p.d - 30 AND p.d - 1))::INT) FROM {{{{panel_day}}}} p WHERE p.d >= 30) AS base_frac,
    avg(gap) AS mean_lead, quantile_cont(gap, 0.5) AS median_lead FROM (SELECT e.symbol, e.et_date, min(e.act - j.act) AS gap FROM ({DENSE_EV}) e LEFT JOIN ({j}) j ON j.symbol = e.symbol AND j.time < e.time AND j.act >= e.act - 30 GROUP BY 1, 2)"""


@query("agg_21_lead_lag", _ll("jump_up", JUMPS) + " UNION ALL " + _ll("jump_down", q.DOWNS), dbl="frac base_frac mean_lead median_lead")
def agg_21(spark, sf):
    from ..operators import joins as J

    dn, p = dense_events(spark, sf), v.panel_day(spark, sf).select("symbol", "d")
    r = v.releases(spark, sf).filter("change_pct <= -20")
    down = J.act_day(r.select("symbol", F.col("published").alias("time")), days(spark, sf), time="time").filter("act_d is not null").select("symbol", "time", F.col("act_d").alias("act"))
    return M.lead_lag(dn, jump_events(spark, sf), p, "jump_up").unionByName(M.lead_lag(dn, down, p, "jump_down"))


@query("agg_22_conditional_means", f"""SELECT lookback, w AS "window", count(*) FILTER (WHERE pre) AS n_pre, count(*) FILTER (WHERE NOT pre) AS n_nopre, avg(r) FILTER (WHERE pre) * 1e4 AS mean_pre_bp, avg(r) FILTER (WHERE NOT pre) * 1e4 AS mean_nopre_bp FROM (
    SELECT e.*, lookback, w, CASE w WHEN 5 THEN p.r5 ELSE p.r20 END AS r, EXISTS (SELECT 1 FROM ({JUMPS}) j WHERE j.symbol = e.symbol AND j.time < e.time AND j.act >= e.act - lookback) AS pre FROM ({DENSE_EV}) e JOIN (SELECT symbol, d, lead(close, 4) OVER ({PW}) / open - 1 AS r5, lead(close, 19) OVER ({PW}) / open - 1 AS r20 FROM {{{{panel_day}}}}) p ON p.symbol = e.symbol AND p.d = e.act,
    (SELECT unnest([5, 10, 20]) AS lookback), (SELECT unnest([5, 20]) AS w) WHERE e.act >= lookback) WHERE r IS NOT NULL GROUP BY 1, 2""", dbl="mean_pre_bp mean_nopre_bp", dp=4)
def agg_22(spark, sf):
    w = W.partitionBy("symbol").orderBy("d")
    r = v.panel_day(spark, sf).select("symbol", F.col("d").alias("act"), *[(F.lead("close", n - 1).over(w) / F.col("open") - 1).alias(f"r{n}") for n in (5, 20)])
    return M.conditional_means(dense_events(spark, sf), jump_events(spark, sf), r, [5, 10, 20], [5, 20])


# ---------------------------------------------------------------- event store
LAG = "(epoch_us(observed_time) - epoch_us(event_time)) / 1000000.0"


@query("agg_23_source_counts", "SELECT source_id, count(*) AS n, max(observed_time) AS last_observed FROM {{dated}} GROUP BY 1")
def agg_23(spark, sf):
    return E.source_counts(v.dated(spark, sf))


@query("agg_24_latency", f"SELECT source_id, count(*) AS n, min({LAG}) AS lag_min, avg({LAG}) AS lag_avg, max({LAG}) AS lag_max, list_extract(list_sort(list({LAG})), count(*) // 2 + 1) AS lag_p50 FROM {{{{dated}}}} GROUP BY 1", dbl="lag_min lag_avg lag_max lag_p50", dp=6)
def agg_24(spark, sf):
    return E.latency(v.dated(spark, sf))


@query("agg_25_steady_latency", f"""SELECT source_id, n_steady, n_all - n_steady AS n_backfill, list_extract(l, CAST(least(n_steady - 1, round_even(0.5 * (n_steady - 1), 0)) AS BIGINT) + 1) AS p50, list_extract(l, CAST(least(n_steady - 1, round_even(0.9 * (n_steady - 1), 0)) AS BIGINT) + 1) AS p90 FROM (
    SELECT source_id, count(*) AS n_all, count(*) FILTER (WHERE day > fd) AS n_steady, list_sort(list({LAG}) FILTER (WHERE day > fd)) AS l FROM (SELECT *, observed_time::DATE AS day, min(observed_time::DATE) OVER (PARTITION BY source_id) AS fd FROM {{{{dated}}}}) GROUP BY 1)""", dbl="p50 p90", dp=6)
def agg_25(spark, sf):
    return E.steady_latency(v.dated(spark, sf))


@query("agg_26_tier_counts", "SELECT tier, count(*) FILTER (WHERE observed_time >= TIMESTAMP '2024-01-25 05:00:00') AS today, count(*) FILTER (WHERE observed_time >= TIMESTAMP '2024-01-18 18:00:00') AS week FROM {{dated}} WHERE observed_time >= TIMESTAMP '2024-01-18 18:00:00' GROUP BY tier")
def agg_26(spark, sf):
    return E.tier_counts(v.dated(spark, sf), "2024-01-25 18:00:00")


@query("agg_27_recent_scores", f"SELECT source_id, avg(total) AS avg_total, count(*) AS n FROM (SELECT source_id, {POS_SQL} * ({FACT_SQL}) * ({REC_SQL}) AS total, row_number() OVER (PARTITION BY source_id ORDER BY event_time DESC, event_id DESC) AS rn FROM {{{{dated}}}}) WHERE rn <= 100 GROUP BY 1", dbl="avg_total")
def agg_27(spark, sf):
    s = score_parts(v.dated(spark, sf)).withColumn("total", F.col("position") * F.col("fact") * F.col("recency"))
    return E.recent_scores(s)


ATM = """WITH spot AS (SELECT snapshot_date, (max(strike) FILTER (WHERE opt_right = 'C' AND in_the_money) + min(strike) FILTER (WHERE opt_right = 'C' AND NOT in_the_money)) / 2.0 AS spot FROM {{chain}} GROUP BY 1),
    ex AS (SELECT snapshot_date, expiration, expiration - snapshot_date AS dte FROM (SELECT DISTINCT snapshot_date, expiration FROM {{chain}})), pick AS (SELECT snapshot_date, arg_min(expiration, {'n': CASE WHEN dte BETWEEN 15 AND 60 THEN 0 ELSE 1 END, 'a': abs(dte - 30), 'e': expiration}) AS expiration FROM ex WHERE dte BETWEEN 15 AND 60 OR dte >= 7 GROUP BY 1),
    iv AS (SELECT c.snapshot_date, avg(iv) AS iv, count(*) AS n_quotes FROM {{chain}} c JOIN pick p ON p.snapshot_date = c.snapshot_date AND p.expiration = c.expiration JOIN spot s ON s.snapshot_date = c.snapshot_date WHERE abs(strike - spot) <= spot * 0.02 AND iv BETWEEN 0.1 AND 3 GROUP BY 1 HAVING count(*) >= 3)
    SELECT snapshot_date, iv, n_quotes, base, CASE WHEN base > 0 THEN least(1, abs(iv - base) / base / 0.3) END AS surprise FROM (SELECT *, CASE WHEN count(iv) OVER w >= 2 THEN avg(iv) OVER w END AS base FROM iv WINDOW w AS (ORDER BY snapshot_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""


@query("agg_28_iv_surprise", ATM, dbl="iv base surprise")
def agg_28(spark, sf):
    return E.iv_surprise(E.atm_iv(chain(spark, sf)))


def _side(c, r):
    return f"coalesce(sum({c}) FILTER (WHERE opt_right = '{r}'), 0)"


@query("agg_29_option_summary", f"""SELECT snapshot_date, count(*) AS n_contracts, count(DISTINCT expiration) AS n_expirations, {_side('volume', 'C')} AS call_volume, {_side('volume', 'P')} AS put_volume, {_side('oi', 'C')}::BIGINT AS call_oi, {_side('oi', 'P')}::BIGINT AS put_oi,
    round({_side('volume', 'P')} / {_side('volume', 'C')}, 3) AS pc_volume, round({_side('oi', 'P')} / {_side('oi', 'C')}, 3) AS pc_oi, CASE WHEN sum(oi) < 0.1 * sum(volume) THEN 'suspect_zero' ELSE 'ok' END AS oi_quality FROM {{{{chain}}}} GROUP BY 1""", dbl="call_volume put_volume pc_volume pc_oi", dp=6)
def agg_29(spark, sf):
    return E.option_summary(chain(spark, sf))


@query("agg_30_verdict_counts", f"SELECT direction, count(*) FILTER (WHERE score_1d = 'hit') AS hit, count(*) FILTER (WHERE score_1d = 'miss') AS miss, count(*) FILTER (WHERE score_1d = 'pending') AS pending FROM ({q.scores_sql('2024-01-22 12:00:00')}) GROUP BY 1")
def agg_30(spark, sf):
    return E.verdict_counts(q.scores_at(spark, sf, "2024-01-22 12:00:00"))


BUYS = "SELECT o_orderkey AS accession, 'issuer ' || (o_custkey // 4) AS symbol, o_orderdate::DATE AS et_date, 'owner ' || o_custkey AS owner, o_totalprice * 2.5 AS value_usd FROM orders"


@query("agg_31_insider_clusters", f"SELECT accession, CASE WHEN value_usd >= 1e6 THEN 'big' ELSE 'multi' END AS reason FROM (SELECT b.*, (SELECT count(DISTINCT p.owner) FROM ({BUYS}) p WHERE p.symbol = b.symbol AND p.et_date BETWEEN b.et_date - 30 AND b.et_date) AS k FROM ({BUYS}) b) WHERE value_usd >= 1e6 OR k >= 2")
def agg_31(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    b = o.select(
        F.col("o_orderkey").alias("accession"), F.concat(F.lit("issuer "), F.floor(F.col("o_custkey") / 4).cast("string")).alias("symbol"), F.to_date("o_orderdate").alias("et_date"),
        F.concat(F.lit("owner "), F.col("o_custkey").cast("string")).alias("owner"), (F.col("o_totalprice") * 2.5).alias("value_usd"))
    return E.insider_clusters(b).select("accession", "reason")


@query("agg_32_item_counts", f"SELECT item, count(*) AS n FROM (SELECT accession, unnest(list_distinct(list_transform(string_split(items, ','), lambda s: trim(s)))) AS item FROM ({q.FILINGS}) WHERE items <> '' AND form <> '10-K') GROUP BY item HAVING count(*) >= 10")
def agg_32(spark, sf):
    return E.item_counts(q.filings(spark, sf).filter("form <> '10-K'").select("accession", "items"))


@query("agg_33_fold_summary", """SELECT fold, count(*) AS n, sum(label)::BIGINT AS n_pos, avg((score >= 1000)::INT) AS retention, (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM (
    SELECT *, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS rk FROM (SELECT *, doc_id % 5 AS fold FROM {{scored}})) GROUP BY fold""", dbl="retention auc")
def agg_33(spark, sf):
    from ..operators.stats import auc

    s = v.scored(spark, sf).withColumn("fold", F.col("doc_id") % 5)
    a = s.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_pos"), F.avg((F.col("score") >= 1000).cast("int")).alias("retention"))
    return a.join(auc(s, ["fold"]), "fold")


@query("agg_34_regime_groups", """SELECT regexp_replace(regime, '_deep$', '') AS base, count(*) AS n_months, avg(ret) AS mean_ret FROM (SELECT symbol, month, ret, CASE WHEN mdd <= -0.5 THEN b || '_deep' ELSE b END AS regime FROM (SELECT symbol, date_trunc('month', et_date) AS month, last(close ORDER BY et_date) / first(open ORDER BY et_date) - 1 AS ret, min(low) / max(high) - 1 AS mdd,
    CASE WHEN last(close ORDER BY et_date) / first(open ORDER BY et_date) - 1 >= 0.1 THEN 'bull' WHEN last(close ORDER BY et_date) / first(open ORDER BY et_date) - 1 <= -0.1 THEN 'bear' ELSE 'sideways' END AS b FROM {{panel_day}} GROUP BY 1, 2)) GROUP BY 1""", dbl="mean_ret", dp=7)
def agg_34(spark, sf):
    from ..operators.signals import regime_label

    m = v.panel_day(spark, sf).groupBy("symbol", F.trunc("et_date", "month").alias("month")).agg(
        (F.max_by("close", "et_date") / F.min_by("open", "et_date") - 1).alias("ret"), (F.min("low") / F.max("high") - 1).alias("mdd"))
    m = m.withColumn("regime", regime_label(F.col("ret"), F.col("mdd"), deep=-0.5))
    return m.groupBy(F.regexp_replace("regime", "_deep$", "").alias("base")).agg(F.count(F.lit(1)).alias("n_months"), F.avg("ret").alias("mean_ret"))


FLOWS = "SELECT o_custkey AS account, o_orderdate::DATE AS d, -sum(o_totalprice) AS a FROM orders GROUP BY 1, 2 UNION ALL SELECT o_custkey, DATE '2002-01-01', sum(o_totalprice) * (0.9 + (o_custkey % 10) / 10.0) FROM orders GROUP BY 1"


@query("agg_35_xirr", f"""WITH RECURSIVE fl AS MATERIALIZED (SELECT account, list({{'t': (d - d0) / 365.25, 'a': a}}) AS f FROM (SELECT *, min(d) OVER (PARTITION BY account) AS d0 FROM ({FLOWS})) GROUP BY 1),
    b AS (SELECT account, -0.99::DOUBLE AS lo, 10.0::DOUBLE AS hi, 0 AS it FROM fl UNION ALL SELECT account, CASE WHEN npv > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN npv > 0 THEN hi ELSE (lo + hi) / 2 END, it + 1 FROM (SELECT b.*, list_sum(list_transform(f, lambda x: x.a / pow(1 + (lo + hi) / 2, x.t))) AS npv FROM b JOIN fl USING (account) WHERE it < 80))
    SELECT account, (lo + hi) / 2 AS irr FROM b WHERE it = 80""", dbl="irr", dp=7)
def agg_35(spark, sf):
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    out = o.select(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("d"), (-F.col("o_totalprice")).alias("a"))
    fin_ = o.groupBy(F.col("o_custkey").alias("account")).agg(F.lit("2002-01-01").cast("date").alias("d"), F.sum("o_totalprice").alias("s"))
    fin_ = fin_.select("account", "d", (F.col("s") * (0.9 + F.col("account") % 10 / 10.0)).alias("a"))
    return M.xirr(out.unionByName(fin_), "account", "d", "a")


@query("agg_36_equal_weight", f"""WITH n AS (SELECT symbol, et_date, close / first_value(open) OVER ({PW}) AS v FROM {{{{panel_day}}}}) SELECT d.et_date, avg(n.v) AS pool, count(n.v) AS n FROM (SELECT DISTINCT et_date FROM {{{{panel_day}}}}) d CROSS JOIN (SELECT DISTINCT symbol FROM {{{{panel_day}}}}) s
    ASOF LEFT JOIN n ON n.symbol = s.symbol AND n.et_date <= d.et_date GROUP BY 1""", dbl="pool", dp=7)
def agg_36(spark, sf):
    return M.equal_weight(v.panel_day(spark, sf))


@query("agg_37_peer_excess", "SELECT symbol, et_date, CASE WHEN n >= 11 THEN r - (s - r) / (n - 1) END AS excess FROM (SELECT symbol, et_date, close / open - 1 AS r, sum(close / open - 1) OVER (PARTITION BY et_date) AS s, count(*) OVER (PARTITION BY et_date) AS n FROM {{panel_wide}})", dbl="excess", dp=7)
def agg_37(spark, sf):
    p = v.panel_wide(spark, sf).select("symbol", "et_date", (F.col("close") / F.col("open") - 1).alias("r"))
    return M.peer_excess(p).select("symbol", "et_date", "excess")


ACTS = f"SELECT symbol, d, open AS price, CASE WHEN off THEN 'REDUCE' ELSE 'RESTORE' END AS action FROM (SELECT *, lag(off) OVER ({PW}) AS po FROM ({q.OFFN})) WHERE po IS NOT NULL AND po <> off"


@query("agg_38_reduce_restore", f"SELECT symbol, count(*) AS n_pairs, count(*) FILTER (WHERE r < -0.0005) AS n_right, count(*) FILTER (WHERE r >= -0.0005) AS n_wrong, avg(r) AS mean_ret FROM (SELECT symbol, action, lead(action) OVER w AS na, lead(price) OVER w / price - 1 AS r FROM ({ACTS}) WINDOW w AS (PARTITION BY symbol ORDER BY d)) WHERE action = 'REDUCE' AND na = 'RESTORE' GROUP BY 1", dbl="mean_ret", dp=7)
def agg_38(spark, sf):
    w = W.partitionBy("symbol").orderBy("d")
    s = q.off_state(spark, sf).withColumn("_p", F.lag("off").over(w)).filter("_p IS NOT NULL AND _p <> off")
    return M.reduce_restore(s.select("symbol", "d", F.col("open").alias("price"), F.when(F.col("off"), "REDUCE").otherwise("RESTORE").alias("action")))


@query("agg_39_feed_health", """SELECT run_id, count(*) AS n_bars, count(DISTINCT et_date) AS n_days, max(missing) AS max_gap, avg(lag_ms / 1000.0) FILTER (WHERE lag_ms > 0) AS lag_mean_s, max(lag_ms) FILTER (WHERE lag_ms > 0) / 1000.0 AS lag_max_s FROM (
    SELECT symbol AS run_id, et_date, (pos * 37) % 900 - 100 AS lag_ms, CAST(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol, et_date ORDER BY ts))) // 900000000 - 1, 0) AS BIGINT) AS missing FROM {{bars_15m}}) GROUP BY 1""", dbl="lag_mean_s lag_max_s", dp=7)
def agg_39(spark, sf):
    b = B.gap_count(v.with_pos(v.bars_15m(spark, sf)), 15).withColumn("run_id", F.col("symbol")).withColumn("lag_ms", (F.col("pos") * 37) % 900 - 100)
    return E.feed_health(b)


@query("agg_40_buy_and_hold", f"""SELECT symbol, t - 1 AS total, pow(t, 365.25 / days) - 1 AS cagr, mdd, uw AS underwater_days FROM (SELECT symbol, arg_max(close, et_date) * 0.9999 / (arg_min(close, et_date) * 1.0001) AS t, max(et_date) - min(et_date) AS days, min(close / pk - 1) AS mdd, max(et_date - pkd) AS uw FROM (
    SELECT *, last_value(CASE WHEN close >= pk THEN et_date END IGNORE NULLS) OVER ({PW}) AS pkd FROM (SELECT *, max(close) OVER ({PW}) AS pk FROM {{{{panel_day}}}})) GROUP BY symbol)""", dbl="total cagr mdd", dp=8)
def agg_40(spark, sf):
    return M.buy_and_hold(v.panel_day(spark, sf))


@query("agg_41_top_markets", "SELECT p_partkey AS market_id, p_retailprice * p_size AS volume FROM part WHERE p_size % 4 <> 0 AND p_size % 5 <> 0 AND p_retailprice >= 950 ORDER BY volume DESC, p_partkey LIMIT 25", dbl="volume", dp=4)
def agg_41(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    m = p.select(F.col("p_partkey").alias("market_id"), (F.col("p_size") % 4 != 0).alias("active"), (F.col("p_size") % 5 == 0).alias("closed"), F.col("p_retailprice").alias("liquidity"), (F.col("p_retailprice") * F.col("p_size")).alias("volume"))
    return E.top_markets(m, 950, 25).select("market_id", "volume")


LEV = f'SELECT symbol, theta, "X", "Y", peak_pos, count(*) AS slices, 2000.0 * count(*) AS invested, sum(pnl) AS pnl, max(hold_bars) AS max_hold FROM ({q.LAYER}) GROUP BY 1, 2, 3, 4, 5'


@query("agg_42_sliced_metrics", f"""SELECT symbol, theta, "X", "Y", sum(pnl) / 1e7 AS expected_return, max((pk - eq) / pk) AS max_drawdown, avg(invested) / 1e4 AS util_avg, max(invested) / 1e4 AS util_max, sum(invested) / 1e4 AS turnover, count(*) FILTER (WHERE slices = 5) AS n_full FROM (
    SELECT *, greatest(max(eq) OVER (PARTITION BY symbol, theta, "X", "Y" ORDER BY peak_pos), 1e7) AS pk FROM (SELECT *, 1e7 + sum(pnl) OVER (PARTITION BY symbol, theta, "X", "Y" ORDER BY peak_pos) AS eq FROM ({LEV}))) GROUP BY 1, 2, 3, 4""", dbl="theta X Y expected_return max_drawdown util_avg util_max turnover", dp=8)
def agg_42(spark, sf):
    e = q.layered(spark, sf).groupBy("symbol", "theta", "X", "Y", "peak_pos", F.to_date("peak_t").alias("_d")).agg(F.count(F.lit(1)).alias("slices"), F.sum("pnl").alias("pnl"))
    e = e.withColumn("invested", 2000.0 * F.col("slices"))
    key = ["symbol", "theta", "X", "Y"]
    e = spread.running(e, key, "_d", "peak_pos", _c=("sum", "pnl")).withColumn("eq", 1e7 + F.col("_c"))
    e = spread.running(e, key, "_d", "peak_pos", _m=("max", "eq")).withColumn("pk", F.greatest("_m", F.lit(1e7)))
    return e.groupBy(*key).agg(
        (F.sum("pnl") / 1e7).alias("expected_return"), F.max((F.col("pk") - F.col("eq")) / F.col("pk")).alias("max_drawdown"), (F.avg("invested") / 1e4).alias("util_avg"),
        (F.max("invested") / 1e4).alias("util_max"), (F.sum("invested") / 1e4).alias("turnover"), F.count(F.when(F.col("slices") == 5, 1)).alias("n_full"))


@query("agg_43_risk_adjusted", f"SELECT symbol, total / greatest(0.01, abs(mdd)) AS score FROM ({stats_sql(KEPT_S, 'symbol')})", dbl="score", dp=6)
def agg_43(spark, sf):
    s = M.path_stats(kept(spark, sf), ["symbol"], "et_date", "pos")
    return s.select("symbol", (F.col("total") / F.greatest(F.lit(0.01), F.abs("mdd"))).alias("score"))


@query("agg_44_journal_summary", "SELECT (SELECT count(*) FROM customer) AS n_runs, (SELECT max(o_orderdate) FROM orders) AS last_run, (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-25' - INTERVAL 7 DAY) AS n_orders_7d, (SELECT max(l_shipdate) FROM lineitem) AS last_equity_ts")
def agg_44(spark, sf):
    o = table(spark, sf, "orders", F.col("o_orderdate").alias("created_at"))
    c = table(spark, sf, "customer", "c_custkey").agg(F.count(F.lit(1)).alias("n_runs"))
    j = E.journal_summary(o.select(F.col("created_at").alias("started_at")), o, table(spark, sf, "lineitem", F.col("l_shipdate").alias("ts")), "2001-07-25 00:00:00")
    return j.withColumn("n_runs", c.scalar())


@query("agg_45_levered_folds", f"SELECT symbol, segment, lev, product(1 + lev * ret - (lev - 1) * 0.06 * 900 / 31536000) - 1 AS total FROM ({KEPT_S}), (SELECT unnest([1.0, 2.0]::DOUBLE[]) AS lev) GROUP BY 1, 2, 3", dbl="lev total", dp=7)
def agg_45(spark, sf):
    t = nm.grid(kept(spark, sf), lev=[1.0, 2.0])
    return t.groupBy("symbol", "segment", "lev").agg((F.product(1 + fin.levered(F.col("ret"), F.col("lev"), 0.06, F.lit(900))) - 1).alias("total"))


@query("agg_46_state_coverage", f"SELECT symbol, avg((l.et_date IS NOT NULL)::INT) AS coverage, count(*) FILTER (WHERE l.off) AS off_days FROM {{{{panel_day}}}} LEFT JOIN (SELECT symbol, et_date, s1_off AS off FROM ({SW}) WHERE volume >= 2) l USING (symbol, et_date) GROUP BY symbol", dbl="coverage")
def agg_46(spark, sf):
    s = R.bear_switches(v.panel_day(spark, sf), dd=-0.8)
    live = s.filter("volume >= 2").select("symbol", "et_date", F.col("s1_off").alias("off"))
    j = s.select("symbol", "et_date").join(live, ["symbol", "et_date"], "left")
    return j.groupBy("symbol").agg(F.avg(F.col("off").isNotNull().cast("int")).alias("coverage"), F.count(F.when(F.col("off"), 1)).alias("off_days"))


@query("agg_47_holding_metrics", f"""SELECT symbol, segment, count(*) AS n, avg(ret) * 1e4 AS exp_bp, avg((ret > 0)::INT) AS wr, quantile_cont(hold_days, 0.5) AS med_hold, max(hold_days) AS max_hold, min(eq / pk - 1) AS mdd FROM (SELECT *, max(eq) OVER (PARTITION BY symbol, segment ORDER BY entry_d) AS pk FROM (
    SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY symbol, segment ORDER BY entry_d)) AS eq FROM (SELECT *, CASE WHEN et_date >= DATE '1999-01-01' THEN 'valid' ELSE 'train' END AS segment FROM ({DSIM_S})))) GROUP BY 1, 2""", dbl="exp_bp wr med_hold mdd", dp=7)
def agg_47(spark, sf):
    t = dsim(spark, sf).withColumn("segment", F.when(F.col("et_date") >= F.lit("1999-01-01").cast("date"), "valid").otherwise("train"))
    s = M.path_stats(t, ["symbol", "segment"], "yr", "entry_d").select("symbol", "segment", "n", F.col("avg_bp").alias("exp_bp"), "wr", "mdd")
    h = t.groupBy("symbol", "segment").agg(F.percentile("hold_days", F.lit(0.5)).alias("med_hold"), F.max("hold_days").alias("max_hold"))
    return s.join(h, ["symbol", "segment"])
