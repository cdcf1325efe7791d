"""Join queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times as tm
from ..operators import asof as A
from ..operators import joins as J
from ..operators import rolling as R
from ..sources import readers as rd
from ..sources.tables import table
from . import views as v
from .registry import query
from .windows import DENSE, PW, SW, TRADES, bar_trades, daily_counts

DAYT = "SELECT symbol, et_date, d, open, close, CAST(et_date AS TIMESTAMP) + INTERVAL 14 HOUR + INTERVAL 30 MINUTE AS open_time, CAST(et_date AS TIMESTAMP) + INTERVAL 21 HOUR AS close_time FROM {{panel_day}}"


def days(spark, sf):
    """The panel with a session: opens 14:30 UTC, closes 21:00 UTC."""
    at = lambda m: tm.plus_seconds(F.col("et_date").cast("timestamp_ntz"), m * 60)
    return v.panel_day(spark, sf).select("symbol", "et_date", "d", "open", "close", at(870).alias("open_time"), at(1260).alias("close_time"))


@query("jn_01_asof_backward", f"""SELECT p.symbol, p.et_date, r.short_interest, CAST(epoch(p.close_time) - epoch(r.published) AS BIGINT) // 86400 AS stale_days
    FROM ({DAYT}) p ASOF LEFT JOIN {{{{releases}}}} r ON p.symbol = r.symbol AND p.close_time >= r.published""", dbl="short_interest", dp=6)
def jn_01(spark, sf):
    out = A.asof_backward(days(spark, sf), v.releases(spark, sf), "symbol", "close_time", "published", ["short_interest", "published"])
    return out.select("symbol", "et_date", "short_interest", F.floor((tm.seconds("close_time") - tm.seconds("published")) / 86400).alias("stale_days"))


@query("jn_02_act_day", f"""SELECT symbol, published, CASE WHEN act_et_date - pd <= 4 THEN act_et_date END AS act_et_date, CASE WHEN act_et_date - pd <= 4 THEN d END AS act_d FROM (
    SELECT r.symbol, r.published, r.et_date AS pd, p.et_date AS act_et_date, p.d FROM {{{{releases}}}} r ASOF LEFT JOIN ({DAYT}) p ON p.symbol = r.symbol AND p.open_time > r.published)""")
def jn_02(spark, sf):
    return J.act_day(v.releases(spark, sf), days(spark, sf), time="published", max_gap_days=4).select("symbol", "published", "act_et_date", "act_d")


@query("jn_02_next_bar", "SELECT e.event_id, b.ts AS bar_ts, b.open AS bar_open FROM events e ASOF LEFT JOIN {{bars_15m}} b ON b.symbol = e.event_type AND b.ts > e.ts")
def jn_02b(spark, sf):
    e = table(spark, sf, "events", "event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("t"))
    b = v.bars_15m(spark, sf).select("symbol", F.col("ts").alias("bar_ts"), F.col("open").alias("bar_open"))
    return A.asof_forward(e, b, "symbol", "t", "bar_ts", ["bar_ts", "bar_open"], unit="hour").select("event_id", "bar_ts", "bar_open")


MACRO = """SELECT symbol, obs_date, value, CAST(obs_date + INTERVAL 1 MONTH AS TIMESTAMP) + INTERVAL 12 HOUR AS available_from FROM (
    SELECT symbol, date_trunc('month', et_date)::DATE AS obs_date, avg(close) AS value FROM {{panel_day}} GROUP BY 1, 2)"""


def macro(spark, sf):
    m = v.panel_day(spark, sf).groupBy("symbol", F.trunc("et_date", "month").alias("obs_date")).agg(F.avg("close").alias("value"))
    return m.withColumn("available_from", tm.plus_seconds(F.add_months("obs_date", 1).cast("timestamp_ntz"), 12 * 3600))


MLAG = ", ".join(f"lag(value, {k}) OVER (PARTITION BY symbol ORDER BY available_from) AS value_lag{k}" for k in (6, 12, 18))
PHASES = f"""SELECT p.symbol, p.et_date, p.d, m.value, m.value_lag6, (m.value / m.value_lag12 - 1) * 100 AS yoy,
    CASE WHEN m.value_lag18 IS NULL THEN NULL WHEN (m.value / m.value_lag12 - 1) * 100 > (m.value_lag6 / m.value_lag18 - 1) * 100 THEN 'up' ELSE 'down' END AS direction
    FROM ({DAYT}) p ASOF LEFT JOIN (SELECT *, {MLAG} FROM ({MACRO})) m ON m.symbol = p.symbol AND p.close_time >= m.available_from"""


def phases(left, series):
    out = A.asof_with_lag(left, series, "symbol", "close_time", "available_from", "value", [6, 12, 18])
    yoy = (F.col("value") / F.col("value_lag12") - 1) * 100
    yoy6 = (F.col("value_lag6") / F.col("value_lag18") - 1) * 100
    return out.withColumn("yoy", yoy).withColumn("direction", F.when(F.col("value_lag18").isNotNull(), F.when(yoy > yoy6, "up").otherwise("down")))


@query("jn_03_asof_lag", PHASES, dbl="value value_lag6 yoy", dp=6)
def jn_03(spark, sf):
    return phases(days(spark, sf), macro(spark, sf)).select("symbol", "et_date", "d", "value", "value_lag6", "yoy", "direction")


@query("jn_04_asof_calendar_lag", f"""WITH a AS (SELECT p.symbol, p.et_date, p.close_time, r.short_interest AS now_si, r.published FROM ({DAYT}) p ASOF LEFT JOIN {{{{releases}}}} r ON r.symbol = p.symbol AND p.close_time >= r.published)
    SELECT a.symbol, a.et_date, now_si, r.short_interest AS old_si, (now_si / r.short_interest - 1) * 100 AS chg FROM (SELECT *, coalesce(published, close_time) - INTERVAL 42 DAY AS t0 FROM a) a ASOF LEFT JOIN {{{{releases}}}} r ON r.symbol = a.symbol AND a.t0 >= r.published""",
       dbl="now_si old_si chg", dp=6)
def jn_04(spark, sf):
    r = v.releases(spark, sf)
    a = A.asof_backward(days(spark, sf), r.withColumnRenamed("short_interest", "now_si"), "symbol", "close_time", "published", ["now_si", "published"])
    a = a.withColumn("t0", tm.plus_seconds(F.coalesce("published", "close_time"), -42 * 86400)).drop("published")
    b = A.asof_backward(a, r.withColumnRenamed("short_interest", "old_si"), "symbol", "t0", "published", ["old_si"])
    return b.select("symbol", "et_date", "now_si", "old_si", ((F.col("now_si") / F.col("old_si") - 1) * 100).alias("chg"))


@query("jn_05_range_counts", """SELECT b.symbol, b.ts, count(e.event_id) AS n, coalesce(sum(e.value), 0) AS total FROM {{bars_1h}} b LEFT JOIN
    (SELECT *, event_type AS symbol FROM {{dated}}) e ON e.symbol = b.symbol AND e.observed_time > b.ts - INTERVAL 30 HOUR AND e.observed_time <= b.ts GROUP BY 1, 2""", dbl="total", dp=4)
def jn_05(spark, sf):
    b = v.bars_1h(spark, sf).select("symbol", "ts", tm.plus_seconds("ts", -30 * 3600).alias("t0"))
    e = v.dated(spark, sf).select(F.col("event_type").alias("symbol"), "observed_time", "event_id", "value", F.lit(1).alias("one"))
    out = A.range_count(b, e, "symbol", "t0", "ts", "observed_time", {"n": "one", "total": "value"}, unit="minute")
    return out.select("symbol", "ts", F.col("n").cast("bigint").alias("n"), "total")


JUMPS = f"SELECT r.symbol, r.published AS time, p.d AS act FROM (SELECT * FROM {{{{releases}}}} WHERE change_pct >= 30) r ASOF JOIN ({DAYT}) p ON p.symbol = r.symbol AND p.open_time > r.published"
DENSE_EV = f"SELECT e.symbol, e.et_date, e.time, p.d AS act FROM (SELECT symbol, et_date, CAST(et_date AS TIMESTAMP) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE AS time FROM ({DENSE}) WHERE dense) e ASOF JOIN ({DAYT}) p ON p.symbol = e.symbol AND p.open_time > e.time"


def jump_events(spark, sf, lo=30.0, hi=None):
    r = v.releases(spark, sf).filter(F.col("change_pct") >= lo)
    a = J.act_day(r.select("symbol", F.col("published").alias("time")), days(spark, sf), time="time")
    return a.filter("act_d is not null").select("symbol", "time", F.col("act_d").alias("act"))


def dense_events(spark, sf):
    dn = R.density_threshold(daily_counts(spark, sf)).filter("dense")
    dn = dn.select("symbol", "et_date", tm.plus_seconds(F.col("et_date").cast("timestamp_ntz"), 86340).alias("time"))
    return J.act_day(dn, days(spark, sf), time="time").filter("act_d is not null").select("symbol", "et_date", "time", F.col("act_d").alias("act"))


@query("jn_06_precursor_flag", f"""SELECT e.symbol, e.et_date, e.act, EXISTS (SELECT 1 FROM ({JUMPS}) j WHERE j.symbol = e.symbol AND j.time < e.time AND j.act >= e.act - 20) AS has_pre FROM ({DENSE_EV}) e""")
def jn_06(spark, sf):
    return J.precursor(dense_events(spark, sf), jump_events(spark, sf), 20).select("symbol", "et_date", "act", "has_pre")


@query("jn_07_precursor_gap", f"""SELECT e.symbol, e.et_date, min(e.act - j.act) AS gap FROM ({DENSE_EV}) e LEFT JOIN ({JUMPS}) j ON j.symbol = e.symbol AND j.time < e.time AND j.act >= e.act - 30 GROUP BY 1, 2""")
def jn_07(spark, sf):
    return J.precursor(dense_events(spark, sf), jump_events(spark, sf), 30).select("symbol", "et_date", "gap")


@query("jn_09_inner_bars", "SELECT f.symbol, c.ts AS signal_ts, f.ts, f.close FROM {{bars_1h}} c JOIN {{bars_15m}} f ON f.symbol = c.symbol AND f.et_date = c.et_date AND f.ts >= c.ts + INTERVAL 1 HOUR AND f.ts < c.ts + INTERVAL 2 HOUR")
def jn_09(spark, sf):
    return J.next_bucket_bars(v.bars_1h(spark, sf), v.bars_15m(spark, sf), 60).select("symbol", "signal_ts", "ts", "close")


@query("jn_10_entry_bar", """SELECT symbol, ts, entry_ts, entry_open FROM (SELECT c.symbol, c.ts, c.et_date, f.ts AS entry_ts, f.open AS entry_open, f.et_date AS fd FROM {{bars_1h}} c ASOF JOIN {{bars_15m}} f ON f.symbol = c.symbol AND f.ts >= c.ts + INTERVAL 1 HOUR) WHERE fd = et_date""")
def jn_10(spark, sf):
    return J.entry_bar(v.bars_1h(spark, sf), v.bars_15m(spark, sf), 60).select("symbol", "ts", "entry_ts", "entry_open")


@query("jn_11_day_flag", f"SELECT t.symbol, t.ts, coalesce(f.flag, false) AS flag FROM ({TRADES}) t LEFT JOIN (SELECT symbol, et_date, close < open AS flag FROM {{{{bars_day}}}} WHERE high > 2 * open) f USING (symbol, et_date)")
def jn_11(spark, sf):
    f = v.bars_day(spark, sf).filter("high > 2 * open").withColumn("flag", F.col("close") < F.col("open"))
    return J.by_day_flag(bar_trades(spark, sf), f, "flag", False).select("symbol", "ts", "flag")


@query("jn_12_exact_lookup", "SELECT b.symbol, b.ts, b.close AS bar_close FROM {{bars_1h}} b WHERE b.volume >= 3")
def jn_12(spark, sf):
    ev = v.bars_1h(spark, sf).filter("volume >= 3").select("symbol", "ts")
    return J.exact_lookup(ev, v.bars_1h(spark, sf)).select("symbol", "ts", "bar_close")


@query("jn_13_anti_join", "SELECT event_id, source_id FROM {{dated}} WHERE event_id NOT IN (SELECT event_id FROM {{dated}} WHERE value > 20)")
def jn_13(spark, sf):
    d = v.dated(spark, sf)
    done = d.filter("value > 20").select("event_id")
    return d.join(done, "event_id", "left_anti").select("event_id", "source_id")


v.VIEWS["chain"] = """SELECT snapshot_date, expiration, opt_right, strike, opt_right || '_' || expiration || '_' || strike AS contract, volume, oi, iv,
    opt_right = 'C' AND strike < 90 + extract(day FROM snapshot_date) OR opt_right = 'P' AND strike > 90 + extract(day FROM snapshot_date) AS in_the_money FROM (
    SELECT DATE '2024-01-01' + CAST(l_orderkey % 10 AS INTEGER) AS snapshot_date, DATE '2024-01-01' + CAST(25 + 15 * (l_suppkey % 3) AS INTEGER) AS expiration,
    CASE WHEN l_linenumber % 2 = 0 THEN 'C' ELSE 'P' END AS opt_right, 60 + l_partkey % 80 AS strike, sum(l_quantity) AS volume, CAST(floor(sum(l_extendedprice) / 1000) AS BIGINT) AS oi,
    0.05 + 5 * avg(l_discount) AS iv FROM lineitem GROUP BY 1, 2, 3, 4)"""


def chain(spark, sf):
    l = table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    d0 = F.lit("2024-01-01").cast("date")
    g = l.groupBy(
        F.date_add(d0, (F.col("l_orderkey") % 10).cast("int")).alias("snapshot_date"), F.date_add(d0, (25 + 15 * (F.col("l_suppkey") % 3)).cast("int")).alias("expiration"),
        F.when(F.col("l_linenumber") % 2 == 0, "C").otherwise("P").alias("opt_right"), (60 + F.col("l_partkey") % 80).alias("strike")).agg(
        F.sum("l_quantity").alias("volume"), F.floor(F.sum("l_extendedprice") / 1000).alias("oi"), (0.05 + 5 * F.avg("l_discount")).alias("iv"))
    spot = 90 + F.dayofmonth("snapshot_date")
    itm = ((F.col("opt_right") == "C") & (F.col("strike") < spot)) | ((F.col("opt_right") == "P") & (F.col("strike") > spot))
    return g.withColumn("contract", F.concat_ws("_", "opt_right", F.col("expiration").cast("string"), F.col("strike").cast("string"))).withColumn("in_the_money", itm)


@query("jn_14_oi_changes", """WITH e AS (SELECT max(snapshot_date) AS cur FROM {{chain}}), p AS (SELECT max(snapshot_date) AS prev FROM {{chain}}, e WHERE snapshot_date < cur)
    SELECT a.contract, a.oi AS oi_now, a.oi - coalesce(b.oi, 0) AS d_oi FROM {{chain}} a JOIN e ON a.snapshot_date = e.cur LEFT JOIN (SELECT c.* FROM {{chain}} c JOIN p ON c.snapshot_date = p.prev) b ON b.contract = a.contract
    ORDER BY abs(a.oi - coalesce(b.oi, 0)) DESC, a.contract LIMIT 5""")
def jn_14(spark, sf):
    return J.oi_changes(chain(spark, sf))


@query("jn_15_source_tier", "SELECT event_id, source_id, CASE source_id WHEN 'edgar' THEN 'T1' WHEN 'edgar_t0' THEN 'T0' WHEN 'x_nitter' THEN 'T3' END AS tier FROM {{dated}}")
def jn_15(spark, sf):
    src = spark.createDataFrame([("edgar", "T1"), ("edgar_t0", "T0"), ("x_nitter", "T3")], "source_id string, tier string")  # one row per source
    return v.dated(spark, sf).drop("tier").join(F.broadcast(src), "source_id", "left").select("event_id", "source_id", "tier")


v.VIEWS["interps"] = """SELECT event_id, observed_time AS created, CASE event_id % 4 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS direction FROM {{dated}} WHERE tier <> 'T3'"""


def interps(spark, sf):
    k = F.col("event_id") % 4
    return v.dated(spark, sf).filter("tier <> 'T3'").select("event_id", F.col("observed_time").alias("created"), F.when(k == 0, "bullish").when(k == 1, "bearish").otherwise("neutral").alias("direction"))


@query("jn_16_score_join", """SELECT s.event_id, s.score_1d, e.type, i.direction FROM (SELECT event_id, CASE WHEN value > 20 THEN 'hit' ELSE 'miss' END AS score_1d, observed_time AS scored_at FROM {{dated}} WHERE tier = 'T1') s
    JOIN {{dated}} e USING (event_id) JOIN {{interps}} i USING (event_id) ORDER BY scored_at DESC, s.event_id DESC LIMIT 5""")
def jn_16(spark, sf):
    d = v.dated(spark, sf)
    s = d.filter("tier = 'T1'").select("event_id", F.when(F.col("value") > 20, "hit").otherwise("miss").alias("score_1d"), F.col("observed_time").alias("scored_at"))
    j = s.join(d.select("event_id", "type"), "event_id").join(interps(spark, sf).select("event_id", "direction"), "event_id")
    return j.orderBy(F.desc("scored_at"), F.desc("event_id")).limit(5).select("event_id", "score_1d", "type", "direction")


def two_streams(spark, sf):
    t = v.with_pos(v.bars_1h(spark, sf)).select("symbol", F.col("ts").alias("entry_time"), "pos", F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("direction"), (F.col("close") / F.col("open") - 1).alias("ret"), "volume")
    a = t.filter("volume > 1")
    b = t.filter("ret <> 0").withColumn("direction", F.when(F.col("pos") % 19 == 0, -F.col("direction")).otherwise(F.col("direction"))).withColumn("ret", F.when(F.col("pos") % 11 == 0, F.col("ret") + 0.001).otherwise(F.col("ret")))
    return a, b


STREAMS = """WITH t AS (SELECT symbol, ts AS entry_time, pos, volume, CASE WHEN close > open THEN 1 ELSE -1 END AS direction, close / open - 1 AS ret FROM {{bars_1h}}), a AS (SELECT * FROM t WHERE volume > 1),
    b AS (SELECT symbol, entry_time, pos, CASE WHEN pos % 19 = 0 THEN -direction ELSE direction END AS direction, CASE WHEN pos % 11 = 0 THEN ret + 0.001 ELSE ret END AS ret FROM t WHERE ret <> 0) """


@query("jn_17_trade_diff", STREAMS + """SELECT symbol, entry_time, CASE WHEN b.ret IS NULL THEN 'only_a' WHEN a.ret IS NULL THEN 'only_b' WHEN a.direction <> b.direction THEN 'direction' WHEN abs(a.ret - b.ret) >= 1e-9 THEN 'ret' ELSE 'same' END AS status
    FROM a FULL JOIN b USING (symbol, entry_time)""")
def jn_17(spark, sf):
    return J.trade_diff(*two_streams(spark, sf), ["symbol", "entry_time"]).select("symbol", "entry_time", "status")


@query("jn_18_prob_parity", """WITH r AS (SELECT symbol, et_date, (event_id % 1000) / 1000.0 AS prob FROM (SELECT t.*, date_trunc('hour', ts) AS et_date FROM {{ticks}} t) WHERE price >= 15),
    n AS (SELECT symbol, et_date, (event_id % 997) / 997.0 AS prob FROM (SELECT t.*, date_trunc('hour', ts) AS et_date FROM {{ticks}} t) WHERE price < 15)
    SELECT count(*) AS n_ref, max(diff) AS max_diff, count(*) FILTER (WHERE diff IS NULL) AS missing FROM (SELECT r.symbol, r.et_date, r.prob, min(abs(r.prob - n.prob)) AS diff FROM r LEFT JOIN n USING (symbol, et_date) GROUP BY ALL)""", dbl="max_diff")
def jn_18(spark, sf):
    t = v.ticks(spark, sf).withColumn("et_date", F.date_trunc("hour", "ts"))
    r = t.filter("price >= 15").select("symbol", "et_date", (F.col("event_id") % 1000 / 1000.0).alias("prob"))
    n = t.filter("price < 15").select("symbol", "et_date", (F.col("event_id") % 997 / 997.0).alias("prob"))
    return J.prob_parity(r, n, ["symbol", "et_date"])


@query("jn_19_divergence", f"""SELECT symbol, count(*) FILTER (WHERE a <> 'CALIBRATING' AND a <> b) AS n_diverged, count(*) FILTER (WHERE a = 'CALIBRATING') AS n_calibrating, count(*) AS n_days FROM (
    SELECT symbol, CASE WHEN d < 252 THEN 'CALIBRATING' WHEN s2_off THEN 'RISK_OFF' ELSE 'RISK_ON' END AS a, CASE WHEN s1_off THEN 'RISK_OFF' ELSE 'RISK_ON' END AS b FROM ({SW})) GROUP BY symbol""")
def jn_19(spark, sf):
    s = R.bear_switches(v.panel_day(spark, sf), dd=-0.8)
    on = lambda c: F.when(F.col(c), "RISK_OFF").otherwise("RISK_ON")
    main = s.select("symbol", "et_date", F.when(F.col("d") < 252, "CALIBRATING").otherwise(on("s2_off")).alias("state"))
    return J.divergence(main, s.select("symbol", "et_date", on("s1_off").alias("state")))


@query("jn_20_position", "SELECT o_orderpriority AS symbol, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS position FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1", dbl="position")
def jn_20(spark, sf):
    f = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_quantity").groupBy("l_orderkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("q"))
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority")
    return f.join(o, f.l_orderkey == o.o_orderkey).groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.sum("q").alias("position"))


@query("jn_21_merge_states", f"""SELECT symbol, et_date, CASE WHEN l.state IS NOT NULL THEN 'live' WHEN h.state IS NOT NULL AND NOT h.blind THEN 'history' ELSE 'blind' END AS src, coalesce(l.state, h.state, '') AS state
    FROM {{{{panel_day}}}} LEFT JOIN (SELECT symbol, et_date, CASE WHEN s2_off THEN 'risk_off' ELSE 'risk_on' END AS state, d % 10 = 0 AS blind FROM ({SW}) WHERE et_date < DATE '1999-01-01' AND volume >= 2) h USING (symbol, et_date)
    LEFT JOIN (SELECT symbol, et_date, CASE WHEN s1_off THEN 'risk_off' ELSE 'risk_on' END AS state FROM ({SW}) WHERE et_date >= DATE '1998-10-01' AND volume >= 3) l USING (symbol, et_date)""")
def jn_21(spark, sf):
    s = R.bear_switches(v.panel_day(spark, sf), dd=-0.8)
    on = lambda c: F.when(F.col(c), "risk_off").otherwise("risk_on").alias("state")
    h = s.filter("et_date < date'1999-01-01' AND volume >= 2").select("symbol", "et_date", on("s2_off"), (F.col("d") % 10 == 0).alias("blind"))
    l = s.filter("et_date >= date'1998-10-01' AND volume >= 3").select("symbol", "et_date", on("s1_off"))
    return J.merge_states(s.select("symbol", "et_date"), h, l)


@query("jn_22_nearest_vectors", """WITH p AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest([x::DOUBLE FOR x IN embedding]) AS y FROM embeddings),
    x AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 7 <> 0 THEN y END AS x FROM p), m AS (SELECT i, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM x GROUP BY i),
    c AS (SELECT i, x AS c FROM x WHERE vec_id = (SELECT max(vec_id) FROM embeddings))
    SELECT vec_id, sqrt(sum(pow((x - c) / sd, 2)) * count(*) / count(x - c)) AS dist FROM x JOIN m USING (i) JOIN c USING (i) WHERE vec_id <> (SELECT max(vec_id) FROM embeddings) GROUP BY vec_id HAVING count(x - c) > 0 ORDER BY dist, vec_id LIMIT 3""", dbl="dist", dp=6)
def jn_22(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    p = e.select("vec_id", F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 7 != 0, x.cast("double"))).alias("x"))
    return J.nearest_vectors(p, "vec_id", "x")


LOWS = f"SELECT symbol, d, et_date, close FROM (SELECT *, count(*) OVER w AS c, min(close) OVER w AS m FROM {{{{panel_day}}}} WINDOW w AS ({PW} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) WHERE close <= m"


def lows(spark, sf):
    w = W.partitionBy("symbol").orderBy("et_date").rowsBetween(-10, 10)
    return v.panel_day(spark, sf).withColumn("m", F.min("close").over(w)).filter("close <= m").drop("m")


@query("jn_23_nearest_point", f"""WITH b AS (SELECT symbol, d, close / max(close) OVER ({PW} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) - 1 AS dd FROM {{{{panel_day}}}})
    SELECT b.symbol, b.d, dd, arg_min(b.d - l.d, (abs(b.d - l.d), l.d)) AS distance FROM b JOIN ({LOWS}) l ON l.symbol = b.symbol GROUP BY 1, 2, 3""", dbl="dd", dp=8)
def jn_23(spark, sf):
    w = W.partitionBy("symbol").orderBy("et_date").rowsBetween(-60, -1)
    b = v.panel_day(spark, sf).withColumn("dd", F.col("close") / F.max("close").over(w) - 1).select("symbol", "d", "dd")
    return J.nearest_point(b, lows(spark, sf))


@query("jn_24_phases_at_points", f"SELECT q.symbol, q.et_date, q.yoy, q.direction FROM ({PHASES}) q JOIN ({LOWS}) l USING (symbol, d)", dbl="yoy", dp=6)
def jn_24(spark, sf):
    pts = days(spark, sf).join(lows(spark, sf).select("symbol", "d"), ["symbol", "d"], "left_semi")
    return phases(pts, macro(spark, sf)).select("symbol", "et_date", "yoy", "direction")


from .projections import FIXED, SPLITS  # noqa: E402


@query("jn_25_before_after", f"""SELECT symbol, yr, mean_old, mean_new, mean_new - mean_old AS mean_delta FROM (SELECT symbol, year(et_date) AS yr, avg(change_raw) AS mean_old, avg(change_pct) AS mean_new FROM ({FIXED}) GROUP BY 1, 2) WHERE abs(mean_new - mean_old) > 1e-9""", dbl="mean_old mean_new mean_delta", dp=6)
def jn_25(spark, sf):
    from ..operators.adjust import correct_change

    r = correct_change(v.releases(spark, sf), SPLITS).withColumn("yr", F.year("et_date"))
    m = lambda c: r.groupBy("symbol", "yr").agg(F.avg(c).alias("mean"))
    return J.before_after(m("change_raw"), m("change_pct"), ["symbol", "yr"], ["mean"])


@query("jn_26_merge_prices", """WITH h AS (SELECT symbol, et_date, close FROM {{bars_day}} WHERE et_date < DATE '2024-01-20'), n AS (SELECT symbol, et_date, CASE WHEN symbol = 'click' THEN close * 2 ELSE close END AS close FROM {{bars_day}} WHERE et_date >= DATE '2024-01-10'),
    k AS (SELECT symbol, max(et_date) AS last_day, arg_max(close, et_date) AS lc FROM h GROUP BY symbol), c AS (SELECT k.symbol, last_day, coalesce(abs(n.close / lc - 1) > 0.01, false) AS broken FROM k LEFT JOIN n ON n.symbol = k.symbol AND n.et_date = last_day)
    SELECT h.*, 'history' AS src FROM h JOIN c USING (symbol) WHERE NOT broken UNION ALL SELECT n.*, 'newer' FROM n LEFT JOIN c USING (symbol) WHERE last_day IS NULL OR broken OR n.et_date > last_day""".replace("SELECT h.*", "SELECT h.symbol, h.et_date, h.close").replace("SELECT n.*", "SELECT n.symbol, n.et_date, n.close"), dbl="close")
def jn_26(spark, sf):
    d = v.bars_day(spark, sf).select("symbol", "et_date", "close")
    n = d.filter("et_date >= date'2024-01-10'").withColumn("close", F.when(F.col("symbol") == "click", F.col("close") * 2).otherwise(F.col("close")))
    return J.merge_prices(d.filter("et_date < date'2024-01-20'"), n)


@query("jn_27_recent_jumps", f"""SELECT q.symbol, q.et_date, r.published, r.change_pct, r.change_pct >= 80 AS suspect FROM ({DAYT}) q JOIN (SELECT r.*, p.d AS act FROM {{{{releases}}}} r ASOF JOIN ({DAYT}) p ON p.symbol = r.symbol AND p.open_time > r.published) r
    ON r.symbol = q.symbol AND r.act <= q.d AND q.d - r.act <= 20 WHERE r.change_pct >= 10""", dbl="change_pct", dp=6)
def jn_27(spark, sf):
    dd = days(spark, sf)
    a = J.act_day(v.releases(spark, sf).drop("et_date", "d"), dd, time="published")
    return J.recent_jumps(a, dd).select("symbol", "et_date", "published", "change_pct", "suspect")
