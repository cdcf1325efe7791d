"""Streaming queries, run to completion over the tables and compared with the batch SQL."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing as hs
from ..functions import times as tm
from ..sources.tables import table
from ..streaming import jobs as J
from . import sequences as q
from . import views as v
from .joins import chain
from .registry import query
from .windows import BW, PW


def event_stream(spark, sf):
    return J.source(spark, f"{sf}/events[.]parquet", table(spark, sf, "events").schema)


@query("str_01_first_seen", """SELECT substr(sha256(source_id || '|' || event_id), 1, 16) AS event_id, observed_time, type FROM {{dated}}""")
def str_01(spark, sf):
    """Every event is polled three times, later copies with later observation times."""
    d = v.dated(spark, sf)
    late = d.withColumn("observed_time", F.explode(F.array(*[tm.plus_seconds("observed_time", s) for s in (0, 60, 7200)])))
    s = J.as_stream(late.select(hs.event_id(F.col("source_id"), F.col("event_id").cast("string")).alias("event_id"), "observed_time", "type", tm.micros("observed_time").alias("us")), "us")
    return J.ingest_first_seen(s).drop("us")


@query("str_02_live_bars", "SELECT symbol, ts, open, high, low, close, volume FROM {{bars_15m}} WHERE ts + INTERVAL 15 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM {{ticks}})")
def str_02(spark, sf):
    e = event_stream(spark, sf).filter("value > 0").select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
    return J.drain(J.live_bars(e), "bars")


def bar_stream(spark, sf):
    b = v.bars_15m(spark, sf).select("symbol", tm.micros("ts").alias("us"), F.unix_date("et_date").alias("day"), "close", (tm.micros("ts") + 900_000_000 + (tm.micros("ts") / 1_000_000 % 97 * 1_000_000).cast("bigint")).alias("received_us"))
    # batches bring bars up to eight hours out of order
    b = J.with_clock(b, delay_ms=LATE).withColumn("seen", F.when(F.col("symbol") == J.CLOCK, F.col("us")).otherwise(F.col("us") + F.pmod(F.xxhash64("symbol", "us"), F.lit(LATE * 1000))))
    return J.as_stream(b, "seen")


#: Milliseconds that a bar may come late.
LATE = 8 * 3_600_000
BAR = "us:bigint,day:int,close:double,received_us:bigint"


@query("str_03_gap_monitor", """SELECT symbol, ts, CAST(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol, et_date ORDER BY ts))) // 900000000 - 1, 0) AS BIGINT) AS missing, (epoch_us(ts) // 1000000) % 97 AS lag_s FROM {{bars_15m}}""", dbl="lag_s")
def str_03(spark, sf):
    return J.drain(J.in_order(bar_stream(spark, sf), J.GapMonitor(900_000_000), BAR, delay_ms=LATE), "gaps").select("symbol", tm.from_micros(F.col("us")).alias("ts"), "missing", "lag_s")


@query("str_04_momentum_stream", "SELECT symbol, ts, ret, CASE WHEN ret > 0 THEN 1 ELSE -1 END AS direction FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol, et_date ORDER BY ts) - 1 AS ret FROM {{bars_15m}}) WHERE abs(ret) >= 0.3", dbl="ret")
def str_04(spark, sf):
    return J.drain(J.in_order(bar_stream(spark, sf), J.MomentumSignal(0.3), BAR, delay_ms=LATE), "signals").select("symbol", tm.from_micros(F.col("us")).alias("ts"), "ret", "direction")


#: Days in a slot of the detector's stream; a state that runs out turns when the slot of that day is over.
DAYS = 16


@query("str_05_detector_machine", f"""WITH det AS MATERIALIZED ({q.DET}) SELECT symbol, d, state FROM (SELECT *, lag(state) OVER ({PW}) AS ps FROM det) WHERE ps IS NULL OR ps <> state
    UNION ALL SELECT symbol, due AS d, 'RISK_ON' AS state FROM (SELECT symbol, max(d) AS last, arg_max(state, d) AS state, max(d) FILTER (WHERE triggered) + 20 AS due FROM det GROUP BY symbol)
    WHERE state = 'RISK_OFF' AND due // {DAYS} < (SELECT max(d) FROM det) // {DAYS}""")
def str_05(spark, sf):
    from ..operators import states as ST

    # the daily inputs of the machine: whether the day had any count, and whether both legs fired
    s = ST.detector_daily(q.days(spark, sf), q.blind_counts(spark, sf), q.credible_jumps(spark, sf), calib=0)
    w = W.partitionBy("symbol").orderBy("d")
    s = s.select("symbol", "d", F.col("triggered").alias("hit"), (F.coalesce(F.lead("n_eff_before").over(w), F.col("n_eff_before")) > F.col("n_eff_before")).alias("valid"))
    # a day of the machine is a day of event time; days come up to five out of order
    unit = {"time": "d", "per_ms": 1 / 86_400_000, "slot_ms": DAYS * 86_400_000, "delay_ms": 5 * 86_400_000, "base_ms": DAYS * 86_400_000}
    late = J.with_clock(s, **unit).withColumn("seen", F.when(F.col("symbol") == J.CLOCK, F.col("d")).otherwise(F.col("d") + F.pmod(F.xxhash64("symbol", "d"), F.lit(5))))
    return J.drain(J.in_order(J.as_stream(late, "seen"), J.DetectorMachine(), "d:bigint,hit:boolean,valid:boolean", **unit), "detector")


@query("str_06_trough_confirm", f"""SELECT symbol, ts AS trough_ts, cts AS confirm_ts, (top - close) / top AS drop FROM (SELECT *, (SELECT max(b.close) FROM {{{{bars_15m}}}} b WHERE b.symbol = m.symbol AND b.et_date = m.et_date AND b.pos <= m.pos) AS top FROM (
    SELECT *, count(*) OVER w = 6 AND close <= min(close) OVER w AS is_trough, lead(ts, 2) OVER ({BW}) AS cts FROM {{{{bars_15m}}}} WINDOW w AS ({BW} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)) m WHERE is_trough) WHERE (top - close) / top >= 0.3""", dbl="drop")
def str_06(spark, sf):
    out = J.drain(J.in_order(bar_stream(spark, sf), J.TroughConfirm(), BAR, delay_ms=LATE), "troughs")
    return out.select("symbol", tm.from_micros(F.col("trough_us")).alias("trough_ts"), tm.from_micros(F.col("confirm_us")).alias("confirm_ts"), "drop")


@query("str_08_heartbeats", """SELECT component, last_ts, age_min, CASE component WHEN 'click' THEN 150.0 WHEN 'error' THEN 600.0 ELSE 240.0 END AS threshold_min, age_min > CASE component WHEN 'click' THEN 150.0 WHEN 'error' THEN 600.0 ELSE 240.0 END AS stale FROM (
    SELECT event_type AS component, max(ts) AS last_ts, (epoch_us(TIMESTAMP '2024-01-31 03:00:00') - epoch_us(max(ts))) / 60000000.0 AS age_min FROM events GROUP BY 1)""", dbl="age_min threshold_min", dp=6)
def str_08(spark, sf):
    s = event_stream(spark, sf).select(F.col("event_type").alias("component"), "ts")
    return J.heartbeats(s, "2024-01-31 03:00:00", False, {"click": (45, 150), "error": (300, 600)}, (120, 240))


@query("str_09_posts_per_day", """SELECT et_date, CASE WHEN c.d IS NOT NULL THEN n END AS n FROM {{posts_daily}} LEFT JOIN (SELECT DISTINCT CAST((polled_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS d FROM {{polls}} WHERE source_id = 'x_nitter' AND ok AND extract(day FROM polled_at) % 5 <> 0) c ON c.d = et_date
    WHERE et_date + 1 <= (SELECT max((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') - INTERVAL 1 HOUR FROM events WHERE event_type = 'view')""")
def str_09(spark, sf):
    s = event_stream(spark, sf).filter("event_type = 'view'").select("ts")
    n = J.drain(J.posts_per_day(s), "posts")
    p = v.polls(spark, sf).withColumn("ok", F.col("ok") & (F.dayofmonth("polled_at") % 5 != 0))
    return J.with_coverage(n, p, "x_nitter")


@query("str_10_upsert_sources", "SELECT event_type || '_' || (user_id % 10) AS source_id, arg_max('T' || (event_id % 4), {'t': ts, 'e': event_id}) AS tier, arg_min(value, {'t': ts, 'e': event_id}) AS weight, max(ts) AS updated FROM events GROUP BY 1", dbl="weight")
def str_10(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat_ws("_", "event_type", (F.col("user_id") % 10).cast("string")).alias("source_id"), F.concat(F.lit("T"), (F.col("event_id") % 4).cast("string")).alias("tier"),
        F.col("value").alias("weight"), "ts", "event_id")
    return J.upsert_sources(J.as_stream(e, "event_id"))


@query("str_11_upsert_latest", "SELECT snapshot_date, contract, arg_max(oi, rev) AS oi, max(rev) AS rev FROM (SELECT snapshot_date, contract, oi * r AS oi, r AS rev FROM {{chain}}, (SELECT unnest([1, 2, 3]) AS r)) GROUP BY 1, 2")
def str_11(spark, sf):
    c = chain(spark, sf).withColumn("rev", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select("snapshot_date", "contract", (F.col("oi") * F.col("rev")).alias("oi"), "rev")
    return J.upsert_latest(J.as_stream(c, "rev", 3), ["snapshot_date", "contract"], ["rev"])
