"""Trading-calendar queries. Order dates are moved 31 years on, so they meet the years with a holiday table."""

from pyspark.sql import functions as F

from ..functions import times as tm
from ..operators import calendar as C
from ..sources.tables import table
from . import views as v
from .registry import query

HOL = ", ".join(f"DATE '{h}'" for h in C.HOLIDAYS)
HALF = ", ".join(f"DATE '{h}'" for h in C.HALF_DAYS)
CAL = f"""cal AS (SELECT d, op, half, CASE WHEN op THEN row_number() OVER (PARTITION BY op ORDER BY d) END AS o,
    ((d::TIMESTAMP + INTERVAL 9 HOUR + INTERVAL 30 MINUTE) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS open_ts,
    ((d::TIMESTAMP + CASE WHEN half THEN INTERVAL 13 HOUR ELSE INTERVAL 16 HOUR END) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS close_ts FROM (
    SELECT d, isodow(d) < 6 AND d NOT IN ({HOL}) AS op, d IN ({HALF}) AS half FROM (SELECT CAST(unnest(generate_series(DATE '2025-06-01', DATE '2033-12-31', INTERVAL 1 DAY)) AS DATE) AS d)))"""
DATES = "dd AS (SELECT DISTINCT CAST(o_orderdate + INTERVAL 31 YEAR AS DATE) AS d0 FROM orders)"


def cal(spark):
    return C.calendar(spark, "2025-06-01", "2033-12-31")


def dates(spark, sf, *more):
    return table(spark, sf, "orders", F.to_date(F.add_months("o_orderdate", 372)).alias("d0"), *more).distinct()


@query("cal_01_is_trading_day", f"WITH {CAL}, {DATES} SELECT d0, op AS is_trading FROM dd JOIN cal ON d = d0")
def cal_01(spark, sf):
    return C.is_trading_day(dates(spark, sf), cal(spark), "d0")


@query("cal_02_next_prev_day", f"WITH {CAL}, {DATES} SELECT d0, (SELECT min(d) FROM cal WHERE op AND d > d0) AS next_day, (SELECT max(d) FROM cal WHERE op AND d < d0) AS prev_day FROM dd")
def cal_02(spark, sf):
    return C.next_prev(dates(spark, sf), cal(spark), "d0").select("d0", "next_day", "prev_day")


@query("cal_03_add_trading_days", f"""WITH {CAL}, {DATES} SELECT d0, n, cal.d AS d1 FROM (SELECT d0, n, CASE WHEN n >= 0 THEN (SELECT min(o) FROM cal WHERE op AND d >= d0) ELSE (SELECT max(o) FROM cal WHERE op AND d <= d0) END + n AS t
    FROM dd, (SELECT unnest([-3, 0, 9, 20]) AS n)) JOIN cal ON cal.o = t""")
def cal_03(spark, sf):
    from ..functions.numeric import grid

    return C.add_trading_days(grid(dates(spark, sf), n=[-3, 0, 9, 20]), cal(spark), "d0", F.col("n"), "d1")


@query("cal_04_trading_days_between", f"""WITH {CAL}, s AS (SELECT DISTINCT CAST(l_shipdate + INTERVAL 31 YEAR AS DATE) AS a, CAST(o_orderdate + INTERVAL 31 YEAR AS DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    c AS (SELECT d, count(*) FILTER (WHERE op) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM cal)
    SELECT a, b, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0) AS n_days FROM s JOIN c x ON x.d = a JOIN c y ON y.d = b""")
def cal_04(spark, sf):
    l = table(spark, sf, "lineitem", "l_orderkey", "l_shipdate").join(table(spark, sf, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    s = l.select(F.to_date(F.add_months("l_shipdate", 372)).alias("a"), F.to_date(F.add_months("o_orderdate", 372)).alias("b")).distinct()
    return C.days_between(s, cal(spark), "a", "b", "n_days")


@query("cal_05_close_time", f"WITH {CAL}, {DATES} SELECT d0, CASE WHEN half THEN 780 ELSE 960 END AS close_min FROM dd JOIN cal ON d = d0")
def cal_05(spark, sf):
    return C.close_time(dates(spark, sf), cal(spark), "d0")


EV = "ev AS (SELECT event_id, ts + INTERVAL 1050 DAY AS a, ts + INTERVAL 1050 DAY + to_seconds((event_id * 7919) % 864000) AS b FROM events)"


def shifted_events(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts")
    a = tm.plus_seconds("ts", 1050 * 86400)
    return e.select("event_id", a.alias("a"), tm.plus_seconds(a, (F.col("event_id") * 7919) % 864000).alias("b"))


@query("cal_06_sessions_completed", f"WITH {CAL}, {EV} SELECT event_id, (SELECT count(*) FROM cal WHERE op AND close_ts > a AND close_ts <= b) AS n_sessions FROM ev")
def cal_06(spark, sf):
    return C.sessions_completed(shifted_events(spark, sf), cal(spark), "a", "b", "n_sessions").select("event_id", "n_sessions")


@query("cal_07_next_settlement", f"""WITH {CAL}, {DATES}, c AS (SELECT d0, unnest([date_trunc('month', d0)::DATE + 14, last_day(d0), (date_trunc('month', d0) + INTERVAL 1 MONTH)::DATE + 14, last_day((d0 + INTERVAL 1 MONTH)::DATE)]) AS c0 FROM dd),
    s AS (SELECT d0, min(st) AS settlement FROM (SELECT d0, (SELECT max(d) FROM cal WHERE op AND d <= c0) AS st FROM c) WHERE st > d0 GROUP BY d0)
    SELECT d0, settlement, p.d AS publication FROM s JOIN cal q ON q.d = settlement JOIN cal p ON p.o = q.o + 9""")
def cal_07(spark, sf):
    return C.next_settlement(dates(spark, sf), cal(spark), "d0")


@query("cal_08_calibration_end", f"""WITH {CAL}, {DATES}, r AS (SELECT d0, 21 - (SELECT count(DISTINCT o_orderkey) % 15 FROM orders WHERE CAST(o_orderdate + INTERVAL 31 YEAR AS DATE) = d0) AS remaining FROM dd)
    SELECT d0, remaining, cal.d AS calibrated_on FROM (SELECT *, (SELECT min(o) FROM cal WHERE op AND d >= d0) + remaining + 1 AS t FROM r) JOIN cal ON cal.o = t""")
def cal_08(spark, sf):
    """First day signals start: the remaining valid days and one more, counted on the exchange calendar."""
    d = table(spark, sf, "orders", F.to_date(F.add_months("o_orderdate", 372)).alias("d0")).groupBy("d0").agg((21 - F.count(F.lit(1)) % 15).alias("remaining"))
    return C.add_trading_days(d, cal(spark), "d0", F.col("remaining").cast("int") + 1, "calibrated_on")


@query("cal_09_first_of_month", "SELECT symbol, date_trunc('month', et_date)::DATE AS month, min(et_date) AS first_day FROM {{panel_day}} GROUP BY 1, 2")
def cal_09(spark, sf):
    return C.first_of_month(v.panel_day(spark, sf))


@query("cal_10_upcoming", """WITH u AS (SELECT 'e' || event_id AS event_key, event_time FROM {{dated}} WHERE event_type = 'signup' UNION ALL SELECT 'o' || o_orderkey, o_orderdate + INTERVAL 8350 DAY FROM orders),
    f AS (SELECT * FROM u WHERE event_time > TIMESTAMP '2024-01-20')
    SELECT *, true AS near FROM f WHERE event_time <= TIMESTAMP '2024-01-30' UNION ALL
    SELECT * FROM (SELECT *, false AS near FROM f WHERE event_time > TIMESTAMP '2024-01-30' ORDER BY event_time, event_key LIMIT 12)""")
def cal_10(spark, sf):
    a = v.dated(spark, sf).filter("event_type = 'signup'").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("event_key"), "event_time")
    b = table(spark, sf, "orders", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("event_key"), tm.plus_seconds("o_orderdate", 8350 * 86400).alias("event_time"))
    return C.upcoming([a, b], "2024-01-20 00:00:00", 10, 12)


@query("cal_11_last_session", f"WITH {CAL}, {EV} SELECT event_id, (SELECT max(close_ts) FROM cal WHERE op AND close_ts <= a) AS last_close, (SELECT max(open_ts) FROM cal WHERE op AND open_ts <= a) AS last_open FROM ev")
def cal_11(spark, sf):
    return C.last_session(shifted_events(spark, sf), cal(spark), "a").select("event_id", "last_close", "last_open")
