"""Exchange calendar as a generated table. It has one row per date, so its size is set by the years asked for
(22k rows for 60 years) and it is always safe to broadcast."""

from datetime import date as _date

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times as tm

# fixed values: full closures and 13:00 closes. Years outside the table follow the weekday rule.
HOLIDAYS = [
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
    "2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18", "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24",
]
HALF_DAYS = ["2026-11-27", "2026-12-24", "2027-11-26"]
MAX_DAYS = 150 * 366


def calendar(spark, first, last):
    """(d, is_open, close_min, close_ts, open_ts, n_before, ord): n_before = open days before d, ord = ordinal of an open day."""
    if (_date.fromisoformat(last) - _date.fromisoformat(first)).days > MAX_DAYS:
        raise ValueError("calendar range too long to broadcast")
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS d")
    is_open = (F.weekday("d") < 5) & ~F.col("d").cast("string").isin(HOLIDAYS)
    close_min = F.when(F.col("d").cast("string").isin(HALF_DAYS), 780).otherwise(960)
    w = W.partitionBy(F.lit(0)).orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    return (
        days.withColumn("is_open", is_open)
        .withColumn("close_min", close_min)
        .withColumn("open_ts", tm.at_et("d", 9, 30))
        .withColumn("close_ts", F.when(F.col("close_min") == 780, tm.at_et("d", 13)).otherwise(tm.at_et("d", 16)))
        .withColumn("n_before", F.coalesce(F.sum(F.col("is_open").cast("int")).over(w), F.lit(0)))
        .withColumn("ord", F.when(F.col("is_open"), F.col("n_before")))
    )


def _by_date(rows, cal, date, *cols):
    return rows.join(F.broadcast(cal.select(F.col("d").alias(date), *cols)), date, "left")


def _by_ord(rows, cal, ord_col, name):
    opens = cal.filter("is_open").select(F.col("ord").alias(ord_col), F.col("d").alias(name))
    return rows.join(F.broadcast(opens), ord_col, "left").drop(ord_col)


def is_trading_day(rows, cal, date):
    return _by_date(rows, cal, date, F.col("is_open").alias("is_trading"))


def next_prev(rows, cal, date):
    """First open day strictly after, and last open day strictly before."""
    r = _by_date(rows, cal, date, "n_before", "is_open")
    r = r.withColumn("_n", F.col("n_before") + F.col("is_open").cast("int")).withColumn("_p", F.col("n_before") - 1)
    return _by_ord(_by_ord(r, cal, "_n", "next_day"), cal, "_p", "prev_day").drop("n_before", "is_open")


def add_trading_days(rows, cal, date, n, name):
    """Roll onto an open day (forward for n >= 0, back for n < 0), then move n open days."""
    r = _by_date(rows, cal, date, "n_before", "is_open")
    n = F.lit(n) if isinstance(n, int) else n
    rolled = F.when(n >= 0, F.col("n_before")).otherwise(F.col("n_before") + F.col("is_open").cast("int") - 1)
    return _by_ord(r.withColumn("_o", rolled + n), cal, "_o", name).drop("n_before", "is_open")


def days_between(rows, cal, a, b, name):
    """Open days in [a, b); 0 when b <= a."""
    r = _by_date(rows, cal, a, F.col("n_before").alias("_na"))
    r = _by_date(r, cal, b, F.col("n_before").alias("_nb"))
    return r.withColumn(name, F.greatest(F.col("_nb") - F.col("_na"), F.lit(0))).drop("_na", "_nb")


def close_time(rows, cal, date):
    return _by_date(rows, cal, date, "close_min")


def sessions_completed(rows, cal, a, b, name):
    """Closes in (a, b]: the running count of closes at b less that at a, both from the calendar by ET date."""
    def closes_at(r, t, out):
        r = r.withColumn("_d", tm.et_date(t))
        r = _by_date(r, cal, "_d", "n_before", "is_open", "close_ts")
        return r.withColumn(out, F.col("n_before") + (F.col("is_open") & (F.col("close_ts") <= F.col(t))).cast("int")).drop(
            "_d", "n_before", "is_open", "close_ts")

    r = closes_at(closes_at(rows, a, "_ca"), b, "_cb")
    return r.withColumn(name, F.greatest(F.col("_cb") - F.col("_ca"), F.lit(0))).drop("_ca", "_cb")


def next_settlement(rows, cal, date):
    """Next settlement after a date (15th or month end, rolled back to an open day) and its publication 9 days on."""
    m0 = F.trunc(date, "month")
    cand = F.array(*[c for k in (0, 1) for c in (F.date_add(F.add_months(m0, k), 14), F.last_day(F.add_months(m0, k)))])
    r = rows.withColumn("_c", F.explode(cand))
    back = _by_date(r.withColumn("_cd", F.col("_c")), cal, "_cd", "n_before", "is_open")
    back = back.withColumn("_o", F.col("n_before") + F.col("is_open").cast("int") - 1).drop("n_before", "is_open", "_cd", "_c")
    back = _by_ord(back, cal, "_o", "settlement").filter(F.col("settlement") > F.col(date))
    first = back.groupBy(*rows.columns).agg(F.min("settlement").alias("settlement"))
    return add_trading_days(first, cal, "settlement", 9, "publication")


def first_of_month(daily, date="et_date", key="symbol"):
    """First trading day of each month per key: the deposit schedule."""
    return daily.groupBy(key, F.trunc(date, "month").alias("month")).agg(F.min(date).alias("first_day"))


def last_session(rows, cal, ts):
    """Latest close and latest open at or before a time."""
    r = rows.withColumn("_d", tm.et_date(ts))
    r = _by_date(r, cal, "_d", "n_before", "is_open", "open_ts", "close_ts")
    n_close = F.col("n_before") + (F.col("is_open") & (F.col("close_ts") <= F.col(ts))).cast("int") - 1
    n_open = F.col("n_before") + (F.col("is_open") & (F.col("open_ts") <= F.col(ts))).cast("int") - 1
    r = r.withColumn("_oc", n_close).withColumn("_oo", n_open).drop("n_before", "is_open", "open_ts", "close_ts", "_d")
    opens = cal.filter("is_open")
    r = r.join(F.broadcast(opens.select(F.col("ord").alias("_oc"), F.col("close_ts").alias("last_close"))), "_oc", "left")
    return r.join(F.broadcast(opens.select(F.col("ord").alias("_oo"), F.col("open_ts").alias("last_open"))), "_oo", "left").drop("_oc", "_oo")


def upcoming(sources, now, horizon_days, beyond_k):
    """Future rows of several sources: all within the horizon, and the first k beyond it."""
    allrows = sources[0]
    for s in sources[1:]:
        allrows = allrows.unionByName(s)
    t = F.lit(now).cast("timestamp_ntz")
    future = allrows.filter(F.col("event_time") > t)
    edge = tm.plus_seconds(t, horizon_days * 86400)
    near = future.filter(F.col("event_time") <= edge).withColumn("near", F.lit(True))
    far = future.filter(F.col("event_time") > edge).orderBy("event_time", "event_key").limit(beyond_k).withColumn("near", F.lit(False))
    return near.unionByName(far)
