"""Time columns. Timestamps are TIMESTAMP_NTZ holding UTC; dates are New York (ET) calendar dates."""

from pyspark.sql import functions as F

ET = "America/New_York"
OPEN_MIN = 570  # 09:30 in minutes of the day
CLOSE_MIN = 960  # 16:00


def col(c):
    return F.col(c) if isinstance(c, str) else c


def to_et(ts):
    return F.convert_timezone(F.lit("UTC"), F.lit(ET), col(ts))


def from_et(local):
    return F.convert_timezone(F.lit(ET), F.lit("UTC"), col(local))


def et_date(ts):
    return F.to_date(to_et(ts))


def et_minute(ts):
    e = to_et(ts)
    return F.hour(e) * 60 + F.minute(e)


def micros(ts):
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds(ts):
    return F.floor(micros(ts) / 1_000_000).cast("bigint")


def from_micros(us):
    return F.timestamp_micros(us).cast("timestamp_ntz")


def plus_seconds(ts, s):
    return from_micros(micros(ts) + (F.lit(s) if isinstance(s, int) else s).cast("bigint") * 1_000_000)


def at_et(d, hour, minute=0):
    """UTC instant of a wall-clock time on an ET date."""
    local = F.make_timestamp_ntz(
        F.year(col(d)), F.month(col(d)), F.day(col(d)), F.lit(hour), F.lit(minute), F.lit(0).cast("decimal(16,6)")
    )
    return from_et(local)


def day_number(d):
    return F.unix_date(col(d))
