"""As-of joins without range joins: both sides share one ordered stream per key and values are carried along it."""

from pyspark.sql import functions as F

from ..functions.times import micros
from .spread import even_blocks, running


def _stream(left, right, key, left_time, right_time, cols, tie_right_first):
    lcols = left.columns
    l = left.select(
        *[F.col(k).alias(f"_k_{k}") for k in key],
        F.col(left_time).alias("_t"),
        F.lit(1 if tie_right_first else 0).alias("_side"),
        F.struct(*lcols).alias("_left"),
        F.lit(None).cast(right.select(F.struct(*cols)).schema[0].dataType).alias("_right"),
    )
    r = right.filter(F.col(right_time).isNotNull()).select(
        *[F.col(k).alias(f"_k_{k}") for k in key],
        F.col(right_time).alias("_t"),
        F.lit(0 if tie_right_first else 1).alias("_side"),
        F.lit(None).cast(left.select(F.struct(*lcols)).schema[0].dataType).alias("_left"),
        F.struct(*cols).alias("_right"),
    )
    return l.unionByName(r)


def _block(t, unit, kind):
    if kind == "timestamp":
        return F.floor(micros(t) / {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}[unit])
    if kind == "date":
        return F.floor(F.unix_date(t) / 32)
    return F.floor(t / 1024)


def _blocked(s, key, unit, kind, sign=1):
    """Blocks of the shared stream: fixed spans of time, or with ``unit="values"`` the spread of the numbers themselves."""
    if unit == "values":
        s = s.withColumn("_num", F.col("_t").cast("double"))
        return even_blocks(s, [f"_k_{k}" for k in key], "_num").withColumn("_b", sign * F.col("_b")).drop("_num")
    return s.withColumn("_b", sign * _block(F.col("_t"), unit, kind))


def _kind(df, c):
    t = df.schema[c].dataType.typeName()
    return "timestamp" if t.startswith("timestamp") else t


def asof_backward(left, right, key, left_time, right_time, cols, strict=False, unit="hour", prefix=""):
    """Latest right row with right_time <= left_time (< when strict) of the same key; NULLs where none.

    Ties on right_time keep the largest ``cols`` struct so the pick does not depend on input order.
    """
    key = [key] if isinstance(key, str) else list(key)
    s = _stream(left, right, key, left_time, right_time, cols, not strict)
    s = _blocked(s, key, unit, _kind(s, "_t"))
    out = running(s, [f"_k_{k}" for k in key], "_b", ["_t", "_side", "_right"], _pick=("last", "_right"))
    return _unpack(out, left, cols, prefix)


def asof_forward(left, right, key, left_time, right_time, cols, strict=True, unit="hour", prefix=""):
    """Earliest right row with right_time > left_time (>= when not strict) of the same key; NULLs where none."""
    key = [key] if isinstance(key, str) else list(key)
    s = _stream(left, right, key, left_time, right_time, cols, strict)
    # the mirror of the backward join: walk time downwards
    kind = _kind(s, "_t")
    num = micros("_t") if kind == "timestamp" else (F.unix_date("_t") if kind == "date" else F.col("_t"))
    s = s.withColumn("_rt", -num).withColumn("_rside", -F.col("_side"))
    s = _blocked(s, key, unit, kind, -1)
    out = running(s, [f"_k_{k}" for k in key], "_b", ["_rt", "_rside"], _pick=("last", "_right"))
    return _unpack(out, left, cols, prefix)


def _unpack(out, left, cols, prefix):
    return out.filter(F.col("_left").isNotNull()).select(
        "_left.*", *[F.col(f"_pick.{c}").alias(f"{prefix}{c}") for c in cols]
    )


def asof_with_lag(left, series, key, left_time, right_time, value, lags, unit="hour"):
    """As-of value plus the values k observations earlier in the series (bounded daily or monthly series)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(right_time)
    wide = series.select(key, right_time, value, *[F.lag(value, k).over(w).alias(f"{value}_lag{k}") for k in lags])
    return asof_backward(left, wide, key, left_time, right_time, [value] + [f"{value}_lag{k}" for k in lags], unit=unit)


def range_count(left, right, key, lo, hi, right_time, sums, unit="hour"):
    """Counts and sums of right rows with time in (lo, hi], as the difference of a running total at two marks.

    ``sums`` maps output name to a right-side numeric column; a count is a sum of ones. Each left row puts two marks
    on its key's time stream; right rows at the same instant come before a mark, so lo is open and hi is closed.
    """
    mark = lambda c, h: F.struct(F.col(c).alias("t"), F.lit(h).alias("hi"))
    l = left.select(F.col(key).alias("_k"), F.struct(*left.columns).alias("_left"), F.explode(F.array(mark(lo, 0), mark(hi, 1))).alias("_m"))
    l = l.select("_k", "_left", F.col("_m.t").alias("_t"), F.col("_m.hi").alias("_hi"), F.lit(1).alias("_side"), *[F.lit(None).cast("double").alias(f"_x_{n}") for n in sums])
    r = right.select(
        F.col(key).alias("_k"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), F.col(right_time).alias("_t"), F.lit(0).alias("_hi"), F.lit(0).alias("_side"),
        *[F.col(c).cast("double").alias(f"_x_{n}") for n, c in sums.items()])
    s = l.unionByName(r)
    s = s.withColumn("_b", _block(F.col("_t"), unit, _kind(s, "_t")))
    s = running(s, "_k", "_b", ["_t", "_side"], **{f"_r_{n}": ("sum", f"_x_{n}") for n in sums}).filter(F.col("_left").isNotNull())
    at = lambda n, h: F.max(F.when(F.col("_hi") == h, F.coalesce(F.col(f"_r_{n}"), F.lit(0.0))))
    g = s.groupBy("_left").agg(F.sum("_hi").cast("int").alias("_n"), *[(at(n, 1) - at(n, 0)).alias(n) for n in sums])
    # equal left rows share a group and come back as often as they went in
    return g.withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).select("_left.*", *sums)
