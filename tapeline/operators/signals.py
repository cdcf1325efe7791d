"""Signal, gate and label projections."""

from pyspark.sql import functions as F

from ..functions import finance as fin
from ..functions import times as tm


def session_gate(df, ts="ts", lo=630, hi=900):
    m = tm.et_minute(ts)
    return df.filter((m >= lo) & (m < hi))


def normalised(df, cols, vol):
    """Divide return features by realised volatility; zero volatility gives NULL."""
    for c in cols:
        df = df.withColumn(f"{c}_n", F.try_divide(F.col(c), F.nullif(F.col(vol), F.lit(0.0))))
    return df


def rule_legs(df, rules):
    """AND of literal legs (column, op, value, direction): numeric legs are thresholds, text legs are equalities."""
    ok = F.lit(True)
    for col, op, value in rules:
        c = F.col(col)
        leg = {">=": c >= value, "<=": c <= value, "==": c == value}[op]
        ok = ok & F.coalesce(leg, F.lit(False))
    return df.withColumn("all_legs", ok)


def regime_label(ret, mdd, bull=0.10, bear=-0.10, deep=-0.30):
    base = F.when(ret >= bull, "bull").when(ret <= bear, "bear").otherwise("sideways")
    return F.when(mdd <= deep, F.concat(base, F.lit("_deep"))).otherwise(base)


def order_text(detector, switch_known, switch_on, line_set, line_hit):
    """Five-way decision table, first match wins."""
    return (
        F.when(detector == "RISK_OFF", "risk_off")
        .when(~switch_known, "data_missing")
        .when(line_set & line_hit & switch_on, "hold_line_broken")
        .when(line_set & line_hit, "hold_add_line_broken")
        .when(switch_on, "hold_no_add")
        .otherwise("hold_add_on_signal")
    )


def release_timing(ts):
    """'intraday' on ET weekdays 09:30-16:00, else 'after_hours'."""
    e = tm.to_et(ts)
    m = tm.et_minute(ts)
    return F.when((F.weekday(e) < 5) & (m >= tm.OPEN_MIN) & (m < tm.CLOSE_MIN), "intraday").otherwise("after_hours")


def health(age_min, market_open, open_thr, closed_thr):
    thr = F.when(market_open, F.lit(open_thr)).otherwise(F.lit(closed_thr))
    return age_min.isNotNull() & (age_min <= thr)


def segment(date, cuts):
    """Date-cut label: ``cuts`` = [(name, first date), ...] in rising order; earlier dates get NULL."""
    out = F.lit(None).cast("string")
    for name, first in cuts:
        out = F.when(date >= F.lit(first).cast("date"), F.lit(name)).otherwise(out)
    return out


def follow_fade(df, ret, modes, triggers):
    """Direction per (mode, trigger) from the previous bucket's return."""
    from ..functions.numeric import grid

    g = grid(df, mode=modes, trigger=triggers)
    d = fin.deadband(F.col(ret), F.col("trigger"))
    return g.withColumn("direction", F.when(F.col("mode") == "fade", -d).otherwise(d)).filter(F.col("direction").isNotNull() & (F.col(ret) != 0))


def describe(df, cols):
    """count/mean/std/min/quartiles/max per column, one row each. Quartiles come from spread value counts."""
    from .spread import quantiles

    k = len(cols)
    long = df.select(F.expr("stack({}, {}) as (name, x)".format(k, ", ".join(f"'{c}', double(`{c}`)" for c in cols))))
    basic = long.groupBy("name").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    return basic.join(quantiles(long, "name", "x", p25=0.25, p50=0.5, p75=0.75), "name")
