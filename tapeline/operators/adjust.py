"""Split handling. The split table is literal and tiny: it is folded into expressions, so nothing is joined."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _factor(splits, symbol, date, effective):
    """Product of the factors whose effective date satisfies the predicate, per symbol."""
    out = F.lit(1.0)
    for sym, rows in splits.items():
        f = F.lit(1.0)
        for eff, k in rows:
            f = f * F.when(effective(date, F.lit(eff).cast("date")), float(k)).otherwise(1.0)
        out = F.when(symbol == sym, f).otherwise(out)
    return out


def share_factor(splits, symbol, date):
    """Factors effective on or before the date: shares before a split / after it."""
    return _factor(splits, symbol, date, lambda d, e: d >= e)


def price_factor(splits, symbol, date):
    """Factors effective after the date: brings an old price to the present basis."""
    return _factor(splits, symbol, date, lambda d, e: d < e)


def correct_change(releases, splits):
    """Recompute change_pct where the factor changed between consecutive releases of a symbol."""
    w = W.partitionBy("symbol").orderBy("et_date")
    f = share_factor(splits, F.col("symbol"), F.col("et_date"))
    r = releases.withColumn("factor", f).withColumn("prev_factor", F.lag("factor").over(w)).withColumn("prev_si", F.lag("short_interest").over(w))
    fixed = F.round(((F.col("short_interest") / F.col("factor")) / (F.col("prev_si") / F.col("prev_factor")) - 1) * 100, 2)
    crossed = (F.col("factor") != F.col("prev_factor")) & F.col("short_interest").isNotNull() & F.col("prev_si").isNotNull() & (F.col("prev_si") != 0)
    return (
        r.withColumn("change_raw", F.col("change_pct"))
        .withColumn("change_pct", F.when(crossed, fixed).otherwise(F.col("change_pct")))
        .withColumn("split_adjusted", F.coalesce(crossed, F.lit(False)))
        .drop("prev_factor", "prev_si")
    )


def adjust_level(releases, splits):
    f = share_factor(splits, F.col("symbol"), F.col("et_date"))
    return releases.withColumn("si_raw", F.col("short_interest")).withColumn("short_interest", F.col("short_interest") / f)


def unexplained_jumps(releases, guard_pct=50.0):
    return releases.filter(F.col("change_pct") >= guard_pct)
