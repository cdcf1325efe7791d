"""Bars: building, resampling, daily panels, session filters, bar returns."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finance as fin
from ..functions import times as tm
from .spread import in_blocks, positions


def bars_from_ticks(ticks, minutes):
    """Aggregate ticks (symbol, ts, price, volume, event_id) into clock-aligned bars. Partial aggregation runs
    before the shuffle, so a hot symbol arrives as one row per bar and task."""
    us = minutes * 60_000_000
    start = tm.from_micros(F.floor(tm.micros("ts") / us) * us)
    # (time, id) packed into one decimal: a fixed-width order keeps min_by / max_by in the hash aggregate
    o = tm.micros("ts").cast("decimal(19,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col("event_id")
    bars = ticks.groupBy("symbol", start.alias("bar")).agg(
        F.min_by("price", o).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", o).alias("close"),
        F.sum("volume").alias("volume"),
    )
    return bars.select("symbol", F.col("bar").alias("ts"), tm.et_date("bar").alias("et_date"), "open", "high", "low", "close", "volume")


def resample(bars, width_min, sub_min, min_share=0.8):
    """Day-anchored buckets: offset from the first bar of the ET day, never across days; thin buckets are dropped."""
    day = W.partitionBy("symbol", "et_date")
    us = width_min * 60_000_000
    anchored = bars.withColumn("_a", F.min(tm.micros("ts")).over(day))
    bucket = F.floor((tm.micros("ts") - F.col("_a")) / us)
    out = (
        anchored.withColumn("_s", F.col("_a") + bucket * us)
        .groupBy("symbol", "et_date", "_s")
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_sub"),
        )
    )
    return out.filter(F.col("n_sub") >= min_share * width_min / sub_min).select(
        "symbol", tm.from_micros(F.col("_s")).alias("ts"), "et_date", "open", "high", "low", "close", "volume", "n_sub"
    )


def daily_bars(bars, bar_minutes=60):
    return bars.groupBy("symbol", "et_date").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        F.min("ts").alias("open_time"), tm.plus_seconds(F.max("ts"), bar_minutes * 60).alias("close_time"),
    )


def with_ordinal(daily, name="d"):
    """Day ordinal per symbol. A daily panel has at most ~366 rows a year per symbol, so the group is bounded."""
    w = W.partitionBy("symbol").orderBy("et_date")
    return daily.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))


def rth(bars, calendar=None):
    """Regular trading hours: 09:30 <= ET time < close, with the close taken from a calendar when one is given."""
    m = tm.et_minute("ts")
    if calendar is None:
        return bars.filter((m >= tm.OPEN_MIN) & (m < tm.CLOSE_MIN))
    cal = calendar.filter("is_open").select(F.col("d").alias("et_date"), "close_min")
    return bars.join(F.broadcast(cal), "et_date").filter((m >= tm.OPEN_MIN) & (m < F.col("close_min"))).drop("close_min")


def intraday_return(bars, name="iret"):
    w = W.partitionBy("symbol", "et_date").orderBy("ts")
    return bars.withColumn(name, F.col("close") / F.lag("close").over(w) - 1)


def day_position(bars):
    """Position in the ET day, the day's first open, and whether the bar is the day's last."""
    w = W.partitionBy("symbol", "et_date").orderBy("ts")
    return bars.withColumn("bars_since_open", F.row_number().over(w) - 1).withColumn("day_open", F.first("open").over(w))


def true_range(bars):
    """True range over the whole series (previous close crosses days), split into blocks."""
    return in_blocks(
        bars, "symbol", 1, 0,
        lambda r, w: r.withColumn("tr", F.greatest(
            F.col("high") - F.col("low"),
            F.abs(F.col("high") - F.lag("close").over(w)),
            F.abs(F.col("low") - F.lag("close").over(w)))),
    )


def gap_count(bars, width_min):
    """Missing bars between neighbours of the same ET day."""
    w = W.partitionBy("symbol", "et_date").orderBy("ts")
    miss = (tm.micros("ts") - tm.micros(F.lag("ts").over(w))) / (width_min * 60_000_000) - 1
    return bars.withColumn("missing", F.coalesce(miss, F.lit(0.0)).cast("bigint"))


def bar_spacing(bars):
    """Spacing to the previous bar in minutes, whatever the day (split into blocks)."""
    rows = bars if "pos" in bars.columns else positions(bars, "symbol", "et_date", "ts")
    return in_blocks(rows, "symbol", 1, 0, lambda r, w: r.withColumn(
        "gap_min", (tm.micros("ts") - tm.micros(F.lag("ts").over(w))) / 60_000_000))
