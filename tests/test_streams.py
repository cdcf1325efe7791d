"""Streams whose batches are out of order, and states that age while their key is silent."""

import collections

import pytest
from pyspark.sql import functions as F

from tapeline.streaming import jobs as J

DAY_MS = 86_400_000
HOUR_US = 3_600_000_000


def bars(spark):
    rows = [(s, i * HOUR_US, i // 24, 100.0 + (i * 7919 * (1 + k)) % 61, i * HOUR_US + 10) for k, s in enumerate("ab") for i in range(400) if (i * (3 + k)) % 11]
    return spark.createDataFrame(rows, "symbol string, us long, day int, close double, received_us long")


@pytest.mark.parametrize("make", [lambda: J.GapMonitor(HOUR_US), lambda: J.MomentumSignal(0.2), lambda: J.TroughConfirm(drop=0.1)])
def test_shuffled_batches_give_the_rows_of_ordered_ones(spark, make):
    b = bars(spark)
    row = "us:bigint,day:int,close:double,received_us:bigint"
    late = 2 * DAY_MS
    clock = J.with_clock(b, delay_ms=late)
    seen = F.when(F.col("symbol") == J.CLOCK, F.col("us")).otherwise(F.col("us") + F.pmod(F.xxhash64("us", "symbol"), F.lit(late * 1000)))
    stream = J.as_stream(clock.withColumn("seen", seen), "seen", parts=6)
    got = J.drain(J.in_order(stream, make(), row, slot_ms=DAY_MS // 2, delay_ms=late), "shuffled")
    want = J.drain(J.stateful(J.as_stream(b, "us", parts=1), make()), "ordered")
    rows = lambda df: collections.Counter(map(tuple, df.collect()))
    assert rows(got) == rows(want) and rows(want)


@pytest.mark.parametrize("make", [lambda: J.GapMonitor(HOUR_US), lambda: J.MomentumSignal(0.2), lambda: J.TroughConfirm(drop=0.1)])
def test_nulls_of_the_clock_do_not_reach_rows_of_the_same_batch(spark, make):
    """One partition, so the clock's row, null but for key and time, lies in one Arrow batch with bars; a bar without a receipt time has no lag."""
    b = bars(spark).filter("symbol = 'a'").withColumn("received_us", F.when(F.col("us") != 7 * HOUR_US, F.col("received_us")))
    row = "us:bigint,day:int,close:double,received_us:bigint"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = J.drain(J.in_order(J.as_stream(J.with_clock(b), "us", parts=1, files=1), make(), row), "clocked").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    pdf = b.toPandas().astype(object).where(lambda x: x.notna(), None).sort_values("us")
    processor = make()
    if isinstance(processor, J.TroughConfirm):
        want = [tuple(r) for r in J.drain(J.stateful(J.as_stream(bars(spark).filter("symbol = 'a'"), "us", parts=1), processor), "plain").collect()]
    else:
        want = processor.walk("a", pdf, None)[0]
    assert want and collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, want))
    assert not isinstance(processor, J.GapMonitor) or any(r.us == 7 * HOUR_US and r.lag_s is None for r in got)


def test_off_state_runs_out_while_its_key_is_silent(spark):
    """Key a ends in RISK_OFF; only rows of key b come after that. a turns once, b's own off state is still open."""
    a = [("a", d, d == 7, True) for d in range(10)]
    b = [("b", d, d == 58, True) for d in range(60)]
    df = spark.createDataFrame(a + b, "symbol string, d long, hit boolean, valid boolean")
    unit = {"time": "d", "per_ms": 1 / DAY_MS, "slot_ms": 4 * DAY_MS, "base_ms": 4 * DAY_MS}
    stream = J.as_stream(df, "d", parts=5)
    got = J.drain(J.in_order(stream, J.DetectorMachine(calib=3, persist=5), "d:bigint,hit:boolean,valid:boolean", **unit), "aging").collect()
    assert sorted((r.symbol, r.d, r.state) for r in got if r.symbol == "a") == [("a", 0, "CALIBRATING"), ("a", 3, "RISK_ON"), ("a", 7, "RISK_OFF"), ("a", 12, "RISK_ON")]


def test_component_turns_stale_without_rows_of_its_own(spark):
    rows = [("quiet", 0), ("quiet", 10)] + [("busy", m) for m in range(0, 200, 5)] + [("back", 0), ("back", 100), ("back", 190)]
    df = spark.createDataFrame(rows, "component string, m int").select("component", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60).cast("timestamp_ntz").alias("ts"), "m")
    stream = J.as_stream(df, "m", parts=8)
    got = J.drain(J.silences(stream.select("component", "ts"), {"back": 30}, 60), "silence").collect()
    found = sorted((r.component, (r.last_us // 1_000_000 - 1_700_000_000) // 60) for r in got)
    assert ("quiet", 10) in found and ("back", 0) in found and not any(c == "busy" for c, _ in found)
    assert all(r.stale_us > r.last_us for r in got)
