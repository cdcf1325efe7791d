"""Precedence of fills, label rules, trailing stops and one-position-at-a-time choice, on tiny frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.operators import chain as C
from tapeline.operators import settle as S

BAR = "pos bigint, ts timestamp_ntz, et_date date, open double, high double, low double, close double"


def paths(spark, bars, direction=1, horizon=None):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 2, 15)
    rows = [(i, t0 + dt.timedelta(minutes=5 * i), b[4] if len(b) > 4 else dt.date(2024, 1, 2), *map(float, b[:4])) for i, b in enumerate(bars)]
    d = spark.createDataFrame([("s", 0, dt.date(2024, 1, 2), direction, rows)], f"symbol string, pos bigint, et_date date, direction int, path array<struct<{BAR.replace(' bigint', ':bigint').replace(' timestamp_ntz', ':timestamp_ntz').replace(' date', ':date').replace(' double', ':double')}>>")
    return d.withColumn("raw_len", F.size("path")).withColumn("path", F.filter("path", lambda b: b["et_date"] == F.col("et_date")))


@pytest.mark.parametrize("name,direction,bars,hit,px", [
    ("gap over target fills at the open", 1, [(100, 101, 99, 100), (112, 113, 80, 90)], "tp", 112.0),
    ("gap under stop fills at the open with slippage", 1, [(100, 101, 99, 100), (80, 95, 70, 90)], "sl", 80 * 0.9998),
    ("both inside one bar is a stop", 1, [(100, 120, 80, 100)], "sl", 100 * 1.0002 * 0.9 * 0.9998),
    ("target must be crossed, not met", 1, [(100, 100 * 1.0002 * 1.1, 99, 100)], "close", 100.0),
    ("plain target", 1, [(100, 111, 99, 100)], "tp", 100 * 1.0002 * 1.1),
    ("stop may be met exactly", 1, [(100, 101, 100 * 1.0002 * 0.9, 95)], "sl", 100 * 1.0002 * 0.9 * 0.9998),
    ("no touch closes at the last bar", 1, [(100, 101, 99, 100), (100, 102, 98, 101)], "close", 101.0),
    ("short gap over target", -1, [(100, 101, 99, 100), (85, 120, 84, 90)], "tp", 85.0),
    ("short stop", -1, [(100, 120, 99, 118)], "sl", 100 * 0.9998 * 1.1 * 1.0002),
])
def test_bracket(spark, name, direction, bars, hit, px):
    r = S.bracket(paths(spark, bars, direction), 0.1, 0.1).first()
    assert r["hit"] == hit and abs(r["exit_px"] - px) < 1e-9
    entry = 100 * (1 + 0.0002 * direction)
    assert abs(r["ret"] - (direction * (px - entry) / entry - 0.0002)) < 1e-12


def test_label_rules(spark):
    import datetime as dt

    nxt = dt.date(2024, 1, 3)
    lab = lambda bars, h: S.triple_barrier(paths(spark, bars), 0.1, 0.1, h).first()["label"]
    assert lab([(100, 100 * 1.1, 99, 100)], 1) == 1  # met exactly counts
    assert lab([(100, 100 * 1.1, 90, 100)], 1) == 0  # both: conservative
    assert lab([(100, 101, 99, 100), (100, 120, 99, 100, nxt)], 2) == 0  # the day ended first
    assert lab([(100, 101, 99, 100)], 3) is None  # the data ended
    assert lab([(100, 101, 99, 100), (100, 101, 90, 100)], 2) == 0


def test_trailing(spark):
    r = S.trailing(paths(spark, [(100, 120, 99, 110), (115, 118, 107, 110)]), 0.1).first()
    # the stop of the second bar comes from the first bar's high: 120 * 0.9 = 108
    assert r["hit"] == "sl" and abs(r["exit_px"] - 108 * 0.9998) < 1e-9
    r = S.trailing(paths(spark, [(100, 150, 99, 110)]), 0.1).first()
    assert r["hit"] == "close"  # the bar's own high does not raise its own stop


def greedy(rows):
    busy, out = {}, []
    for k, s, e in sorted(rows):
        if k not in busy or s > busy[k]:
            busy[k] = e
            out.append((k, s))
    return sorted(out)


@pytest.mark.parametrize("reach", [1, 5, 60])
def test_non_overlap_equals_scan(spark, reach):
    rng = random.Random(reach)
    rows = [(rng.choice("aab"), s, s + rng.randint(0, reach)) for s in range(400) if rng.random() < 0.7]
    rows = list({(k, s): (k, s, e) for k, s, e in rows}.values())
    d = spark.createDataFrame([(k, s, e, s // 37) for k, s, e in rows], "k string, s bigint, e bigint, blk bigint").repartition(7)
    got = sorted((r["k"], r["s"]) for r in S.non_overlap(d, "k", "s", "e", "blk").collect())
    assert got == greedy(rows)


def test_seeded_continuation(spark):
    rows = [(s, s + 3, 0) for s in range(20)]
    d = spark.createDataFrame(rows, "s bigint, e bigint, blk bigint").withColumn("k", F.lit("a"))
    got = sorted(r["s"] for r in S.non_overlap(d, "k", "s", "e", "blk", seed=F.lit(6)).collect())
    assert got == [7, 11, 15, 19]


def test_one_stretch_of_a_whole_symbol(spark):
    """10^5 trades that overlap without a break, all on one symbol and one day: blocks are composed over two levels, nothing is collected."""
    n = 100_000
    d = spark.range(n).selectExpr("'a' AS k", "id AS s", "id + 3 + (id * 7919) % 40 AS e", "0 AS blk").repartition(8)
    out = S.non_overlap(d, "k", "s", "e", "blk", size=256)
    got = sorted(r["s"] for r in out.collect())
    busy, want = -1, []
    for s in range(n):
        if s > busy:
            want.append(s)
            busy = s + 3 + (s * 7919) % 40
    assert got == want
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_busy_maps_compose_like_the_walk():
    """Equal starts, ends before starts, and trades that reach over many blocks."""
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 150))
        s = np.sort(rng.integers(0, 100, n)).astype(float)
        e = s + rng.integers(-1, rng.choice([3, 30, 90]), n)
        s, e = (x[np.lexsort((e, s))] for x in (s, e))
        size = int(rng.integers(1, 30))
        maps = [C.busy_map(s[b : b + size], e[b : b + size]) for b in range(0, n, size)]
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = C.busy_compose(left, m)
        for m in maps[-2::-1]:
            right = C.busy_compose(m, right)
        for x0 in [-np.inf, *range(-2, 120, 7)]:
            x = x0
            for i in range(n):
                if s[i] > x:
                    x = e[i]
            assert C.busy_after(float(x0), left)[0] == x == C.busy_after(float(x0), right)[0]
