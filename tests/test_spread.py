"""Blocked windows, running aggregates, ranks and quantiles equal their one-window forms, with one hot key."""

import datetime as dt
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeline.operators import spread


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 900
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    pdf = pd.DataFrame({"key": key, "t": rng.permutation(n), "x": rng.integers(0, 40, n).astype(float), "id": range(n)})
    pdf["blk"] = pdf["t"] // 50
    return spark.createDataFrame(pdf).repartition(5).cache()


def same(a, b, cols):
    fa = a.select(*cols).toPandas().sort_values(cols).reset_index(drop=True)
    fb = b.select(*cols).toPandas().sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(fa, fb, check_dtype=False)


def test_positions(rows):
    got = spread.positions(rows, "key", "blk", "t")
    want = rows.withColumn("pos", F.row_number().over(W.partitionBy("key").orderBy("t")) - 1)
    same(got, want, ["id", "pos"])


@pytest.mark.parametrize("size", [1, 7, 64, 4096])
def test_in_blocks(rows, size):
    p = spread.positions(rows, "key", "blk", "t")
    calc = lambda r, w: r.withColumn("s", F.sum("x").over(w.rowsBetween(-5, 2))).withColumn("n", F.count("x").over(w.rowsBetween(-5, 2)))
    same(spread.in_blocks(p, "key", 5, 2, calc, size=size), calc(p, W.partitionBy("key").orderBy("pos")), ["id", "s", "n"])


@pytest.mark.parametrize("exclusive", [False, True])
def test_running(rows, exclusive):
    r = rows.withColumn("v", F.when(F.col("x") > 25, F.col("x")))
    got = spread.running(r, "key", "blk", "t", exclusive=exclusive, s=("sum", "x"), c=("count", "v"), hi=("max", "x"), lo=("min", "x"), la=("last", "v"))
    w = W.partitionBy("key").orderBy("t").rowsBetween(W.unboundedPreceding, -1 if exclusive else 0)
    want = r.withColumn("s", F.sum("x").over(w)).withColumn("c", F.count("v").over(w)).withColumn("hi", F.max("x").over(w)).withColumn("lo", F.min("x").over(w)).withColumn("la", F.last("v", True).over(w))
    same(got, want, ["id", "s", "c", "hi", "lo", "la"])


def test_quantiles_and_ranks(rows):
    pdf = rows.toPandas()
    got = spread.quantiles(rows, "key", "x", q1=0.25, med=0.5, p9=0.9).toPandas().set_index("key")
    for k, g in pdf.groupby("key"):
        assert np.allclose(got.loc[k, ["q1", "med", "p9"]].astype(float), np.quantile(g["x"], [0.25, 0.5, 0.9]))
    whole = spread.quantiles(rows, [], "x", m=0.37).first()["m"]
    assert np.isclose(whole, np.quantile(pdf["x"], 0.37))
    ranks = spread.avg_ranks(rows, "key", "x").toPandas()
    want = pdf.assign(rank=pdf.groupby("key")["x"].rank())[["key", "x", "rank"]].drop_duplicates()
    m = ranks.merge(want, on=["key", "x"])
    assert len(m) == len(want) and np.allclose(m["rank_x"], m["rank_y"])


def test_constant_values(spark):
    d = spark.createDataFrame([("k", 2.0)] * 9, "key string, x double")
    assert spread.quantiles(d, "key", "x", m=0.5).first()["m"] == 2.0


def test_hash_rank(rows):
    h = rows.withColumn("h", F.md5(F.col("id").cast("string")))
    want = h.withColumn("draw_rank", F.row_number().over(W.partitionBy("key").orderBy("h")))
    same(spread.hash_rank(h, "key", "h"), want, ["id", "draw_rank"])


def test_decayed_sums_equal_the_fold_over_many_blocks(spark):
    """Blocks of about 740 steps at this factor; a key with a gap of several blocks, values of very different size."""
    rng = np.random.default_rng(3)
    rows = [("a", i, float(rng.exponential() * 10.0 ** rng.integers(-3, 6)) if rng.random() < 0.7 else 0.0) for i in range(4000)]
    rows += [("b", i, 1.0 + i % 5) for i in [*range(700), *range(5000, 5300)]]
    beta = 1 - 1 / 3
    d = spark.createDataFrame(rows, "k string, d long, x double").repartition(7)
    got = {(r.k, r.d): r.s for r in spread.decayed(d, "k", "d", beta, s="x").collect()}
    last = {}
    for k, i, x in rows:
        at, s = last.get(k, (i, 0.0))
        s = s * beta ** (i - at) + x
        last[k] = (i, s)
        assert abs(got[(k, i)] - s) <= 1e-9 * max(s, 1e-300)


@pytest.mark.parametrize("adjust", [True, False])
def test_rsi_equals_pandas(spark, adjust):
    from tapeline.operators import rolling as R

    rng = np.random.default_rng(1)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 900)))
    px[300:330] = px[300]
    close = {"walk": px, "up": np.arange(1.0, 60.0), "flat": np.full(40, 5.0)}
    rows = [(s, dt.date(2000, 1, 1) + dt.timedelta(days=i), i, float(x)) for s, v in close.items() for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "symbol string, et_date date, d long, close double")
    got = R.rsi(d, 14, adjust).toPandas().sort_values(["symbol", "et_date"])
    for s, v in close.items():
        delta = pd.Series(v).diff()
        mean = lambda x: x.ewm(alpha=1 / 14, adjust=adjust, min_periods=14).mean()
        up, dn = mean(delta.clip(lower=0)), mean(-delta.clip(upper=0))
        want = 100 - 100 / (1 + up / (dn if adjust else dn.where(dn != 0)))
        want = want if adjust else want.fillna(100.0)
        own = pd.to_numeric(got[got.symbol == s]["rsi"]).reset_index(drop=True)
        pd.testing.assert_series_equal(own, want, check_names=False, rtol=1e-9)


@pytest.mark.parametrize("inclusive", [True, False])
def test_expanding_quantile_equals_percentile(spark, inclusive):
    """Blocks of 50 rows and 50 ranks; ties, NULLs, a key without values, one value."""
    from tapeline.operators.expanding import expanding_quantile

    rng = np.random.default_rng(2)
    rows = [("a", i, None if rng.random() < 0.1 else float(rng.integers(0, 40)) if i % 3 else float(rng.normal() * 30)) for i in range(700)]
    rows += [("nulls", i, None) for i in range(5)] + [("one", 0, 4.0)] + [("ties", i, 1.0 + (i > 250)) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, i long, x double").repartition(6)
    frame = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    want = {(r.k, r.i): r.w for r in d.withColumn("w", F.percentile("x", F.lit(0.9)).over(frame)).collect()}
    got = {(r.k, r.i): r.w for r in expanding_quantile(d, "k", "i", "x", 0.9, "w", inclusive, size=50).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert (w is None) == (got[k] is None) and (w is None or abs(w - got[k]) < 1e-9)


def test_expanding_quantile_of_many_days(spark):
    """10^5 days of one key."""
    import bisect

    from tapeline.operators.expanding import expanding_quantile

    d = spark.range(100_000).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(5000)) / 7.0).alias("x"))
    got = [r.w for r in expanding_quantile(d, "k", "i", "x", 0.5, "w").orderBy("i").collect()]
    seen = []
    for i, r in enumerate(d.orderBy("i").collect()):
        bisect.insort(seen, r.x)
        h = 0.5 * i
        lo, hi = seen[int(h)], seen[int(h + 0.5)]
        assert abs(got[i] - (lo + (hi - lo) * (h - int(h)))) < 1e-9
