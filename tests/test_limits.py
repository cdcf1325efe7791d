"""No hidden limits: the day's high, the length of a drop, even blocks under a tail, the shared folder."""

import datetime
import hashlib
import types

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeline import session
from tapeline.functions.hashing import draw_key, draws
from tapeline.operators import patterns, spread, stats
from tapeline.streaming import jobs
from tapeline.streaming.jobs import TroughConfirm


class Kept:
    """A list state in memory."""

    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)


def test_day_high_is_not_bounded_by_the_buffer():
    p = TroughConfirm(drop=0.3)
    p.init(types.SimpleNamespace(getListState=lambda *_: Kept()))
    close = [100.0] + [90.0 - 0.5 * k for k in range(60)] + [70.0, 71.0]
    got = []
    for k in range(0, len(close), 7):  # over several batches
        part = close[k : k + 7]
        rows = pd.DataFrame({"us": range(k, k + len(part)), "day": 1, "close": part})
        got += [r for out in p.handleInputRows(("s",), iter([rows]), None) for r in out.itertuples(index=False)]
    low = 90.0 - 0.5 * 59
    assert [(r.trough_us, r.confirm_us) for r in got] == [(60, 62)] and abs(got[0].drop - (100.0 - low) / 100.0) < 1e-12
    p2 = TroughConfirm(drop=0.1)
    p2.init(types.SimpleNamespace(getListState=lambda *_: Kept()))
    rows = pd.DataFrame({"us": range(9), "day": [1, 1, 1, 2, 2, 2, 2, 2, 2], "close": [200.0, 9, 9, 8, 7, 6, 5.5, 6, 7]})
    (out,) = p2.handleInputRows(("s",), iter([rows]), None)
    assert [round(x, 6) for x in out["drop"]] == [round((8 - 5.5) / 8, 6)]  # yesterday's high doesn't count


def test_drop_may_last_a_median_day(spark):
    bars = [("s", k, 1, 100.0 - k, k == 0, k == 40) for k in range(48)] + [("s", 48 + k, 2, 50.0, False, False) for k in range(48)]
    df = spark.createDataFrame(bars, "symbol string, pos long, et_date int, close double, is_peak boolean, is_trough boolean").withColumn("ts", F.col("pos"))
    got = patterns.v_candidates(df, [0.3]).select("peak_pos", "trough_pos").collect()
    assert [tuple(r) for r in got] == [(0, 40)]
    short = df.filter("et_date = 1 or pos < 60")  # median of 48 and 12 bars is 30: a drop of 40 is too long
    assert patterns.v_candidates(short, [0.3]).count() == 0


def test_one_outlier_does_not_fill_a_block(spark):
    df = spark.range(60_000).select((F.xxhash64("id") % 1_000_003 / 1_000_003.0).alias("x")).union(spark.sql("select 1e9d")).union(spark.sql("select 0d"))
    big = spread.even_blocks(df.withColumn("k", F.lit(1)), "k", "x", target=1000).groupBy("_b").count().agg(F.max("count")).first()[0]
    assert big < 2000
    order = spread.even_blocks(df.withColumn("k", F.lit(1)), "k", "x", target=1000).groupBy("_b").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("_b").collect()
    assert all(a.hi < b.lo for a, b in zip(order, order[1:]))


def test_ranks_with_a_tail_equal_plain_ranks(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.when(F.col("id") % 500 == 0, 1e12).otherwise(F.pmod(F.xxhash64("id"), F.lit(400)) - 200) * 1.0).alias("x"))
    got = {(r.k, r.x): (r.n_eq, r.n_less, r.n_all) for r in spread.value_ranks(df, "k", "x").collect()}
    p = df.toPandas()
    for (k, x), own in p.groupby(["k", "x"]):
        of = p[p.k == k]
        assert got[(k, x)] == (len(own), int((of.x < x).sum()), len(of))


def test_drawn_sums_equal_a_full_order(spark):
    df = spark.range(4000).select((F.col("id") % 3).alias("key"), (F.col("id") % 2).alias("cat"), F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 7).alias("x"), ((F.col("id") % 3) * 500 + 1).alias("k"))
    p = df.toPandas().sort_values("h")
    p["at"] = p.groupby("key").cumcount()
    want = p[p["at"] < p["k"]].groupby(["key", "cat"])["x"].sum().to_dict()
    for width in (1, 2, 4):
        assert {(r.key, r["cat"]): r.s for r in spread.drawn(df, "key", "h", "k", by="cat", width=width, s="x").collect()} == want


@pytest.mark.parametrize("same", [1, 40, 4000])
def test_drawn_sums_between_digests_equal_a_full_order(spark, same, monkeypatch):
    """Ids that repeat (their digests are equal, so is x), k of none, some and all rows, rows in one task: few sums leave a repetition."""
    own = spark.range(4000).select((F.col("id") % 4).alias("key"), (F.col("id") % 2).alias("cat"), F.floor(F.col("id") / same).alias("row"), ((F.col("id") % 4) * 333).alias("k"))
    own = own.withColumn("x", F.col("row") % 7).withColumn("cat", F.lit(0) if same > 1 else F.col("cat"))
    sizes = []
    monkeypatch.setattr(spread, "cut", lambda df, name: sizes.append(df.count()) or df)
    r = spread.cuts(own, "key", "k").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("h", F.md5(F.concat_ws(":", "rep", "row")))
    p = r.toPandas().sort_values("h")
    p["at"] = p.groupby(["rep", "key"]).cumcount()
    want = p[p["at"] < p["k"]].groupby(["rep", "key", "cat"])["x"].sum().to_dict()
    got = {(q["rep"], q["key"], q["cat"]): q.s for q in spread.drawn(r, ["rep", "key"], "h", "k", by="cat", near=("_lo", "_hi"), s="x").collect()}
    assert got == want
    assert sizes[0] < 3 * (1 + 3 * 400)


def test_resampled_auc_of_ties_crowds_and_nulls_writes_sums_of_blocks_only(spark, monkeypatch):
    """More repetitions than are counted at once, a score that half the rows share, null scores and labels; equal to a plain count of pairs."""
    n, reps = 3000, 300
    rng = np.random.default_rng(5)
    a = [None if i % 97 == 0 else 7.0 if i % 2 else float(rng.integers(0, 400)) for i in range(n)]
    b = [float(i * 7919 % n) for i in range(n)]
    label = [None if i % 501 == 5 else int(rng.random() < 0.3) for i in range(n)]
    df = spark.createDataFrame([(i, x, y, z, i // 512) for i, (x, y, z) in enumerate(zip(a, b, label))], "id long, a double, b double, label int, blk long")
    written, cut = {}, stats.cut
    monkeypatch.setattr(stats, "cut", lambda d, name: written.setdefault(name, cut(d, name)))
    got = {r.rep: (r.auc_a, r.auc_b) for r in stats.auc_bootstrap(df, ["a", "b"], "label", "id", "blk", n=reps).collect()}
    assert len(got) == reps
    for rep in (0, 255, 256, 299):
        pick = [int(hashlib.md5(f"19:{rep}:{i}".encode()).hexdigest()[:12], 16) % n for i in range(n)]
        for x, found in zip((a, b), got[rep]):
            pos, neg = (np.array([x[i] for i in pick if x[i] is not None and (label[i] or 0) == k]) for k in (1, 0))
            want = (np.searchsorted(np.sort(neg), pos, "left") + np.searchsorted(np.sort(neg), pos, "right")).sum() / 2 / (len(pos) * len(neg))
            assert found == pytest.approx(want, abs=1e-12)
    assert written["ranks"].count() <= reps * 2 * (2 * n // stats.BLOCK + 2)


def test_binomial_support_is_dealt_in_chunks(spark):
    from math import comb

    df = spark.createDataFrame([("a", 600, 1100), ("b", 0, 3), ("c", 2, 2)], "k string, hits long, n long")
    got = {r.k: r.p_tail for r in stats.binomial_tail(df, chunk=64).collect()}
    want = {"a": sum(comb(1100, j) for j in range(600, 1101)) / 2**1100, "b": 1.0, "c": 0.25}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_shared_folder_is_required_off_local_masters():
    def fake(master):
        conf = types.SimpleNamespace(get=lambda *_: None)
        return types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))

    assert session.shared_dir(fake("local[2]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))


def test_stores_outlive_their_process(spark, tmp_path):
    """Two runs over one folder, as two processes would make them: the second knows what the first has stored."""
    from tapeline.streaming import jobs

    src, schema = str(tmp_path / "in"), "event_id long, observed_time long, value string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = lambda: jobs.source(spark, src, schema)
        first = jobs.ingest_first_seen(stream(), path=str(tmp_path / "first")).collect()
        latest = jobs.upsert_latest(stream(), ["event_id"], ["observed_time"], path=str(tmp_path / "latest")).collect()
        return {tuple(r) for r in first}, {tuple(r) for r in latest}

    assert arrive([(1, 10, "a"), (2, 10, "b"), (2, 11, "c")]) == ({(1, 10, "a"), (2, 10, "b")}, {(1, 10, "a"), (2, 11, "c")})
    assert arrive([(2, 12, "d"), (3, 12, "e")]) == ({(1, 10, "a"), (2, 10, "b"), (3, 12, "e")}, {(1, 10, "a"), (2, 12, "d"), (3, 12, "e")})


def test_first_seen_asks_the_state_in_the_jvm(spark, tmp_path):
    """No call of Python for each key: a batch's earliest rows are found in whole columns. Null times come last, null keys are one key."""
    schema, src, path = "event_id string, observed_time timestamp_ntz, type string", str(tmp_path / "src"), tmp_path / "first"
    at = lambda minute: datetime.datetime(2024, 1, 1, 0, minute)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        return sorted(map(str, map(tuple, jobs.ingest_first_seen(jobs.source(spark, src, schema), path=str(path)).collect())))

    one = arrive([("a", at(9), "late"), ("a", at(1), "first"), ("a", None, "never"), ("b", None, "alone"), (None, at(5), "x"), (None, at(4), "y")])
    assert one == sorted(map(str, [("a", at(1), "first"), ("b", None, "alone"), (None, at(4), "y")]))
    assert arrive([("a", at(0), "before"), ("b", at(0), "b"), (None, at(0), "z"), ("c", at(3), "c")]) == sorted([*one, str(("c", at(3), "c"))])
    assert '"dedupe"' in (path / "progress/state/0/_metadata/metadata").read_text()


def test_earliest_rows_are_the_same_however_rows_are_batched():
    rows = [(i * 7919 % 37 if i % 11 else None, None if i % 5 == 0 else i * 31 % 17, i) for i in range(500)]
    want = {}
    for k, t, i in rows:
        if k not in want or t is not None and (want[k][0] is None or t < want[k][0]):
            want[k] = (t, i)
    for step, size in ((1, 3), (40, 7), (10_000, 100)):
        batches = [pa.RecordBatch.from_pylist([dict(zip("ktn", r)) for r in rows[i : i + size]], pa.schema([("k", pa.int64()), ("t", pa.int32()), ("n", pa.int64())])) for i in range(0, 500, size)]
        got = [r for b in jobs._earliest(["k"], "t", step)(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(want) and {r["k"]: (r["t"], r["n"]) for r in got} == want
    assert list(jobs._earliest(["k"], "t")(iter([]))) == []


def test_draws_make_a_rows_text_once(spark):
    """Digests are those of ``draw_key``, for ids that are null, repeat or are text; nothing but two strings is joined once a row has met its repetitions."""
    own = spark.createDataFrame([(1, "a"), (1, "a"), (-7, None), (None, "é:"), (None, None), (10**15, "")], "id long, name string").withColumn("day", F.lit("2024-01-02").cast("date"))
    for parts in (["id"], ["day"], ["name", "id"]):
        want = own.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("_h", draw_key(31, "sim", *parts))
        got = draws(own, 12, 31, *parts, name="sim")
        assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(got) == rows(want) and got.count() == 12 * 6
    plan = draws(own, 12, 31, "name", "id")._jdf.queryExecution().optimizedPlan().toString()
    made, row = plan.split("Generate", 1)
    assert "md5" in made and "concat_ws" not in plan and "cast(id" not in made and "cast(id" in row


def test_permuted_sums_equal_a_full_order(spark):
    own = spark.range(300).select(F.when(F.col("id") % 50 > 0, F.floor(F.col("id") / 2)).alias("row"), (F.col("id") % 3).alias("cat"), F.lit(97).alias("k"))
    p = own.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("h", draw_key(5, "rep", "row")).toPandas().sort_values("h")
    p["at"] = p.groupby("rep").cumcount()
    want = p[p["at"] < 97].groupby("rep").size().to_dict()
    got = {}
    for r in stats._permuted(own, 5, 5, "row", "k", by=["cat"], n_drawn=F.lit(1)).collect():
        got[r.rep] = got.get(r.rep, 0) + r.n_drawn
    assert got == want == dict.fromkeys(range(5), 97)
