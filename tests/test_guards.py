"""Reader guards, joins that must fail, write-once scores, folds and models."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeline.operators import joins as J
from tapeline.operators import models as ML
from tapeline.operators import states as ST
from tapeline.plans import views as v
from tapeline.session import run_dir
from tapeline.sources import readers as rd


def csv(spark, rows):
    path = run_dir(spark, "guard")
    spark.createDataFrame(rows, "symbol string, Datetime string, Open double, High double, Low double, Close double, Volume double").write.option("header", True).csv(path)
    return path


def test_load_bars(spark):
    ok = [("s", f"2024-01-03T{h}:00:00+00:00", 1.0, 1.0, 1.0, 1.0, 1.0) for h in range(15, 20)]
    assert rd.load_bars(spark, csv(spark, ok)).count() == 5
    with pytest.raises(ValueError, match="local time"):
        rd.load_bars(spark, csv(spark, [("s", f"2024-01-03T0{h}:00:00+00:00", 1.0, 1.0, 1.0, 1.0, 1.0) for h in range(5)]))
    with pytest.raises(ValueError, match="without close"):
        rd.load_bars(spark, csv(spark, [("s", "2024-01-03T15:00:00+00:00", 1.0, 1.0, 1.0, None, 1.0)]))


def test_exact_lookup_fails_on_missing(spark, sf):
    b = v.bars_1h(spark, sf)
    ev = b.select("symbol", (F.col("ts") + F.expr("INTERVAL 7 MINUTES")).alias("ts"))
    with pytest.raises(ValueError, match="have no bar"):
        J.exact_lookup(ev, b)


def test_asof_is_strict_where_asked(spark):
    from tapeline.operators.asof import asof_backward, asof_forward

    t = dt.datetime(2024, 1, 1, 12)
    left = spark.createDataFrame([("k", t)], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("k", t, 1), ("k", t - dt.timedelta(days=40), 0), ("k", t + dt.timedelta(days=40), 2)], "k string, r timestamp_ntz, x int")
    pick = lambda f, strict: f(left, right, "k", "t", "r", ["x"], strict=strict).first()["x"]
    assert pick(asof_backward, False) == 1 and pick(asof_backward, True) == 0
    assert pick(asof_forward, False) == 1 and pick(asof_forward, True) == 2


def test_asof_repartitioning_changes_nothing(spark, sf):
    from tapeline.operators.asof import asof_backward

    l, r = v.bars_1h(spark, sf).select("symbol", "ts"), v.ticks(spark, sf).select("symbol", F.col("ts").alias("r"), "price")
    a = asof_backward(l, r, "symbol", "ts", "r", ["price"]).collect()
    b = asof_backward(l.repartition(11), r.repartition(3), "symbol", "ts", "r", ["price"], unit="hour").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_write_once(spark):
    s = "event_id bigint, d1_date date, ret_1d double, ret_5d double, score_1d string, score_5d string"
    d = dt.date(2024, 1, 2)
    old = spark.createDataFrame([(1, d, 0.1, None, "hit", "pending"), (2, d, 0.1, 0.2, "hit", "hit"), (3, None, None, None, None, None)], s).withColumn("_row", F.lit(1))
    new = spark.createDataFrame([(1, d, 0.1, 0.3, "hit", "miss"), (2, d, -0.5, 0.2, "miss", "hit"), (3, d, 0.2, None, None, None), (4, d, 0.1, None, "hit", "pending")], s)
    m = {r["event_id"]: tuple(r)[1:] for r in ST.merge_scores(old, new).collect()}
    assert m[1] == (d, 0.1, 0.3, "hit", "miss")  # NULL filled, pending settled
    assert m[2] == (d, 0.1, 0.2, "hit", "hit")  # frozen
    assert m[3] == (d, 0.2, None, None, None)  # neutral stays neutral
    assert m[4] == (d, 0.1, None, "hit", "pending")
    c = sorted((r["event_id"], r["field"]) for r in ST.score_conflicts(old, new).collect())
    assert c == [(2, "ret_1d"), (2, "score_1d")]


def test_folds_never_leak(spark, sf):
    f = ML.walk_forward(ML.day_blocks(v.bars_day(spark, sf), 4), 4, embargo=2).toPandas()
    for _, g in f.groupby("fold"):
        tr, em, te = (g[g["role"] == r]["et_date"] for r in ("train", "embargo", "test"))
        assert len(em) == 2 and tr.max() < em.min() and em.max() < te.min()


def test_model_reports(spark):
    from tapeline.plans import models as M

    d = M.usable(spark, "/root/testdata/sf0.01")
    scored = ML.fit_score(d.filter(F.col("et_date") < M.SPLIT), d.filter(F.col("et_date") > M.SPLIT), ML.FEATURES, trees=5)
    report = ML.fold_report(scored, ["symbol"])
    rows = report.collect()
    assert rows and all(r["auc"] is None or 0 <= r["auc"] <= 1 for r in rows)
    # the AUC again, pair by pair
    own = [(r.prob, r.label) for r in scored.filter(F.col("symbol") == rows[0]["symbol"]).select("prob", "label").collect()]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in own for b, y in own if x == 1 and y == 0]
    assert abs(sum(pairs) / len(pairs) - rows[0]["auc"]) < 1e-9
    checks = ML.report_checks(report).collect()
    assert all(r["prob_ok"] and r["auc_ok"] and 0 <= r["n_pos"] <= r["n"] for r in checks)
    assert all(0.5 <= r["prob"] <= 1 for r in ML.gate(scored, 0.5).select("prob").collect())


def test_fits_side_by_side_keep_their_order():
    assert ML.side_by_side([lambda k=k: k * k for k in range(20)]) == [k * k for k in range(20)]


def test_portfolio_conserves_cash(spark, sf):
    """The path ends at capital plus the profits of all trades."""
    from tapeline.operators import settle as S

    b = v.with_pos(v.bars_1h(spark, sf))
    t = S.bracket(S.forward_paths(S.momentum_entries(b, 0.3), 6, F.col("direction") == 1), 0.2, 0.1)
    t = t.select("symbol", F.col("pos").alias("entry_pos"), "exit_pos", "entry_px", F.lit(100.0).alias("alloc"), "ret").cache()
    end = S.portfolio_path(t, b, 1000.0).orderBy(F.desc("ts")).first()
    assert abs(end["equity"] - (1000 + t.agg(F.sum(F.col("ret") * 100)).first()[0])) < 1e-6 and end["n_open"] == 0


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


def test_range_count(spark):
    """Open below, closed above, equal left rows kept apart, empty ranges zero."""
    from tapeline.operators.asof import range_count

    h = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    left = spark.createDataFrame([("k", h(0), h(5)), ("k", h(0), h(5)), ("k", h(3), h(40)), ("z", h(0), h(5))], "k string, a timestamp_ntz, b timestamp_ntz")
    right = spark.createDataFrame([("k", h(0), 1.0), ("k", h(3), 2.0), ("k", h(5), 4.0), ("k", h(30), 8.0)], "k string, t timestamp_ntz, x double").withColumn("one", F.lit(1))
    got = sorted((r["k"], r["a"], r["n"], r["s"]) for r in range_count(left, right, "k", "a", "b", "t", {"n": "one", "s": "x"}, unit="hour").collect())
    assert got == [("k", h(0), 2.0, 6.0), ("k", h(0), 2.0, 6.0), ("k", h(3), 2.0, 12.0), ("z", h(0), 0.0, 0.0)]
