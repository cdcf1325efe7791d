"""Zigzag pruning, turning points and the no-look-ahead property."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.operators import chain as C
from tapeline.operators import packed
from tapeline.operators import patterns as P
from tapeline.operators import rolling as R
from tapeline.operators import select as SL


def scan(px, theta):
    """Plain percent-reversal scan, written apart from the library."""
    piv, state, start, best = [], None, px[0], 0
    for i in range(1, len(px)):
        if state is None:
            if abs(px[i] / start - 1) >= theta:
                state, best = ("up" if px[i] > start else "down"), i
        elif state == "up":
            if px[i] > px[best]:
                best = i
            elif (px[best] - px[i]) / px[best] >= theta:
                piv.append((best, "H"))
                state, best = "down", i
        else:
            if px[i] < px[best]:
                best = i
            elif (px[i] - px[best]) / px[best] >= theta:
                piv.append((best, "L"))
                state, best = "up", i
    piv.append((best, "H" if state == "up" else "L"))
    if piv[0][0] != 0:
        piv.insert(0, (0, "H" if state == "down" else "L"))
    return piv


@pytest.mark.parametrize("seed", range(4))
def test_zigzag_equals_scan(spark, seed):
    rng = np.random.default_rng(seed)
    n = 600
    px = np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), 1)  # rounding makes ties
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=int(i // 37)) for i in range(n)]
    ts = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(i)) for i in range(n)]
    d = spark.createDataFrame([("s", day[i], i, ts[i], float(px[i])) for i in range(n)], "symbol string, et_date date, pos bigint, ts timestamp_ntz, close double").repartition(6)
    got = P.zigzag(d, [0.02, 0.05, 0.1]).toPandas()
    for th in (0.02, 0.05, 0.1):
        g = got[got["theta"] == th].sort_values("n")
        assert list(zip(g["pos"], g["kind"])) == scan(px, th)


def test_zigzag_of_one_symbol_runs_in_blocks(spark):
    """Many days of one symbol, blocks of 50 bars composed four at a time, against the scan; no task sees more than a block."""
    rng = np.random.default_rng(8)
    n = 3000
    px = np.round(80 * np.exp(np.cumsum(rng.normal(0, 0.03, n))), 1) + 0.5
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i // 20), i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(px[i])) for i in range(n)]
    d = spark.createDataFrame(rows, "symbol string, et_date date, pos bigint, ts timestamp_ntz, close double").repartition(7)
    before, C.FAN = C.FAN, 4
    try:
        got = P.zigzag(d, [0.05, 0.3], size=50).toPandas()
    finally:
        C.FAN = before
    for th in (0.05, 0.3):
        g = got[got["theta"] == th].sort_values("n")
        assert list(zip(g["pos"], g["kind"])) == scan(px.tolist(), th)
        assert g["n"].tolist() == list(range(len(g))) and (g["price"].to_numpy() == px[g["pos"]]).all()
        assert [t.to_pydatetime() for t in g["ts"]] == [rows[i][3] for i in g["pos"]]


def test_zigzag_without_a_move(spark):
    rows = [("flat", dt.date(2024, 1, 1), i, dt.datetime(2024, 1, 1, i), 10.0 + i % 2) for i in range(9)] + [("one", dt.date(2024, 1, 1), 0, dt.datetime(2024, 1, 1), 5.0)]
    rows += [("late", dt.date(2024, 1, 1), i, dt.datetime(2024, 1, 1, i), p) for i, p in enumerate([10.0, 10.0, 20.0])]
    d = spark.createDataFrame(rows, "symbol string, et_date date, pos bigint, ts timestamp_ntz, close double")
    got = sorted((r.symbol, r.n, r.pos, r.kind) for r in P.zigzag(d, [0.5]).collect())
    assert got == [("flat", 0, 0, "L"), ("late", 0, 0, "L"), ("late", 1, 2, "H"), ("one", 0, 0, "L")]


@pytest.mark.parametrize("seed", range(3))
def test_turn_maps_compose_like_the_walk(seed):
    """Maps of blocks, composed from either side, give what walking gives, from any state, equal prices and rule edges included."""
    rng = np.random.default_rng(seed)
    for _ in range(60):
        n, th = int(rng.integers(5, 300)), float(rng.choice([0.02, 0.1, 0.5, 0.8]))
        px = np.round(50 * np.exp(np.cumsum(rng.normal(0, rng.choice([0.005, 0.05, 0.5]), n))), int(rng.integers(0, 3))) + 0.5
        size = int(rng.integers(1, 40))
        parts = [(px[b : b + size], np.arange(b, min(b + size, n), dtype=float)) for b in range(0, n, size)]
        maps = [C.turn_map(p, q, th) for p, q in parts]
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = C.turn_compose(left, m)
        for m in maps[-2::-1]:
            right = C.turn_compose(m, right)
        for _ in range(8):
            state = (float(rng.choice([-1, 1])), float(rng.choice(px) * rng.choice([0.5, 1, 1, 2])), -1.0)
            want = state
            for p, q in parts:
                want = C.turns_in_block(p, q, th, want)[1]
            for m in (left, right):
                assert tuple(C.turn_after(np.array(state), m)) == tuple(want)


def turn_scan(rows, sign, c):
    """Turning points of candidates (d, price, price between), written apart from the library."""
    clusters = []
    for d, px, mid in rows:
        if clusters and d - clusters[-1]["last"] <= c["gap"]:
            low = clusters[-1]["low"][1]
            if (mid < low * (1 + c["band"])) if sign > 0 else (mid > low * (1 - c["band"])):
                clusters[-1]["last"] = d
                if (px < low) if sign > 0 else (px > low):
                    clusters[-1]["low"] = (d, px)
                continue
        clusters.append({"last": d, "low": (d, px)})
    out = []
    for d, px in (x["low"] for x in clusters):
        if not out or d - out[-1][0] > c["wave"]:
            out.append((d, px))
            continue
        change = (px / out[-1][1] - 1) * sign
        if change < -c["wave_band"]:
            out.append((d, px))
        elif change <= c["wave_band"] and ((px < out[-1][1]) if sign > 0 else (px > out[-1][1])):
            out[-1] = (d, px)
    return [d for d, _ in out]


@pytest.mark.parametrize("sign", [1, -1])
def test_turning_points_by_chains_equal_scan(spark, sign):
    rng = np.random.default_rng(4)
    n = 1500
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.05, n)))
    d = spark.createDataFrame([("s", i, float(px[i])) for i in range(n)], "symbol string, d bigint, close double")
    got = sorted(r.d for r in P.turning_points(d, sign, 0.1).collect())
    s = pd.Series(px) * sign
    prior = s.rolling(60).max().shift(1) * sign
    local = s == s.rolling(11, center=True, min_periods=1).min()
    far = (px / prior - 1) * sign <= -0.1 if sign > 0 else px / prior - 1 >= 0.1
    at = np.flatnonzero(far & local & prior.notna()).tolist()
    ext = max if sign > 0 else min
    rows = [(i, px[i], ext(px[j : i + 1])) for j, i in zip([at[0], *at], at)]
    assert len(at) > 20 and got == turn_scan(rows, sign, P.TURN)


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(5)
    n = 300
    base = pd.DataFrame({"symbol": "s", "et_date": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)], "d": range(n), "volume": rng.integers(1, 9, n).astype(float)})
    base["close"] = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    base["open"], base["high"], base["low"] = base["close"], base["close"] * 1.01, base["close"] * 0.99
    other = base.copy()
    other.loc[250:, "close"] *= 3
    cols = ["d", "dd_60", "vol20_ann", "volume_pct", "s2_off", "vol_pct", "scale"]

    def feats(pdf):
        d = spark.createDataFrame(pdf)
        return R.vol_scale(R.vol_regime(R.bear_switches(R.pit_features(d)))).filter("d < 250").select(*cols).toPandas().sort_values("d").reset_index(drop=True)

    pd.testing.assert_frame_equal(feats(base), feats(other))


def title_scan(rows, jac=0.6):
    import re

    reps, out = {}, {}
    for day, i, title in sorted(rows):
        words = re.findall("[a-z0-9]+", title.lower())
        key, w = " ".join(words), set(words)
        hit = None
        for r, rk, rw in reps.get(day, []):
            if not w or not rw:
                continue
            near = len(w & rw) / len(w | rw) >= jac
            pre = len(key) >= 20 and len(rk) >= 20 and (key.startswith(rk) or rk.startswith(key))
            if near or pre:
                hit = r
                break
        if hit is None:
            reps.setdefault(day, []).append((i, key, w))
            out[(day, i)] = 0
        else:
            out[(day, hit)] += 1
    return out


@pytest.mark.parametrize("growth", [1, 2, 16])
def test_near_duplicates_equal_scan(spark, growth):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(30)]
    stock = [" ".join(rng.choice(vocab, 7)) for _ in range(12)]
    rows = []
    for i in range(160):
        t = stock[0] if rng.random() < 0.35 else stock[rng.integers(12)]
        words = t.split()
        if rng.random() < 0.6:
            words[rng.integers(7)] = f"u{i}"  # near copies, each with a word of its own
        rows.append((dt.date(2024, 1, 1 + i % 2), i, " ".join(words)))
    d = spark.createDataFrame(rows, "day date, id bigint, title string").withColumn("source", F.lit("s"))
    got = {(r["day"], r["rep"]): r["dup_n"] for r in SL.near_duplicates(d, growth=growth).collect()}
    assert got == title_scan(rows)


def test_whole_titles_are_written_once_and_move_only_with_pairs_that_begin_alike(spark, monkeypatch):
    """Titles of one word set are found by their words; of two that begin alike one is a head of the other, one is not."""
    head = "one two three four five six"
    texts = [f"alpha beta gamma w{i} w{i + 1}" for i in range(6)] + [head, f"{head} " + " ".join(f"a{i}" for i in range(30)), f"{head} " + " ".join(f"b{i}" for i in range(30)), "one two three four f"]
    rows = [(0, i, t) for i, t in enumerate(texts)]
    written, cut = {}, SL.cut
    monkeypatch.setattr(SL, "cut", lambda df, name: written.setdefault(name, []).append(cut(df, name)) or written[name][-1])
    d = spark.createDataFrame(rows, "day int, id long, title string").withColumn("source", F.lit("s"))
    assert {(r["day"], r["rep"]): r["dup_n"] for r in SL.near_duplicates(d).collect()} == title_scan(rows)
    assert [set(written[n][0].columns) for n in ("words", "titles")] == [{"day", "id", "source", "k"}, {"day", "id", "k"}]
    assert "k" not in written["texts"][0].columns and all(set(p.columns) == {"id", "rep", "same", "alike"} for p in written["pairs"])


def test_near_duplicates_of_mixed_lengths_equal_scan(spark):
    """Short and long titles of few words, so that many pairs lie near the limit; heads of 20 characters; blank titles."""
    rng = np.random.default_rng(6)
    vocab = [f"v{i}" for i in range(14)]
    rows = []
    for i in range(260):
        words = list(rng.choice(vocab, rng.integers(1, 14), replace=False))
        if rng.random() < 0.3:
            words = "alpha beta gamma delta".split() + words[: rng.integers(0, 6)]
        rows.append((dt.date(2024, 1, 1 + i % 2), i, "" if rng.random() < 0.03 else " ".join(words)))
    d = spark.createDataFrame(rows, "day date, id bigint, title string").withColumn("source", F.lit("s"))
    assert {(r["day"], r["rep"]): r["dup_n"] for r in SL.near_duplicates(d).collect()} == title_scan(rows)


def test_near_duplicates_under_a_frequent_word(spark):
    """10,000 titles of one day share a word without being alike, a crowd of 1,000 near copies beside them."""
    rows = [(dt.date(2024, 1, 1), i, f"market x{i} y{i}") for i in range(10_000)]
    rows += [(dt.date(2024, 1, 1), 20_000 + i, f"market opens much higher on strong bank results u{i}") for i in range(1_000)]
    d = spark.createDataFrame(rows, "day date, id bigint, title string").withColumn("source", F.lit("s"))
    got = {r["rep"]: r["dup_n"] for r in SL.near_duplicates(d).collect()}
    assert got == {**dict.fromkeys(range(10_000), 0), 20_000: 999}


def test_near_duplicates_leave_no_shuffle_files(spark):
    """What a step has shuffled goes with the step, and only titles, words' hashes and keys are written."""
    rows = [(dt.date(2024, 1, 1), i, " ".join(f"w{(i * 7 + j * j) % 900}" for j in range(40))) for i in range(300)]
    d = spark.createDataFrame(rows, "day date, id bigint, title string").withColumn("source", F.lit("s"))
    files = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    conf = {k: spark.conf.get(k, None) for k in ("spark.sql.parquet.compression.codec", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")}
    before = files()
    got = SL.near_duplicates(d)
    assert files() <= before and conf == {k: spark.conf.get(k, None) for k in conf}
    assert {(r["day"], r["rep"]): r["dup_n"] for r in got.collect()} == title_scan(rows)


def test_titles_that_match_meet_at_a_key_and_in_their_signatures():
    """Over blocks and parts: pairs of 0.6 or more share a key whose places leave enough words, and their signatures differ in no more bits than words."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool[: rng.integers(30, 400)], n, replace=False)) for n in rng.integers(1, 60, 60)]
    sets += [np.sort(np.concatenate([rng.choice(s, max(1, int(len(s) * 0.8)), replace=False), rng.integers(0, 2**64, 2, dtype=np.uint64)])) for s in sets]

    def block(g, ids):
        none = np.zeros(len(ids), "<i4").tobytes()
        ns = np.array([len(sets[i]) for i in ids], "<i4").tobytes()
        return {"g": g, "ids": np.array(ids, "<i8").tobytes(), "ns": ns, "words": packed.steps(np.concatenate([sets[i] for i in ids]), 8), "heads": b"", "hs": none}

    blocks = [block(g, list(range(g, len(sets), 3))) for g in range(3)]
    batch = lambda rows: iter([pa.RecordBatch.from_pylist(rows)])
    by_part = lambda bs: [pa.Table.from_pylist(v) for v in {p: [r for r in rows if r["part"] == p] for rows in [[r for b in bs for r in b.to_pylist()]] for p in {r["part"] for r in rows}}.values()]
    rare = [r for t in by_part(packed.seen(5)(batch(blocks))) for r in packed.rarity(t).to_pylist()]
    blocks = [b | {"rarity": [r for r in rare if r["g"] == b["g"]]} for b in blocks]
    kept = [r for b in packed.prefixes(0.6)(batch(blocks)) for r in b.to_pylist()]
    parts = by_part(packed.sent(6, 0.6, 0)(batch(kept)))
    whole, steps = ([r for t in parts for r in packed.meet(0.6, first)(t).to_pylist()] for first in (1000, 2))
    meet = {(r["id"], r["rep"]) for r in whole}
    assert all(r["rep"] is not None and r["rep"] < r["id"] for r in whole)
    at, soon = {}, {(r["id"], r["rep"]) for r in steps if r["rep"] is not None}
    for r in steps:
        if r["rep"] is None:
            at.setdefault(r["key"], []).append(r)
    later = {(a["id"], b["id"]) for v in at.values() for a in v for b in v if b["rank"] < a["rank"] and packed.can_match(a["n"], a["at"], b["n"], b["at"], 0.6)}
    assert at and soon < meet and soon | later == meet and all(sorted(x["rank"] for x in v) == list(range(2, len(v) + 2)) for v in at.values())
    sigs = {r["id"]: r["sig"] for b in packed.signatures(batch(blocks)) for r in b.to_pylist()}
    alike = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            inter = len(np.intersect1d(a, b))
            assert packed.apart(sigs[i], sigs[j]) <= len(a) + len(b) - 2 * inter
            if i > j and inter >= 0.6 * (len(a) + len(b) - inter):
                assert (i, j) in meet
                alike += 1
    assert alike > 30
