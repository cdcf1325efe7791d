"""Dataset, fold and model queries. Model outputs have no SQL twin; tests check their properties."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times as tm
from ..operators import models as ML
from ..operators import rolling as R
from ..operators import settle as S
from ..operators import spread
from ..session import cut, run_dir
from ..sources.tables import table
from . import aggregates as g
from . import sequences as q
from . import views as v
from .projections import IRET
from .registry import query
from .windows import BW, PW

EVENTS = f"SELECT symbol, trough_pos + 2 AS confirm_pos, max((peak_p - trough_p) / peak_p) AS drop_pct FROM ({q.VCAND}) WHERE x = 0.3 GROUP BY 1, 2"
LAB = q.LABEL.replace(f"({q.MOM})", "(SELECT symbol, ts, et_date, pos, open, 1 AS direction FROM {{bars_15m}})").replace("1.4", "1.5").replace("0.7", "0.5")
DS = f"""WITH f0 AS (SELECT *, {IRET} AS iret FROM {{{{bars_15m}}}}), f AS (SELECT b.symbol, b.pos, b.ts, b.et_date, CASE WHEN count(iret) OVER w20 >= 10 THEN stddev_samp(iret) OVER w20 END AS rv20, CASE WHEN count(b.volume) OVER p20 >= 10 THEN b.volume / avg(b.volume) OVER p20 END AS vol_ratio,
      row_number() OVER wd - 1 AS bars_since_open, b.close / first_value(b.open) OVER wd - 1 AS open_to_now, d.prev_day_ret FROM f0 b LEFT JOIN (SELECT symbol, et_date, lag(close, 1) OVER ({PW}) / lag(close, 2) OVER ({PW}) - 1 AS prev_day_ret FROM {{{{bars_day}}}}) d ON d.symbol = b.symbol AND d.et_date = b.et_date
      WINDOW w20 AS (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p20 AS (PARTITION BY b.symbol ORDER BY b.ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), wd AS (PARTITION BY b.symbol, b.et_date ORDER BY b.ts)),
    lb AS MATERIALIZED ({LAB}), ev AS MATERIALIZED ({EVENTS})
    SELECT ev.symbol, ev.confirm_pos, f.ts AS confirm_ts, f.et_date AS confirm_date, CASE WHEN n.pos IS NULL THEN 'entry_beyond_data' WHEN n.et_date <> f.et_date THEN 'entry_next_day' WHEN lb.label IS NULL THEN 'label_unresolved' ELSE 'ok' END AS status,
    CASE WHEN n.et_date = f.et_date THEN lb.label END AS label, rv20, vol_ratio, bars_since_open, open_to_now, prev_day_ret, drop_pct FROM ev JOIN f ON f.symbol = ev.symbol AND f.pos = ev.confirm_pos LEFT JOIN {{{{bars_15m}}}} n ON n.symbol = ev.symbol AND n.pos = ev.confirm_pos + 1 LEFT JOIN lb ON lb.symbol = ev.symbol AND lb.pos = ev.confirm_pos + 1"""
FD = "rv20 vol_ratio open_to_now prev_day_ret drop_pct"
OUT = ["symbol", "confirm_pos", "status", "label", *ML.FEATURES]


def dataset(spark, sf):
    bars = v.with_pos(v.bars_15m(spark, sf))
    ev = q.v_cands(spark, sf, bars).filter("x = 0.3").groupBy("symbol", (F.col("trough_pos") + q.LF).alias("confirm_pos")).agg(F.max((F.col("peak_p") - F.col("trough_p")) / F.col("peak_p")).alias("drop_pct"))
    return ML.event_dataset(ev, bars, v.bars_day(spark, sf), 0.5, 0.5, 8)


def usable(spark, sf):
    """The labelled rows, written once: several fits read them."""
    return cut(dataset(spark, sf).filter("status = 'ok'").withColumnRenamed("confirm_date", "et_date"), "dataset")


@query("ml_01_dataset", f"SELECT {', '.join(OUT)} FROM ({DS})", dbl=FD, dp=7)
def ml_01(spark, sf):
    return dataset(spark, sf).select(*OUT)


@query("ml_01_drop_counts", f"SELECT symbol, status, count(*) AS n FROM ({DS}) GROUP BY 1, 2")
def ml_01b(spark, sf):
    return ML.drop_counts(dataset(spark, sf))


REL = f"SELECT symbol, close_time AS published, 100.0 * (volume / lag(volume) OVER ({PW}) - 1) AS change_pct FROM {{{{bars_day}}}}"


@query("ml_02_intel_features", f"""WITH d AS MATERIALIZED (SELECT *, confirm_ts + INTERVAL 15 MINUTE AS t, CAST(((confirm_ts + INTERVAL 15 MINUTE) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS td FROM ({DS})), p AS (SELECT ts, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS pd FROM events WHERE event_type = 'view'),
    c AS (SELECT min(pd) AS a, max(pd) AS z FROM p), k AS (SELECT d.symbol, d.confirm_pos, count(p.ts) AS n FROM d LEFT JOIN p ON p.pd = d.td AND p.ts <= d.t GROUP BY 1, 2)
    SELECT d.symbol, d.confirm_pos, r.change_pct AS si_chg_recent, (epoch_us(d.t) - epoch_us(r.published)) / 86400000000.0 AS si_days_since, CASE WHEN d.td > c.a AND d.td < c.z THEN k.n END AS daily_posts FROM d ASOF LEFT JOIN ({REL}) r ON r.symbol = d.symbol AND d.t >= r.published JOIN k ON k.symbol = d.symbol AND k.confirm_pos = d.confirm_pos, c""", dbl="si_chg_recent si_days_since", dp=6)
def ml_02(spark, sf):
    w = W.partitionBy("symbol").orderBy("et_date")
    rel = v.bars_day(spark, sf).select("symbol", F.col("close_time").alias("published"), (100.0 * (F.col("volume") / F.lag("volume").over(w) - 1)).alias("change_pct"))
    posts = table(spark, sf, "events", F.col("ts").alias("post_ts"), F.col("event_id").alias("post_id"), "event_type").filter("event_type = 'view'").drop("event_type")
    return ML.intel_features(dataset(spark, sf), rel, posts, 15).select("symbol", "confirm_pos", "si_chg_recent", "si_days_since", "daily_posts")


SPLIT = "2024-01-20"


COUNTS = "count(*) AS n, sum(label)::BIGINT AS n_pos, TRUE AS prob_ok, TRUE AS auc_ok"


@query("ml_03_gbt", f"SELECT symbol, {COUNTS} FROM ({DS}) WHERE status = 'ok' AND confirm_date > DATE '{SPLIT}' GROUP BY 1")
def ml_03(spark, sf):
    d = usable(spark, sf)
    s = ML.fit_score(d.filter(F.col("et_date") < SPLIT), d.filter(F.col("et_date") > SPLIT), ML.FEATURES)
    return ML.report_checks(ML.fold_report(s, ["symbol"]))


FOLDS = """WITH b AS (SELECT et_date, ntile(6) OVER (ORDER BY et_date) - 1 AS block FROM (SELECT DISTINCT et_date FROM {{bars_day}})), x AS (SELECT et_date, block, fold FROM b, (SELECT unnest([1, 2, 3, 4, 5]) AS fold) WHERE block <= fold)
    SELECT fold, et_date, CASE WHEN block = fold THEN 'test' WHEN row_number() OVER (PARTITION BY fold, block = fold ORDER BY et_date DESC) <= 1 THEN 'embargo' ELSE 'train' END AS role FROM x"""


@query("ml_04_walk_forward_folds", FOLDS)
def ml_04(spark, sf):
    return ML.walk_forward(ML.day_blocks(v.bars_day(spark, sf), 5), 5)


@query("ml_04_walk_forward_fit", f"""WITH ds AS MATERIALIZED (SELECT * FROM ({DS}) WHERE status = 'ok'), b AS (SELECT confirm_date, ntile(3) OVER (ORDER BY confirm_date) - 1 AS fold FROM (SELECT DISTINCT confirm_date FROM ds))
    SELECT fold::INT AS fold, {COUNTS} FROM ds JOIN b USING (confirm_date) WHERE fold > 0 GROUP BY 1""")
def ml_04b(spark, sf):
    d = usable(spark, sf)
    roles = ML.walk_forward(ML.day_blocks(d, 2), 2)

    def fold(k):
        part = d.join(F.broadcast(roles.filter(F.col("fold") == k)), "et_date")  # one row per calendar day
        return lambda: ML.fit_score(part.filter("role = 'train'"), part.filter("role = 'test'"), ML.FEATURES)

    one, two = ML.side_by_side([fold(1), fold(2)])
    return ML.report_checks(ML.fold_report(one.unionByName(two), ["fold"]))


@query("ml_05_leave_one_out", f"SELECT symbol, {COUNTS} FROM ({DS}) WHERE status = 'ok' GROUP BY 1")
def ml_05(spark, sf):
    d = usable(spark, sf)
    symbols = [r[0] for r in d.select("symbol").distinct().orderBy("symbol").collect()]  # one name per model to fit
    return ML.report_checks(ML.fold_report(ML.leave_one_out(d, "symbol", symbols, ML.FEATURES), ["symbol"]))


@query("ml_06_rolling_folds")
def ml_06(spark, sf):
    """Expanding training, a gate at the training top half, three variants settled without overlap."""
    from ..operators.metrics import path_stats

    d = usable(spark, sf)
    bars = v.with_pos(v.bars_15m(spark, sf))
    off = R.bear_switches(v.bars_day(spark, sf), long=5, short=3, high=5, dd=-0.5).select("symbol", "et_date", "s2_off")
    paths = S.forward_paths(bars.withColumn("direction", F.lit(1)), 8, F.lit(True)).select("symbol", "pos", "direction", "path")
    folds = ML.rolling_folds(d, "2024-01-12", 9, 2).collect()  # the fold table: one row per model
    out = None
    before = [ML.as_doubles(d.filter(F.col("et_date") < F.date_sub(F.lit(f["start"]), 1)), ML.FEATURES) for f in folds]
    models = ML.side_by_side([lambda x=x: ML.gbt(ML.FEATURES).fit(x) for x in before])
    for f, train, model in zip(folds, before, models):
        test = d.filter(F.col("et_date").between(f["start"], f["end"]))
        thr = spread.quantiles(ML.score(model, train), [], "prob", t=0.5)
        s = ML.score(model, ML.as_doubles(test, ML.FEATURES)).withColumn("thr", thr.scalar()).join(off, ["symbol", "et_date"], "left")
        ok = F.col("prob") >= F.col("thr")
        var = F.array(F.struct(F.lit("ungated").alias("variant"), F.lit(True).alias("on")), F.struct(F.lit("gated").alias("variant"), ok.alias("on")),
                      F.struct(F.lit("gated_switch").alias("variant"), (ok & ~F.coalesce("s2_off", F.lit(False))).alias("on")))
        e = s.withColumn("_v", F.explode(var)).filter("_v.on").select("symbol", "et_date", (F.col("confirm_pos") + 1).alias("pos"), "_v.variant").withColumn("fold", F.lit(f["fold"]))
        out = e if out is None else out.unionByName(e)
    t = S.bracket(out.join(paths, ["symbol", "pos"]), 0.5, 0.5).withColumn("ret", F.col("ret") * 0.0005).select("symbol", "et_date", "pos", "variant", "fold", "exit_pos", "ret")
    k = S.non_overlap(t, ["symbol", "variant", "fold"], "pos", "exit_pos", "et_date")
    return path_stats(k.withColumn("order", F.struct("pos", "symbol")), ["fold", "variant"], "et_date", "order")


WALK = f"""WITH t AS MATERIALIZED (SELECT g.*, o, n FROM ({g.GEO_SQL}) g JOIN (SELECT symbol, et_date, row_number() OVER (PARTITION BY symbol ORDER BY et_date) - 1 AS o, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT DISTINCT symbol, et_date FROM ({g.GEO_SQL}))) USING (symbol, et_date)),
    f AS (SELECT DISTINCT symbol, fold FROM (SELECT symbol, n FROM t), (SELECT unnest(range(40)) AS fold) WHERE fold * 5 + 10 < n), tr AS (SELECT t.symbol, fold, tp, sl, round(product(1 + ret) - 1, 12) AS train_return, count(*) AS train_trades FROM t JOIN f USING (symbol) WHERE o >= fold * 5 AND o < fold * 5 + 10 GROUP BY 1, 2, 3, 4),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY (train_trades >= 50)::INT DESC, train_return DESC, tp DESC, sl DESC) AS rn FROM tr) WHERE rn = 1),
    te AS (SELECT t.symbol, fold, tp, sl, product(1 + ret) - 1 AS test_return, count(*) AS test_trades FROM t JOIN f USING (symbol) WHERE o >= fold * 5 + 10 AND o < fold * 5 + 15 GROUP BY 1, 2, 3, 4)
    SELECT b.symbol, b.fold, b.tp, b.sl, train_return, train_trades, test_return, test_trades FROM b LEFT JOIN te USING (symbol, fold, tp, sl)"""


@query("ml_07_parameter_walk", WALK, dbl="tp sl train_return test_return", dp=8)
def ml_07(spark, sf):
    return ML.parameter_walk(g.geo_trades(spark, sf), ["tp", "sl"], 10, 5, 50)


@query("ml_08_batch_inference")
def ml_08(spark, sf):
    """A stored model and a stored threshold applied to new rows."""
    d = ML.as_doubles(usable(spark, sf), ML.FEATURES)
    m = ML.gbt(ML.FEATURES).fit(d.filter(F.col("et_date") < SPLIT))
    m = ML.save_and_load(m, run_dir(spark, "model"))
    return ML.gate(ML.score(m, d.filter(F.col("et_date") >= SPLIT)), 0.5).select("symbol", "confirm_pos", "prob", "label")


SIGF = ["rv20", "vol_ratio", "open_to_now", "drop_pct"]
SIG_U = " UNION ALL ".join(f"SELECT '{f}' AS feature, label, {f} AS x FROM ds WHERE {f} IS NOT NULL" for f in SIGF)
SIG = f"""WITH ds AS MATERIALIZED (SELECT * FROM ({DS}) WHERE status = 'ok'), u AS ({SIG_U}), a AS (SELECT feature, count(*) FILTER (WHERE label = 1) AS n_true, count(*) FILTER (WHERE label = 0) AS n_false, avg(x) FILTER (WHERE label = 1) AS mean_true, avg(x) FILTER (WHERE label = 0) AS mean_false, quantile_cont(x, 0.5) FILTER (WHERE label = 1) AS median_true,
    quantile_cont(x, 0.5) FILTER (WHERE label = 0) AS median_false FROM u GROUP BY 1), r AS (SELECT feature, sum(CASE WHEN label = 1 THEN rk END) AS r1, count(*)::DOUBLE AS n, sum(tie * tie - 1)::DOUBLE AS t FROM (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY feature, x) AS tie FROM u) GROUP BY 1)
    SELECT a.*, (abs(r1 - n_true * (n_true + 1) / 2.0 - n_true * n_false / 2.0) - 0.5) / sqrt(n_true::DOUBLE * n_false / 12 * ((n + 1) - t / (n * (n - 1)))) AS z FROM a JOIN r USING (feature)"""


@query("ml_09_signature", SIG, dbl="mean_true mean_false median_true median_false z", dp=6)
def ml_09(spark, sf):
    return ML.signature(dataset(spark, sf).filter("status = 'ok'"), SIGF)


@query("ml_10_day_split", "SELECT symbol, ts, CASE WHEN dr <= floor(n * 0.7) THEN 'train' ELSE 'valid' END AS part FROM (SELECT symbol, ts, et_date, dense_rank() OVER (PARTITION BY symbol ORDER BY et_date) AS dr, (SELECT count(DISTINCT et_date) FROM {{bars_1h}} x WHERE x.symbol = b.symbol) AS n FROM {{bars_1h}} b) WHERE floor(n * 0.7) >= 5 AND n - floor(n * 0.7) >= 3")
def ml_10(spark, sf):
    return ML.day_split(v.bars_1h(spark, sf)).select("symbol", "ts", "part")
