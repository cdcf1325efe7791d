"""Sorts, limits, top-k and set operations."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import select as SL
from ..operators import store as E
from ..sources.tables import table
from . import aggregates as g
from . import sequences as q
from . import views as v
from .projections import KEY_SQL
from .registry import query


@query("top_01_largest_drops", f'SELECT theta, "X", "Y", symbol, peak_pos, trough_pos, drop_pct, rebound_pct FROM ({q.HLH}) QUALIFY row_number() OVER (PARTITION BY theta, "X", "Y" ORDER BY drop_pct DESC, rebound_pct DESC, symbol, peak_pos) <= 10', dbl="theta X Y drop_pct rebound_pct", dp=7)
def top_01(spark, sf):
    """The ten largest drops of every setting; the limit runs inside each task before rows move."""
    e = q.hlh(spark, sf).select("theta", "X", "Y", "symbol", "peak_pos", "trough_pos", "drop_pct", "rebound_pct")
    place = F.row_number().over(W.partitionBy("theta", "X", "Y").orderBy(F.desc("drop_pct"), F.desc("rebound_pct"), "symbol", "peak_pos"))
    return e.withColumn("_n", place).filter("_n <= 10").drop("_n")


COMBO = f"""SELECT symbol, tp, sl, count(*) FILTER (WHERE seg = 't') AS train_n, avg((ret > 0)::INT) FILTER (WHERE seg = 't') AS train_wr, avg(ret) FILTER (WHERE seg = 't') * 1e4 AS train_bp, count(*) FILTER (WHERE seg = 'h') AS hold_n,
    avg((ret > 0)::INT) FILTER (WHERE seg = 'h') AS hold_wr, avg(ret) FILTER (WHERE seg = 'h') * 1e4 AS hold_bp, product(1 + ret) AS final_equity FROM (SELECT *, CASE WHEN et_date < DATE '2024-01-16' THEN 't' ELSE 'h' END AS seg FROM ({g.GEO_SQL})) GROUP BY 1, 2, 3"""
CD = "train_wr train_bp hold_wr hold_bp final_equity tp sl"


def combos(spark, sf):
    t = g.geo_trades(spark, sf).withColumn("_t", F.col("et_date") < F.lit("2024-01-16").cast("date"))
    side = lambda c, name: [F.count(F.when(c, 1)).alias(f"{name}_n"), F.avg(F.when(c, (F.col("ret") > 0).cast("int"))).alias(f"{name}_wr"), (F.avg(F.when(c, F.col("ret"))) * 1e4).alias(f"{name}_bp")]
    return t.groupBy("symbol", "tp", "sl").agg(*side(F.col("_t"), "train"), *side(~F.col("_t"), "hold"), F.product(1 + F.col("ret")).alias("final_equity"))


@query("top_02_best_combo", f"SELECT symbol, tp, sl, final_equity FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY final_equity DESC, tp DESC) AS rn FROM ({COMBO})) WHERE rn = 1", dbl="tp sl final_equity", dp=7)
def top_02(spark, sf):
    return SL.best_by(combos(spark, sf), ["symbol"], F.col("final_equity"), ["tp"]).select("symbol", "tp", "sl", "final_equity")


@query("top_03_gated_best", f"SELECT symbol, tp, sl, train_n, train_bp FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY (train_n >= 560)::INT DESC, train_bp DESC, tp DESC) AS rn FROM ({COMBO})) WHERE rn = 1", dbl="tp sl train_bp", dp=7)
def top_03(spark, sf):
    return SL.gated_best(combos(spark, sf), ["symbol"], "train_n", "train_bp", 560, ["tp"]).select("symbol", "tp", "sl", "train_n", "train_bp")


@query("top_04_top_then_validate", f"SELECT symbol, tp, sl, train_bp AS train_score, hold_n, hold_bp FROM ({COMBO}) ORDER BY train_bp DESC, symbol, tp, sl LIMIT 5", dbl="tp sl train_score hold_bp", dp=7)
def top_04(spark, sf):
    c = combos(spark, sf)
    return SL.top_then_validate(c, c.select("symbol", "tp", "sl", "hold_n", "hold_bp"), ["symbol", "tp", "sl"], "train_bp", 5)


EDGES = [0.3, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 1.01]


@query("top_05_bucket_best", f"""SELECT bucket, symbol, tp, sl, hold_bp FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY hold_bp DESC, symbol DESC, tp DESC) AS rn FROM (SELECT *, CASE {' '.join(f'WHEN hold_wr >= {e} THEN {e}' for e in reversed(EDGES[:-1]))} END::DOUBLE AS bucket FROM ({COMBO})) WHERE bucket IS NOT NULL) WHERE rn = 1""", dbl="bucket tp sl hold_bp", dp=7)
def top_05(spark, sf):
    return SL.bucket_best(combos(spark, sf), "hold_wr", "hold_bp", EDGES, ["symbol", "tp"]).select("bucket", "symbol", "tp", "sl", "hold_bp")


@query("top_06_pareto", "WITH c AS (SELECT o_custkey AS k, count(*) AS freq, avg(o_totalprice) AS acc FROM orders GROUP BY 1) SELECT k, freq, acc FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.freq >= a.freq AND b.acc >= a.acc AND (b.freq > a.freq OR b.acc > a.acc))", dbl="acc", dp=5)
def top_06(spark, sf):
    c = table(spark, sf, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("freq"), F.avg("o_totalprice").alias("acc"))
    return SL.pareto(c, "freq", "acc")


@query("top_07_distinct_top", f"SELECT dup_key, symbol, hold_bp FROM (SELECT *, row_number() OVER (PARTITION BY dup_key ORDER BY hold_bp DESC, symbol DESC) AS rn FROM (SELECT *, CASE WHEN hit THEN 'single' ELSE symbol END || '|' || tp AS dup_key FROM (SELECT *, sl = 0.1 AS hit FROM ({COMBO})))) WHERE rn = 1 ORDER BY hold_bp DESC, symbol DESC LIMIT 5", dbl="hold_bp", dp=7)
def top_07(spark, sf):
    c = combos(spark, sf)
    k = F.concat(F.when(F.col("sl") == 0.1, "single").otherwise(F.col("symbol")), F.lit("|"), F.col("tp").cast("string"))
    return SL.distinct_top(c.withColumn("dup_key", k), "dup_key", 5, ["hold_bp", "symbol"]).select("dup_key", "symbol", "hold_bp")


@query("top_08_screen", f"SELECT symbol, tp, sl, coalesce(train_wr >= 0.3 AND train_bp >= 0 AND train_n >= 100, false) AS is_candidate, coalesce(train_wr >= 0.3 AND train_bp >= 0 AND train_n >= 100, false) AND coalesce(hold_n >= 100 AND hold_bp >= 0.5, false) AS holdout_pass FROM ({COMBO})", dbl="tp sl")
def top_08(spark, sf):
    return SL.screen(combos(spark, sf), {"train_wr": 0.3, "train_bp": 0, "train_n": 100}, {"hold_n": 100, "hold_bp": 0.5}).select("symbol", "tp", "sl", "is_candidate", "holdout_pass")


@query("set_01_union_channels", f"SELECT symbol, time, act, 'jump' AS channel FROM ({q.JUMPS}) UNION ALL SELECT symbol, time, act, 'dense' FROM ({q.DENSE_EV})")
def set_01(spark, sf):
    a = q.jump_events(spark, sf).withColumn("channel", F.lit("jump"))
    return a.unionByName(q.dense_events(spark, sf).select("symbol", "time", "act").withColumn("channel", F.lit("dense")))


@query("set_02_union_dedup", "SELECT symbol, ts, volume, any_value(close) AS close FROM {{bars_1h}} GROUP BY ALL")
def set_02(spark, sf):
    b = v.bars_1h(spark, sf).select("symbol", "ts", "volume", "close")
    return SL.union_dedup(b.filter("volume >= 2"), b.filter("volume <= 4"), ["symbol", "ts", "volume"])


@query("set_03_only_in", "SELECT symbol, ts FROM {{bars_1h}} WHERE volume > 1 EXCEPT ALL SELECT symbol, ts FROM {{bars_1h}} WHERE close > open")
def set_03(spark, sf):
    b = v.bars_1h(spark, sf)
    return SL.only_in(b.filter("volume > 1"), b.filter("close > open"), ["symbol", "ts"])


@query("set_04_overlap", "SELECT symbol, et_date FROM {{bars_day}} WHERE et_date < DATE '2024-01-20' INTERSECT SELECT symbol, et_date FROM {{bars_day}} WHERE et_date >= DATE '2024-01-10'")
def set_04(spark, sf):
    d = v.bars_day(spark, sf).select("symbol", "et_date")
    return d.filter("et_date < date'2024-01-20'").intersect(d.filter("et_date >= date'2024-01-10'"))


READ = f"SELECT doc_id AS event_id, CASE WHEN lang IN ('en', 'fr') THEN 'news_' || lang ELSE 'sc13d' END AS type, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 60) AS observed_time, array_to_string({KEY_SQL}, '') AS title_key FROM {{{{titles}}}}"


def reading(spark, sf):
    t = v.titles(spark, sf)
    from ..functions import times as tm

    return t.select(
        F.col("doc_id").alias("event_id"), F.when(F.col("lang").isin("en", "fr"), F.concat(F.lit("news_"), "lang")).otherwise("sc13d").alias("type"),
        tm.plus_seconds(F.lit("2024-01-01").cast("timestamp_ntz"), F.col("doc_id") * 60).alias("observed_time"), tx.title_key(F.col("title")).alias("title_key"))


@query("set_05_tier_capped", f"""WITH r AS ({READ}), l0 AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN title_key = '' THEN 'id' || event_id ELSE title_key END ORDER BY observed_time DESC, event_id DESC) AS rn FROM r WHERE type LIKE 'news_%'), lo AS (SELECT * FROM l0 WHERE rn = 1)
    SELECT event_id, type FROM (SELECT event_id, type FROM r WHERE type NOT LIKE 'news_%' ORDER BY observed_time DESC, event_id DESC LIMIT 60) UNION ALL SELECT event_id, type FROM (SELECT event_id, type FROM lo ORDER BY observed_time DESC, event_id DESC LIMIT 40)""")
def set_05(spark, sf):
    return E.select_for_reading(reading(spark, sf), ["news_"], 40, 60)[0].select("event_id", "type")


@query("set_05_truncated", f"""WITH r AS ({READ}) SELECT greatest((SELECT count(*) FROM r WHERE type NOT LIKE 'news_%') - 60, 0) AS hi_cut, greatest((SELECT count(DISTINCT CASE WHEN title_key = '' THEN 'id' || event_id ELSE title_key END) FROM r WHERE type LIKE 'news_%') - 40, 0) AS lo_cut""")
def set_05b(spark, sf):
    _, hi, lo = E.select_for_reading(reading(spark, sf), ["news_"], 40, 60)
    return hi.withColumnRenamed("c", "hi_cut").withColumn("lo_cut", lo.scalar())


WORDS = KEY_SQL
MATCH = "(len(list_intersect(rp.w, n.w)) >= 0.6 * (len(rp.w) + len(n.w) - len(list_intersect(rp.w, n.w))) OR (length(rp.k) >= 20 AND length(n.k) >= 20 AND (starts_with(rp.k, n.k) OR starts_with(n.k, rp.k))))"


@query("set_06_near_duplicates", f"""WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id AS id, et_date AS day, source, array_to_string({WORDS}, ' ') AS k, list_distinct({WORDS}) AS w, row_number() OVER (PARTITION BY et_date ORDER BY doc_id) AS n FROM {{{{titles}}}}),
    r AS (SELECT day, n, id, source, id AS rep, [{{'id': id, 'k': k, 'w': w}}] AS reps FROM t WHERE n = 1 UNION ALL
    SELECT day, n, id, source, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(reps, {{'id': id, 'k': k, 'w': w}}) ELSE reps END FROM (
      SELECT n.*, r.reps, CASE WHEN n.k <> '' THEN list_min(list_transform(list_filter(r.reps, lambda rp: rp.k <> '' AND {MATCH}), lambda rp: rp.id)) END AS hit FROM r JOIN t n ON n.day = r.day AND n.n = r.n + 1))
    SELECT day, rep, count(*) - 1 AS dup_n, coalesce(array_to_string(list_sort(list_distinct(list(source) FILTER (WHERE id <> rep))), ','), '') AS dup_sources FROM r GROUP BY day, rep""")
def set_06(spark, sf):
    t = v.titles(spark, sf).select(F.col("doc_id").alias("id"), F.col("et_date").alias("day"), "source", "title")
    return SL.near_duplicates(t)


@query("set_07_new_high_tier", "SELECT bool_or(tier IN ('T0', 'T1') AND observed_time > TIMESTAMP '2024-01-30 20:00:00') AS has_new_high FROM {{dated}}")
def set_07(spark, sf):
    return E.any_high_tier(v.dated(spark, sf), "2024-01-30 20:00:00")
