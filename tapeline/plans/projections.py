"""Projections, predicates and scalar functions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import finance as fin
from ..functions import hashing as hs
from ..functions import numeric as nm
from ..functions import scoring as sc
from ..functions import text as tx
from ..functions import times as tm
from ..operators import adjust as ad
from ..operators import bars as B
from ..operators import signals as sg
from ..operators import spread
from ..sources.tables import table
from . import views as v
from .registry import query
from .scans import ET_MIN

IRET = "close / lag(close) OVER (PARTITION BY symbol, et_date ORDER BY ts) - 1"


@query("prj_01_intraday_return", f"SELECT symbol, ts, {IRET} AS iret FROM {{{{bars_15m}}}}", dbl="iret")
def prj_01(spark, sf):
    return B.intraday_return(v.bars_15m(spark, sf)).select("symbol", "ts", "iret")


@query("prj_02_true_range", """SELECT symbol, ts, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM
    (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM {{bars_15m}})""", dbl="tr")
def prj_02(spark, sf):
    return B.true_range(v.with_pos(v.bars_15m(spark, sf))).select("symbol", "ts", "tr")


RV = f"""CASE WHEN count(iret) OVER w >= 10 THEN stddev_samp(iret) OVER w END AS rv20
    FROM (SELECT *, {IRET} AS iret FROM {{{{bars_15m}}}}) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


def with_rv20(bars):
    return spread.in_blocks(B.intraday_return(bars), "symbol", 19, 0, lambda r, w: r.withColumn("rv20", nm.guarded(F.stddev_samp, F.col("iret"), w.rowsBetween(-19, 0), 10)))


@query("prj_03_vol_normalised", f"SELECT symbol, ts, CASE WHEN rv20 <> 0 THEN iret / rv20 END AS iret_n FROM (SELECT symbol, ts, iret, {RV})", dbl="iret_n", dp=7)
def prj_03(spark, sf):
    return sg.normalised(with_rv20(v.with_pos(v.bars_15m(spark, sf))), ["iret"], "rv20").select("symbol", "ts", "iret_n")


@query("prj_04_entry_fill", "SELECT symbol, ts, direction, open * (1 + 0.0002 * direction) AS fill FROM {{bars_1h}}, (SELECT unnest([1, -1]) AS direction)", dbl="fill")
def prj_04(spark, sf):
    b = nm.grid(v.bars_1h(spark, sf), direction=[1, -1])
    return b.select("symbol", "ts", "direction", fin.entry_fill(F.col("open"), F.col("direction")).alias("fill"))


@query("prj_05_net_return", "SELECT symbol, ts, direction, direction * (close - open) / open - 2 * 0.0001 AS ret FROM {{bars_1h}}, (SELECT unnest([1, -1]) AS direction)", dbl="ret")
def prj_05(spark, sf):
    b = nm.grid(v.bars_1h(spark, sf), direction=[1, -1])
    return b.select("symbol", "ts", "direction", fin.net_return(F.col("open"), F.col("close"), F.col("direction")).alias("ret"))


@query("prj_06_levered_return", """SELECT symbol, ts, lev, lev * ret - (lev - 1) * 0.06 * greatest(hold_s, 300) / 31536000 AS ret FROM
    (SELECT symbol, ts, close / open - 1 AS ret, (epoch_us(ts) // 1000000) % 7200 AS hold_s FROM {{bars_1h}}), (SELECT unnest([1.0, 1.5, 2.0]::DOUBLE[]) AS lev)""", dbl="lev ret")
def prj_06(spark, sf):
    b = nm.grid(v.bars_1h(spark, sf), lev=[1.0, 1.5, 2.0])
    return b.select("symbol", "ts", "lev", fin.levered(F.col("close") / F.col("open") - 1, F.col("lev"), 0.06, tm.seconds("ts") % 7200).alias("ret"))


@query("prj_07_margin_call", """SELECT symbol, et_date, lev, (0.25 * lev - 1) / (0.75 * lev) AS move, low / open - 1 <= (0.25 * lev - 1) / (0.75 * lev) AS called
    FROM {{panel_day}}, (SELECT unnest([1.5, 2.0, 3.0]::DOUBLE[]) AS lev)""", dbl="lev move")
def prj_07(spark, sf):
    p = nm.grid(v.panel_day(spark, sf), lev=[1.5, 2.0, 3.0]).withColumn("move", fin.margin_call_move(F.lit(0.25), F.col("lev")))
    return p.select("symbol", "et_date", "lev", "move", (F.col("low") / F.col("open") - 1 <= F.col("move")).alias("called"))


@query("prj_08_session_gate", f"SELECT event_id, ts FROM events WHERE {ET_MIN} >= 630 AND {ET_MIN} < 900")
def prj_08(spark, sf):
    return sg.session_gate(table(spark, sf, "events", "event_id", "ts"))


@query("prj_09_signal_direction", f"SELECT symbol, ts, CASE WHEN iret >= 0.2 THEN 1 WHEN iret <= -0.2 THEN -1 ELSE 0 END AS direction FROM (SELECT symbol, ts, {IRET} AS iret FROM {{{{bars_15m}}}})")
def prj_09(spark, sf):
    return B.intraday_return(v.bars_15m(spark, sf)).select("symbol", "ts", fin.signal_direction(F.col("iret"), 0.2).alias("direction"))


SPLITS = {"1-URGENT": [("1997-03-03", 5), ("1999-06-01", 3)], "2-HIGH": [("1998-08-10", 20)]}
SHARE_F = """CASE symbol WHEN '1-URGENT' THEN (CASE WHEN et_date >= DATE '1997-03-03' THEN 5.0 ELSE 1.0 END) * (CASE WHEN et_date >= DATE '1999-06-01' THEN 3.0 ELSE 1.0 END)
    WHEN '2-HIGH' THEN CASE WHEN et_date >= DATE '1998-08-10' THEN 20.0 ELSE 1.0 END ELSE 1.0 END::DOUBLE"""
PRICE_F = """CASE symbol WHEN '1-URGENT' THEN (CASE WHEN et_date < DATE '1997-03-03' THEN 5.0 ELSE 1.0 END) * (CASE WHEN et_date < DATE '1999-06-01' THEN 3.0 ELSE 1.0 END)
    WHEN '2-HIGH' THEN CASE WHEN et_date < DATE '1998-08-10' THEN 20.0 ELSE 1.0 END ELSE 1.0 END::DOUBLE"""


@query("prj_10_share_factor", f"SELECT o_orderkey, {SHARE_F} AS factor FROM (SELECT o_orderkey, o_orderpriority AS symbol, o_orderdate::DATE AS et_date FROM orders)", dbl="factor")
def prj_10(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderdate")
    return o.select("o_orderkey", ad.share_factor(SPLITS, F.col("o_orderpriority"), F.to_date("o_orderdate")).alias("factor"))


@query("prj_11_price_factor", f"SELECT symbol, et_date, {PRICE_F} AS factor, close / ({PRICE_F}) AS adj_close FROM {{{{panel_day}}}}", dbl="factor adj_close", dp=6)
def prj_11(spark, sf):
    p = v.panel_day(spark, sf).withColumn("factor", ad.price_factor(SPLITS, F.col("symbol"), F.col("et_date")))
    return p.select("symbol", "et_date", "factor", (F.col("close") / F.col("factor")).alias("adj_close"))


FIXED = f"""SELECT symbol, et_date, factor, change_pct AS change_raw, coalesce(crossed, false) AS split_adjusted,
    CASE WHEN crossed THEN round(((short_interest / factor) / (psi / pf) - 1) * 100, 2) ELSE change_pct END AS change_pct FROM (
    SELECT *, factor <> pf AND short_interest IS NOT NULL AND psi <> 0 AS crossed FROM (
    SELECT *, lag(factor) OVER (PARTITION BY symbol ORDER BY et_date) AS pf, lag(short_interest) OVER (PARTITION BY symbol ORDER BY et_date) AS psi
    FROM (SELECT *, {SHARE_F} AS factor FROM {{{{releases}}}})))"""


@query("prj_12_change_correction", FIXED, dbl="factor change_raw change_pct", dp=6)
def prj_12(spark, sf):
    return ad.correct_change(v.releases(spark, sf), SPLITS).select("symbol", "et_date", "factor", "change_raw", "split_adjusted", "change_pct")


@query("prj_13_level_adjustment", f"SELECT symbol, et_date, short_interest AS si_raw, short_interest / ({SHARE_F}) AS short_interest FROM {{{{releases}}}}", dbl="si_raw short_interest", dp=6)
def prj_13(spark, sf):
    return ad.adjust_level(v.releases(spark, sf), SPLITS).select("symbol", "et_date", "si_raw", "short_interest")


@query("prj_14_unexplained_jumps", f"SELECT symbol, et_date, change_pct FROM ({FIXED}) WHERE change_pct >= 50", dbl="change_pct", dp=6)
def prj_14(spark, sf):
    return ad.unexplained_jumps(ad.correct_change(v.releases(spark, sf), SPLITS)).select("symbol", "et_date", "change_pct")


@query("prj_15_mention_filter", "SELECT doc_id, lang FROM documents WHERE regexp_matches(lower(text), 'the|aux')")
def prj_15(spark, sf):
    return table(spark, sf, "documents", "doc_id", "lang", "text").filter(F.lower("text").rlike("the|aux")).select("doc_id", "lang")


KEY_SQL = r"regexp_extract_all(lower(regexp_replace(title, '\s+-\s+[^-]{1,40}$', '')), '[a-z0-9]+')"


@query("prj_16_title_key", f"SELECT doc_id, array_to_string({KEY_SQL}, '') AS key, array_to_string(list_sort(list_distinct({KEY_SQL})), ' ') AS words FROM {{{{titles}}}}")
def prj_16(spark, sf):
    t = v.titles(spark, sf)
    return t.select("doc_id", tx.title_key(F.col("title")).alias("key"), F.array_join(F.array_sort(tx.token_set(F.col("title"))), " ").alias("words"))


@query("prj_17_event_id", "SELECT event_id, substr(sha256(source_id || '|' || event_id), 1, 16) AS eid FROM {{dated}}")
def prj_17(spark, sf):
    return v.dated(spark, sf).select("event_id", hs.event_id(F.col("source_id"), F.col("event_id").cast("string")).alias("eid"))


@query("prj_18_position_score", """SELECT event_id, CASE WHEN s = 'detector' THEN 0.5 WHEN tier IN ('T0', 'T1') THEN 1.0 WHEN tier = 'T3' THEN 0.3 ELSE 0.3 END AS position
    FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'detector' ELSE source_id END AS s FROM {{dated}})""", dbl="position")
def prj_18(spark, sf):
    d = v.dated(spark, sf)
    s = F.when(F.col("event_id") % 7 == 0, "detector").otherwise(F.col("source_id"))
    return d.select("event_id", sc.position_score(s, F.col("tier")).alias("position"))


FACT_SQL = """CASE WHEN type IN ('form4', 'short_interest') THEN 1.0 WHEN type LIKE '8k%' THEN 1.0 ELSE 0.2 END"""
CLASS_SQL = "CASE WHEN source_id IN ('edgar', 'edgar_t0', 'finra_short') THEN 'data' ELSE 'news' END"
AGE_SQL = "(epoch_us(TIMESTAMP '2024-01-25') - epoch_us(event_time)) / 86400000000.0"
REC_SQL = f"CASE WHEN {AGE_SQL} <= 0 THEN 1.0 ELSE exp(-ln(2.0) * {AGE_SQL} / CASE {CLASS_SQL} WHEN 'data' THEN 14.0 ELSE 2.0 END) END"
POS_SQL = "CASE WHEN tier IN ('T0', 'T1') THEN 1.0 ELSE 0.3 END"


def age_days(now="2024-01-25 00:00:00"):
    return (tm.micros(F.lit(now).cast("timestamp_ntz")) - tm.micros("event_time")) / 86_400_000_000


@query("prj_19_fact_score", f"SELECT event_id, {FACT_SQL} AS fact FROM {{{{dated}}}}", dbl="fact")
def prj_19(spark, sf):
    return v.dated(spark, sf).select("event_id", sc.fact_score(F.col("type")).alias("fact"))


@query("prj_20_recency_score", f"SELECT event_id, {REC_SQL} AS recency FROM {{{{dated}}}}", dbl="recency")
def prj_20(spark, sf):
    d = v.dated(spark, sf)
    return d.select("event_id", sc.recency_score(sc.source_class(F.col("source_id"), F.col("type")), age_days()).alias("recency"))


def score_parts(d):
    cls = sc.source_class(F.col("source_id"), F.col("type"))
    return d.withColumn("position", sc.position_score(F.col("source_id"), F.col("tier"))).withColumn("fact", sc.fact_score(F.col("type"))).withColumn(
        "recency", sc.recency_score(cls, age_days()))


ET_EV = "CAST((event_time AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE)"


@query("prj_21_total_score", f"""WITH iv AS (SELECT et_date, avg(value / 100) AS iv FROM (SELECT *, {ET_EV} AS et_date FROM {{{{dated}}}} WHERE event_type = 'signup') GROUP BY 1),
    b AS (SELECT et_date, iv, CASE WHEN count(iv) OVER w >= 2 THEN avg(iv) OVER w END AS base FROM iv WINDOW w AS (ORDER BY et_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
    s AS (SELECT et_date, CASE WHEN base > 0 THEN least(1.0, abs(iv - base) / base / 0.3) END AS surprise FROM b)
    SELECT event_id, {POS_SQL} * ({FACT_SQL}) * ({REC_SQL}) * coalesce(surprise, 1.0) AS total, surprise IS NULL AS partial
    FROM (SELECT *, {ET_EV} AS et_date FROM {{{{dated}}}}) LEFT JOIN s USING (et_date)""", dbl="total", dp=8)
def prj_21(spark, sf):
    d = v.dated(spark, sf).withColumn("et_date", tm.et_date("event_time"))
    iv = d.filter("event_type = 'signup'").groupBy("et_date").agg(F.avg(F.col("value") / 100).alias("iv"))
    w = W.partitionBy(F.lit(0)).orderBy("et_date").rowsBetween(-5, -1)  # one row per calendar day
    s = iv.withColumn("base", nm.guarded(F.avg, F.col("iv"), w, 2)).select("et_date", sc.surprise_score(F.col("iv"), F.col("base")).alias("surprise"))
    out = score_parts(d).join(s, "et_date", "left")
    total = F.col("position") * F.col("fact") * F.col("recency") * F.coalesce("surprise", F.lit(1.0))
    return out.select("event_id", total.alias("total"), F.col("surprise").isNull().alias("partial"))


@query("prj_22_rule_legs", "SELECT symbol, et_date, coalesce(close >= 200000, false) AND coalesce(volume <= 3, false) AND symbol = '2-HIGH' AS all_legs FROM {{panel_day}}")
def prj_22(spark, sf):
    return sg.rule_legs(v.panel_day(spark, sf), [("close", ">=", 200000), ("volume", "<=", 3), ("symbol", "==", "2-HIGH")]).select("symbol", "et_date", "all_legs")


@query("prj_23_regime_label", """SELECT symbol, month, CASE WHEN mdd <= -0.5 THEN base || '_deep' ELSE base END AS regime FROM (
    SELECT symbol, month, min(low) / max(high) - 1 AS mdd, CASE WHEN last(close ORDER BY et_date) / first(open ORDER BY et_date) - 1 >= 0.1 THEN 'bull'
    WHEN last(close ORDER BY et_date) / first(open ORDER BY et_date) - 1 <= -0.1 THEN 'bear' ELSE 'sideways' END AS base
    FROM (SELECT *, date_trunc('month', et_date)::DATE AS month FROM {{panel_day}}) GROUP BY 1, 2)""")
def prj_23(spark, sf):
    m = v.panel_day(spark, sf).groupBy("symbol", F.trunc("et_date", "month").alias("month")).agg(
        (F.max_by("close", "et_date") / F.min_by("open", "et_date") - 1).alias("ret"), (F.min("low") / F.max("high") - 1).alias("mdd"))
    return m.select("symbol", "month", sg.regime_label(F.col("ret"), F.col("mdd"), deep=-0.5).alias("regime"))


@query("prj_24_order_text", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'risk_off' WHEN o_custkey % 11 = 0 THEN 'data_missing'
    WHEN o_custkey % 2 = 0 AND o_totalprice > 300000 AND o_orderkey % 3 = 0 THEN 'hold_line_broken' WHEN o_custkey % 2 = 0 AND o_totalprice > 300000 THEN 'hold_add_line_broken'
    WHEN o_orderkey % 3 = 0 THEN 'hold_no_add' ELSE 'hold_add_on_signal' END AS order_text FROM orders""")
def prj_24(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    t = sg.order_text(F.when(F.col("o_orderstatus") == "P", "RISK_OFF").otherwise("RISK_ON"), F.col("o_custkey") % 11 != 0, F.col("o_orderkey") % 3 == 0,
                      F.col("o_custkey") % 2 == 0, F.col("o_totalprice") > 300000)
    return o.select("o_orderkey", t.alias("order_text"))


@query("prj_25_release_timing", f"SELECT event_id, CASE WHEN isodow({ET_EV.replace('event_time', 'ts')}) < 6 AND {ET_MIN} >= 570 AND {ET_MIN} < 960 THEN 'intraday' ELSE 'after_hours' END AS timing FROM events")
def prj_25(spark, sf):
    return table(spark, sf, "events", "event_id", "ts").select("event_id", sg.release_timing("ts").alias("timing"))


@query("prj_26_health_age", f"""SELECT source_id, polled_at, age_min, age_min <= CASE WHEN open THEN 45 ELSE 150 END AS healthy FROM (SELECT source_id, polled_at,
    isodow({ET_EV.replace('event_time', 'polled_at')}) < 6 AND {ET_MIN.replace('ts', 'polled_at')} >= 570 AND {ET_MIN.replace('ts', 'polled_at')} < 960 AS open,
    (poll_id * 13) % 240 / 1.0 AS age_min FROM {{{{polls}}}})""", dbl="age_min")
def prj_26(spark, sf):
    p = v.polls(spark, sf).withColumn("age_min", ((F.col("poll_id") * 13) % 240).cast("double"))
    return p.select("source_id", "polled_at", "age_min", sg.health(F.col("age_min"), sg.release_timing("polled_at") == "intraday", 45, 150).alias("healthy"))


@query("prj_27_describe", " UNION ALL ".join(f"""SELECT '{c}' AS name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
    quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75 FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    dbl="mean std min max p25 p50 p75", dp=4)
def prj_27(spark, sf):
    return sg.describe(table(spark, sf, "lineitem", "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("prj_28_segment_label", """SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '2000-01-01' THEN 'crash' WHEN o_orderdate >= DATE '1999-01-01' THEN 'valid' WHEN o_orderdate >= DATE '1996-01-01' THEN 'train' END AS segment FROM orders""")
def prj_28(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", sg.segment(F.to_date("o_orderdate"), [("train", "1996-01-01"), ("valid", "1999-01-01"), ("crash", "2000-01-01")]).alias("segment"))


@query("prj_29_source_class", """SELECT event_id, CASE WHEN s IN ('edgar', 'edgar_t0', 'finra_short') THEN 'data' WHEN s IN ('news_rss', 'x_nitter') THEN 'news' WHEN type LIKE 'fomc%' THEN 'calendar' ELSE 'news' END AS cls
    FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'other' ELSE source_id END AS s, CASE WHEN event_id % 10 = 0 THEN 'fomc_meeting' ELSE type END AS type FROM {{dated}})""")
def prj_29(spark, sf):
    k = F.col("event_id")
    return v.dated(spark, sf).select("event_id", sc.source_class(F.when(k % 5 == 0, "other").otherwise(F.col("source_id")), F.when(k % 10 == 0, "fomc_meeting").otherwise(F.col("type"))).alias("cls"))


@query("prj_30_follow_fade", """SELECT symbol, ts, mode, trigger, CASE WHEN mode = 'fade' THEN -1 ELSE 1 END * CASE WHEN pr > 0 THEN 1 ELSE -1 END AS direction FROM (
    SELECT symbol, ts, lag(close / open - 1) OVER (PARTITION BY symbol, et_date ORDER BY ts) AS pr FROM {{bars_1h}}),
    (SELECT unnest(['follow', 'fade']) AS mode), (SELECT unnest([0.1, 0.3]::DOUBLE[]) AS trigger) WHERE abs(pr) >= trigger AND pr <> 0""", dbl="trigger")
def prj_30(spark, sf):
    w = W.partitionBy("symbol", "et_date").orderBy("ts")
    b = v.bars_1h(spark, sf).withColumn("pr", F.lag(F.col("close") / F.col("open") - 1).over(w))
    return sg.follow_fade(b, "pr", ["follow", "fade"], [0.1, 0.3]).select("symbol", "ts", "mode", "trigger", "direction")
