"""Sequential-pattern queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions import times as tm
from ..operators import joins as J
from ..operators import patterns as P
from ..operators import rolling as R
from ..operators import settle as S
from ..operators import spread
from ..operators import states as ST
from ..sources.tables import table
from . import views as v
from .joins import DAYT, DENSE_EV, JUMPS, days, dense_events, jump_events
from .projections import IRET
from .registry import query
from .scans import ET_MIN, FILINGS, filings
from .windows import BW, DENSE, DIPS, PW, SPINE, SW, daily_counts


def settle_sql(entries, bars, horizon, tp="0.2", sl="0.1", same_day=True, pos="pos", raw="open"):
    """SQL settlement of ``entries`` (symbol, pos, et_date, open, direction, ...) against ``bars``."""
    day = "AND b.et_date = e.et_date" if same_day else ""
    return f"""SELECT *, direction * (exit_px - entry_px) / entry_px - 0.0002 AS ret FROM (SELECT *, CASE WHEN f IS NULL THEN 'close' WHEN f.gt THEN 'tp' WHEN f.st THEN 'sl' ELSE 'tp' END AS hit,
    coalesce(f.p, l.p) AS exit_pos, CASE WHEN f IS NULL THEN l.c WHEN f.gt OR NOT f.st THEN direction * greatest(direction * f.o, direction * tp_px)
      ELSE direction * least(direction * f.o, direction * sl_px) * (1 - 0.0002 * direction) END AS exit_px FROM (
    SELECT e.*, arg_min({{'p': b.{pos}, 'o': b.open, 'gt': direction * b.open >= direction * tp_px, 'st': direction * b.open <= direction * sl_px OR direction * CASE WHEN direction = 1 THEN b.low ELSE b.high END <= direction * sl_px}}, b.{pos})
      FILTER (WHERE direction * b.open >= direction * tp_px OR direction * b.open <= direction * sl_px OR direction * CASE WHEN direction = 1 THEN b.low ELSE b.high END <= direction * sl_px OR direction * CASE WHEN direction = 1 THEN b.high ELSE b.low END > direction * tp_px) AS f,
      arg_max({{'p': b.{pos}, 'c': b.close}}, b.{pos}) AS l
    FROM (SELECT *, {raw} * (1 + 0.0002 * direction) AS entry_px, {raw} * (1 + 0.0002 * direction) * (1 + ({tp}) * direction) AS tp_px, {raw} * (1 + 0.0002 * direction) * (1 - ({sl}) * direction) AS sl_px FROM ({entries})) e
    JOIN ({bars}) b ON b.symbol = e.symbol AND b.{pos} >= e.{pos} AND b.{pos} < e.{pos} + {horizon} {day} GROUP BY ALL))"""


def keep_sql(t, key, start, end):
    """SQL greedy non-overlap: follow each kept trade to the first one starting after its end."""
    k = [c.strip() for c in key.split(",")]
    eq = " AND ".join(f"a.{c} = b.{c}" for c in k)
    nx = " AND ".join(f"n.{c} = r.{c}" for c in k)
    return f"""WITH RECURSIVE t0 AS MATERIALIZED ({t}), nx AS MATERIALIZED (SELECT a.*, b.s AS nxt FROM t0 a ASOF LEFT JOIN (SELECT {key}, {start} AS s FROM t0) b ON {eq} AND b.s > a.{end}),
    r AS (SELECT * FROM nx WHERE {start} = (SELECT min({start}) FROM t0 q WHERE {' AND '.join(f'q.{c} = nx.{c}' for c in k)}) UNION ALL SELECT n.* FROM r JOIN nx n ON {nx} AND n.{start} = r.nxt)
    SELECT * EXCLUDE (nxt) FROM r"""


# ---------------------------------------------------------------- V shapes
XS, YS, TS = [0.3, 0.6], [0.5, 1.5], [4, 10]
LB, LF = 3, 2
MASKED = f"SELECT symbol, ts, et_date, close, pos, count(*) OVER w = 6 AND close >= max(close) OVER w AS is_peak, count(*) OVER w = 6 AND close <= min(close) OVER w AS is_trough FROM {{{{bars_15m}}}} WINDOW w AS ({BW} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)"
DROPLIMIT = "SELECT symbol, CAST(floor(median(n)) AS BIGINT) AS lim FROM (SELECT symbol, et_date, count(*) AS n FROM {{bars_15m}} GROUP BY ALL) GROUP BY symbol"
VCAND = f"""SELECT symbol, et_date, x, peak_pos, arg_min(a, pos) AS anchor_pos, arg_min(pos, pos) AS trough_pos, arg_min(m, pos) AS peak_p, arg_min(close, pos) AS trough_p FROM (
    SELECT *, max(CASE WHEN pos - a > lim THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, peak_pos ORDER BY pos) AS far FROM (
    SELECT p.symbol, p.et_date, p.pos AS peak_pos, j.pos, j.close, j.is_trough, max(j.close) OVER w AS m, arg_max(j.pos, {{'c': j.close, 'p': -j.pos}}) OVER w AS a
    FROM (SELECT * FROM ({MASKED}) WHERE is_peak) p JOIN ({MASKED}) j ON j.symbol = p.symbol AND j.et_date = p.et_date AND j.pos >= p.pos
    WINDOW w AS (PARTITION BY p.symbol, p.pos ORDER BY j.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) JOIN ({DROPLIMIT}) USING (symbol) WHERE pos > peak_pos), (SELECT unnest({XS}::DOUBLE[]) AS x)
    WHERE far = 0 AND is_trough AND close <= m AND (m - close) / m >= x GROUP BY symbol, et_date, x, peak_pos"""


def masked(spark, sf, bars=None):
    return R.local_extrema(bars or v.with_pos(v.bars_15m(spark, sf)), LB, LF)


def v_cands(spark, sf, bars=None):
    return P.v_candidates(masked(spark, sf, bars), XS)


@query("seq_01_v_candidates", VCAND, dbl="x peak_p trough_p")
def seq_01(spark, sf):
    return v_cands(spark, sf).select("symbol", "et_date", "x", "peak_pos", "anchor_pos", "trough_pos", "peak_p", "trough_p")


REACH = "FILTER (WHERE (b.close - c.trough_p) / c.trough_p >= y)"
VREB = f"""SELECT *, coalesce(rebound_pos, peak_pos) AS fin FROM (
    SELECT c.*, min(b.pos) {REACH} AS rebound_pos, arg_min(b.close, b.pos) {REACH} AS rebound_p FROM (
      SELECT v.*, y, t AS "T", v.trough_pos + t <= n.last AS complete FROM ({VCAND}) v JOIN (SELECT symbol, max(pos) AS last FROM {{{{bars_15m}}}} GROUP BY symbol) n ON n.symbol = v.symbol
      CROSS JOIN (SELECT unnest({YS}::DOUBLE[]) AS y) CROSS JOIN (SELECT unnest({TS}) AS t)) c
    LEFT JOIN {{{{bars_15m}}}} b ON b.symbol = c.symbol AND b.pos > c.trough_pos AND b.pos <= c.trough_pos + c."T" GROUP BY ALL)"""
VKEEP = keep_sql(VREB, 'symbol, x, y, "T"', "peak_pos", "fin")
VEV = f"""SELECT symbol, et_date, x, y, "T", anchor_pos, trough_pos, peak_p, trough_p, rebound_p, (peak_p - trough_p) / peak_p AS drop_pct, (rebound_p - trough_p) / trough_p AS rebound_pct,
    trough_pos - anchor_pos AS bars_to_trough, rebound_pos - trough_pos AS bars_to_rebound, CASE WHEN rebound_pos IS NOT NULL THEN 'rebounded' ELSE 'timeout' END AS outcome FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, x, y, "T", anchor_pos, trough_pos, rebound_pos IS NULL ORDER BY peak_pos) AS rn FROM ({VKEEP}) WHERE rebound_pos IS NOT NULL OR complete) WHERE rebound_pos IS NOT NULL OR rn = 1"""
VCOLS = ["symbol", "et_date", "x", "y", "T", "anchor_pos", "trough_pos", "peak_p", "trough_p", "rebound_p", "drop_pct", "rebound_pct", "bars_to_trough", "bars_to_rebound", "outcome"]


def v_all(spark, sf):
    m = masked(spark, sf)
    return P.v_events(P.v_rebounds(P.v_candidates(m, XS), m, YS, TS))


@query("seq_02_v_events", VEV, dbl="x y peak_p trough_p rebound_p drop_pct rebound_pct")
def seq_02(spark, sf):
    return v_all(spark, sf).select(*VCOLS)


@query("seq_03_v_grid", f"""SELECT x, y, "T", count(*) AS n_events, count(*) FILTER (WHERE outcome = 'rebounded') AS n_rebounded FROM ({VEV}) GROUP BY 1, 2, 3""", dbl="x y")
def seq_03(spark, sf):
    return v_all(spark, sf).groupBy("x", "y", "T").agg(F.count(F.lit(1)).alias("n_events"), F.sum((F.col("outcome") == "rebounded").cast("int")).cast("bigint").alias("n_rebounded"))


# ---------------------------------------------------------------- zigzag
THETAS = [0.5, 0.8]


def _zz_sql(rows, thetas):
    """Zigzag as a recursion over positions; a pivot is emitted on the step that confirms it."""
    return f"""WITH RECURSIVE b0 AS MATERIALIZED ({rows}), th AS (SELECT unnest({thetas}::DOUBLE[]) AS theta), ends AS (SELECT symbol, max(pos) AS last FROM b0 GROUP BY symbol),
    z AS (SELECT symbol, theta, pos, 0 AS trend, pos AS ep, close AS ec, close AS ref, NULL::BIGINT AS vp, NULL::DOUBLE AS vc, NULL::VARCHAR AS vk FROM b0, th WHERE pos = 0 UNION ALL
    SELECT z.symbol, theta, b.pos, CASE WHEN trend = 0 THEN CASE WHEN abs((b.close - ref) / ref) >= theta THEN CASE WHEN b.close > ref THEN 1 ELSE -1 END ELSE 0 END
        WHEN (b.close - ec) * trend > 0 THEN trend WHEN trend * (ec - b.close) / ec >= theta THEN -trend ELSE trend END,
      CASE WHEN (trend = 0 AND abs((b.close - ref) / ref) >= theta) OR (trend <> 0 AND ((b.close - ec) * trend > 0 OR trend * (ec - b.close) / ec >= theta)) THEN b.pos ELSE ep END,
      CASE WHEN (trend = 0 AND abs((b.close - ref) / ref) >= theta) OR (trend <> 0 AND ((b.close - ec) * trend > 0 OR trend * (ec - b.close) / ec >= theta)) THEN b.close ELSE ec END, ref,
      CASE WHEN trend <> 0 AND (b.close - ec) * trend <= 0 AND trend * (ec - b.close) / ec >= theta THEN ep END, CASE WHEN trend <> 0 AND (b.close - ec) * trend <= 0 AND trend * (ec - b.close) / ec >= theta THEN ec END,
      CASE WHEN trend <> 0 AND (b.close - ec) * trend <= 0 AND trend * (ec - b.close) / ec >= theta THEN CASE WHEN trend = 1 THEN 'H' ELSE 'L' END END
    FROM z JOIN b0 b ON b.symbol = z.symbol AND b.pos = z.pos + 1),
    fin AS (SELECT z.* FROM z JOIN ends ON ends.symbol = z.symbol AND ends.last = z.pos),
    pv AS (SELECT symbol, theta, vp AS pos, vc AS price, vk AS kind FROM z WHERE vp IS NOT NULL UNION ALL SELECT symbol, theta, ep, ec, CASE WHEN trend = 1 THEN 'H' ELSE 'L' END FROM fin),
    al AS (SELECT * FROM pv UNION ALL SELECT f.symbol, f.theta, 0, f.ref, CASE WHEN f.trend = -1 THEN 'H' ELSE 'L' END FROM fin f WHERE (SELECT min(pos) FROM pv WHERE pv.symbol = f.symbol AND pv.theta = f.theta) <> 0)
    SELECT symbol, theta, row_number() OVER (PARTITION BY symbol, theta ORDER BY pos) - 1 AS n, pos, price, kind FROM al"""


ZZ = _zz_sql("SELECT symbol, pos, close FROM {{bars_1h}}", THETAS)


def zz(spark, sf):
    return P.zigzag(v.with_pos(v.bars_1h(spark, sf)), THETAS)


@query("seq_04_zigzag", ZZ, dbl="theta price")
def seq_04(spark, sf):
    return zz(spark, sf).select("symbol", "theta", "n", "pos", "price", "kind")


def atr_thr(spark, sf, mult=0.6):
    d = v.panel_day(spark, sf).withColumn("pos", F.col("d"))
    return R.atr_threshold(d, 14, mult).withColumnRenamed("atr_thr", "thr")


ATR_D = f"""SELECT symbol, d AS pos, close, 0.6 * lag(a) OVER ({PW}) AS thr FROM (SELECT symbol, et_date, d, close, CASE WHEN count(tr) OVER w >= 14 THEN avg(tr) OVER w END / close AS a FROM
    (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({PW})), abs(low - lag(close) OVER ({PW}))) AS tr FROM {{{{panel_day}}}}) WINDOW w AS ({PW} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""
ZATR = f"""WITH RECURSIVE b0 AS MATERIALIZED ({ATR_D}), ends AS (SELECT symbol, max(pos) AS last FROM b0 GROUP BY symbol),
    z AS (SELECT symbol, pos, 1 AS trend, pos AS ep, close AS ec, NULL::BIGINT AS vp, NULL::DOUBLE AS vc, NULL::VARCHAR AS vk FROM b0 WHERE pos = 0 UNION ALL
    SELECT z.symbol, b.pos, CASE WHEN (b.close - ec) * trend > 0 THEN trend WHEN coalesce(trend * (ec - b.close) / ec >= b.thr, false) THEN -trend ELSE trend END,
      CASE WHEN (b.close - ec) * trend > 0 OR coalesce(trend * (ec - b.close) / ec >= b.thr, false) THEN b.pos ELSE ep END, CASE WHEN (b.close - ec) * trend > 0 OR coalesce(trend * (ec - b.close) / ec >= b.thr, false) THEN b.close ELSE ec END,
      CASE WHEN (b.close - ec) * trend <= 0 AND trend * (ec - b.close) / ec >= b.thr THEN ep END, CASE WHEN (b.close - ec) * trend <= 0 AND trend * (ec - b.close) / ec >= b.thr THEN ec END,
      CASE WHEN (b.close - ec) * trend <= 0 AND trend * (ec - b.close) / ec >= b.thr THEN CASE WHEN trend = 1 THEN 'H' ELSE 'L' END END FROM z JOIN b0 b ON b.symbol = z.symbol AND b.pos = z.pos + 1),
    pv AS (SELECT symbol, vp AS pos, vc AS price, vk AS kind FROM z WHERE vp IS NOT NULL UNION ALL SELECT z.symbol, ep, ec, CASE WHEN trend = 1 THEN 'H' ELSE 'L' END FROM z JOIN ends ON ends.symbol = z.symbol AND ends.last = z.pos)
    SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY pos) - 1 AS n, pos AS d, price, kind FROM pv"""


@query("seq_05_zigzag_atr", ZATR, dbl="price")
def seq_05(spark, sf):
    return P.zigzag_atr(atr_thr(spark, sf)).select("symbol", "n", "d", "price", "kind")


HX, HY = [0.5, 0.9], [1.0, 3.0]
HLH = f"""SELECT symbol, theta, "X", "Y", pos AS peak_pos, p1 AS trough_pos, p2 AS rebound_pos, price AS peak_p, c1 AS trough_p, c2 AS rebound_p, (price - c1) / price AS drop_pct, (c2 - c1) / c1 AS rebound_pct, p2 - p1 AS bars_to_rebound FROM (
    SELECT *, lead(pos) OVER w AS p1, lead(pos, 2) OVER w AS p2, lead(price) OVER w AS c1, lead(price, 2) OVER w AS c2, lead(kind) OVER w AS k1, lead(kind, 2) OVER w AS k2 FROM ({ZZ}) WINDOW w AS (PARTITION BY symbol, theta ORDER BY n)),
    (SELECT unnest({HX}::DOUBLE[]) AS "X"), (SELECT unnest({HY}::DOUBLE[]) AS "Y") WHERE kind = 'H' AND k1 = 'L' AND k2 = 'H' AND (price - c1) / price >= "X" AND (c2 - c1) / c1 >= "Y" """


def hlh(spark, sf):
    return P.hlh(zz(spark, sf), HX, HY, ["symbol", "theta"], ts="ts")


HCOLS = ["symbol", "theta", "X", "Y", "peak_pos", "trough_pos", "rebound_pos", "peak_p", "trough_p", "rebound_p", "drop_pct", "rebound_pct", "bars_to_rebound"]


@query("seq_06_hlh", HLH, dbl="theta X Y peak_p trough_p rebound_p drop_pct rebound_pct")
def seq_06(spark, sf):
    return hlh(spark, sf).select(*HCOLS)


HDEDUP = f"""SELECT symbol, peak_pos, trough_pos, theta, "X", "Y", drop_pct, n_param_combos FROM (SELECT *, count(*) OVER (PARTITION BY symbol, peak_pos, trough_pos) AS n_param_combos,
    row_number() OVER (PARTITION BY symbol, peak_pos, trough_pos ORDER BY theta, "X", "Y") AS rn FROM ({HLH})) WHERE rn = 1"""


def hlh_unique(spark, sf):
    return P.dedup_events(hlh(spark, sf), ["theta", "X", "Y"], ("symbol", "peak_pos", "trough_pos"))


@query("seq_07_zigzag_unique", HDEDUP, dbl="theta X Y drop_pct")
def seq_07(spark, sf):
    return hlh_unique(spark, sf).select("symbol", "peak_pos", "trough_pos", "theta", "X", "Y", "drop_pct", "n_param_combos")


# ---------------------------------------------------------------- settlement
MOM = f"""SELECT symbol, ts, et_date, pos, open, CASE WHEN sig > 0 THEN 1 ELSE -1 END AS direction FROM (SELECT *, lag(iret) OVER (PARTITION BY symbol, et_date ORDER BY ts) AS sig FROM (SELECT *, {IRET} AS iret FROM {{{{bars_15m}}}})) WHERE abs(sig) >= 0.3"""
BARS15 = "SELECT * FROM {{bars_15m}}"
BARS1H = "SELECT * FROM {{bars_1h}}"
OUT = "symbol, pos, direction, hit, exit_pos, exit_px, ret"
BRACK = settle_sql(MOM, BARS15, 8)


def mom(spark, sf, bars=None, **kw):
    return S.momentum_entries(bars or v.with_pos(v.bars_15m(spark, sf)), 0.3, **kw)


def mom_trades(spark, sf, horizon=8, tp=0.2, sl=0.1, bars=None):
    return S.bracket(S.forward_paths(mom(spark, sf, bars), horizon, F.col("direction").isNotNull()), tp, sl)


@query("seq_08_bracket", f"SELECT {OUT} FROM ({BRACK})", dbl="exit_px ret")
def seq_08(spark, sf):
    return mom_trades(spark, sf).select("symbol", "pos", "direction", "hit", "exit_pos", "exit_px", "ret")


@query("jn_08_forward_paths", f"SELECT e.symbol, e.pos, count(*) AS n_bars, max(b.pos) AS last_pos FROM ({MOM}) e JOIN {{{{bars_15m}}}} b ON b.symbol = e.symbol AND b.et_date = e.et_date AND b.pos >= e.pos AND b.pos < e.pos + 8 GROUP BY 1, 2")
def jn_08(spark, sf):
    p = S.forward_paths(mom(spark, sf), 8, F.col("direction").isNotNull())
    return p.select("symbol", "pos", F.size("path").cast("bigint").alias("n_bars"), F.element_at("path", -1)["pos"].alias("last_pos"))


DSIG = f"SELECT symbol, d, direction FROM (SELECT symbol, d, CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 END AS direction FROM (SELECT *, max(high) OVER w AS hi, min(low) OVER w AS lo, count(*) OVER w AS c FROM {{{{panel_day}}}} WINDOW w AS ({PW} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) WHERE c >= 20) WHERE direction IS NOT NULL"
DBARS = "SELECT symbol, d, et_date, d AS pos, open, high, low, close FROM {{panel_day}}"
DENTRY = f"SELECT b.*, s.direction, s.d AS sig_d FROM ({DSIG}) s JOIN ({DBARS}) b ON b.symbol = s.symbol AND b.d = s.d + 1"


def daily_bars_pos(spark, sf):
    return v.panel_day(spark, sf).withColumn("pos", F.col("d")).withColumn("ts", F.col("et_date").cast("timestamp_ntz"))


def daily_entries(spark, sf):
    w = W.partitionBy("symbol").orderBy("d")
    f = w.rowsBetween(-20, -1)
    b = daily_bars_pos(spark, sf)
    full = F.count("high").over(f) >= 20
    sig = F.when(full, F.when(F.col("close") > F.max("high").over(f), 1).when(F.col("close") < F.min("low").over(f), -1))
    return b.withColumn("_s", sig).withColumn("direction", F.lag("_s").over(w)).drop("_s")


def daily_paths(spark, sf, horizon):
    return S.forward_paths(daily_entries(spark, sf), horizon, F.col("direction").isNotNull(), same_day=False)


TRAIL = f"""SELECT symbol, pos, direction, CASE WHEN f IS NULL THEN 'close' ELSE 'sl' END AS hit, coalesce(f.p, l.p) AS exit_pos, CASE WHEN f IS NULL THEN l.c ELSE f.px END AS exit_px FROM (
    SELECT symbol, epos AS pos, direction, arg_min({{'p': pos, 'px': CASE WHEN direction * open <= stop THEN open ELSE direction * stop END * (1 - 0.0002 * direction)}}, pos) FILTER (WHERE direction * open <= stop OR direction * CASE WHEN direction = 1 THEN low ELSE high END <= stop) AS f,
    arg_max({{'p': pos, 'c': close}}, pos) AS l FROM (
    SELECT *, greatest(direction * entry_px, coalesce(max(direction * CASE WHEN direction = 1 THEN high ELSE low END) OVER (PARTITION BY symbol, epos ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), direction * entry_px)) * (1 - 0.3 * direction) AS stop FROM (
    SELECT e.symbol, e.pos AS epos, e.direction, e.open * (1 + 0.0002 * e.direction) AS entry_px, b.pos, b.open, b.high, b.low, b.close FROM ({DENTRY}) e JOIN ({DBARS}) b ON b.symbol = e.symbol AND b.pos >= e.pos AND b.pos < e.pos + 10)) GROUP BY 1, 2, 3)"""


@query("seq_09_trailing", TRAIL, dbl="exit_px", dp=6)
def seq_09(spark, sf):
    return S.trailing(daily_paths(spark, sf, 10), 0.3).select("symbol", "pos", "direction", "hit", "exit_pos", "exit_px")


LABEL = f"""SELECT symbol, pos, label FROM (SELECT e.symbol, e.pos, e.n_all, count(*) AS n, max(b.pos) AS lastp, any_value(e.last) AS last, max(b.pos) FILTER (WHERE b.et_date <> e.et_date) AS cross_day,
    CASE WHEN min(b.pos) FILTER (WHERE b.et_date = e.et_date AND (b.high >= e.open * 1.4 OR b.low <= e.open * 0.7)) IS NOT NULL THEN
      CASE WHEN arg_min(b.high >= e.open * 1.4 AND NOT b.low <= e.open * 0.7, b.pos) FILTER (WHERE b.et_date = e.et_date AND (b.high >= e.open * 1.4 OR b.low <= e.open * 0.7)) THEN 1 ELSE 0 END
      WHEN count(*) < 8 AND count(*) FILTER (WHERE b.et_date <> e.et_date) = 0 THEN NULL ELSE 0 END AS label
    FROM (SELECT m.*, n.last, 0 AS n_all FROM ({MOM}) m JOIN (SELECT symbol, max(pos) AS last FROM {{{{bars_15m}}}} GROUP BY 1) n USING (symbol)) e JOIN {{{{bars_15m}}}} b ON b.symbol = e.symbol AND b.pos >= e.pos AND b.pos < e.pos + 8 GROUP BY 1, 2, 3)"""


def labelled(spark, sf):
    return S.triple_barrier(S.forward_paths(mom(spark, sf), 8, F.col("direction").isNotNull()), 0.4, 0.3, 8)


@query("seq_10_triple_barrier", LABEL)
def seq_10(spark, sf):
    return labelled(spark, sf).select("symbol", "pos", "label")


KEPT = keep_sql(BRACK, "symbol", "pos", "exit_pos")


def kept_trades(spark, sf, bars=None):
    return S.non_overlap(mom_trades(spark, sf, bars=bars).select("symbol", "et_date", "ts", "pos", "direction", "hit", "exit_pos", "exit_px", "ret"), "symbol", "pos", "exit_pos", "et_date")


@query("seq_11_non_overlap", f"SELECT {OUT} FROM ({KEPT})", dbl="exit_px ret")
def seq_11(spark, sf):
    return kept_trades(spark, sf).select("symbol", "pos", "direction", "hit", "exit_pos", "exit_px", "ret")


@query("seq_12_momentum", f"SELECT {OUT} FROM ({settle_sql(MOM, BARS15, 1)})", dbl="exit_px ret")
def seq_12(spark, sf):
    return mom_trades(spark, sf, 1).select("symbol", "pos", "direction", "hit", "exit_pos", "exit_px", "ret")


MOMK = f"""SELECT symbol, ts, et_date, pos, open, CASE WHEN sig > 0 THEN 1 ELSE -1 END AS direction FROM (SELECT *, lag(iret) OVER (PARTITION BY symbol, et_date ORDER BY ts) AS sig, lag(sd) OVER ({BW}) * 0.8 AS thr FROM
    (SELECT *, CASE WHEN count(iret) OVER w >= 10 THEN stddev_samp(iret) OVER w END AS sd FROM (SELECT *, {IRET} AS iret FROM {{{{bars_15m}}}}) WINDOW w AS ({BW} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))) WHERE abs(sig) >= thr"""


@query("seq_12_momentum_std", f"SELECT {OUT} FROM ({settle_sql(MOMK, BARS15, 1)})", dbl="exit_px ret")
def seq_12b(spark, sf):
    e = mom(spark, sf, std_k=0.8, std_n=20)
    return S.bracket(S.forward_paths(e, 1, F.col("direction").isNotNull()), 0.2, 0.1).select("symbol", "pos", "direction", "hit", "exit_pos", "exit_px", "ret")


MOM1H = MOM.replace("{{bars_15m}}", "{{bars_1h}}")
INTRA = settle_sql(f"SELECT h.symbol, h.ts AS hour, h.direction, f.ts, f.et_date, f.pos, f.open FROM ({MOM1H}) h JOIN (SELECT *, row_number() OVER (PARTITION BY symbol, date_trunc('hour', ts) ORDER BY ts) AS rn FROM {{{{bars_15m}}}}) f ON f.symbol = h.symbol AND date_trunc('hour', f.ts) = h.ts AND f.rn = 1",
    BARS15, 4).replace("GROUP BY ALL", "AND date_trunc('hour', b.ts) = e.hour GROUP BY ALL")


@query("seq_13_intrabar", f"SELECT symbol, hour, hit, exit_px, ret FROM ({INTRA})", dbl="exit_px ret")
def seq_13(spark, sf):
    h = S.momentum_entries(v.with_pos(v.bars_1h(spark, sf)), 0.3).filter("direction IS NOT NULL").select("symbol", F.col("ts").alias("bucket"), "direction")
    f = J.inner_bars(v.with_pos(v.bars_15m(spark, sf)), 60)
    # one array per (symbol, hour): at most the fine bars of an hour
    p = f.groupBy("symbol", "bucket").agg(F.array_sort(F.collect_list(F.struct(*S.BAR))).alias("path"))
    return S.bracket(h.join(p, ["symbol", "bucket"]), 0.2, 0.1).select("symbol", F.col("bucket").alias("hour"), "hit", "exit_px", "ret")


@query("seq_14_perfect_capture", f"SELECT symbol, count(iret) AS bars_total, count(*) FILTER (WHERE abs(iret) >= 0.5) AS bars_selected, sum(iret) FILTER (WHERE abs(iret) >= 0.5) AS signed_sum, sum(ln(1 + abs(iret))) FILTER (WHERE abs(iret) >= 0.5) AS log_total FROM (SELECT symbol, {IRET} AS iret FROM {{{{bars_15m}}}}) GROUP BY symbol", dbl="signed_sum log_total", dp=6)
def seq_14(spark, sf):
    from ..operators.bars import intraday_return

    b = intraday_return(v.bars_15m(spark, sf))
    on = F.abs("iret") >= 0.5
    return b.groupBy("symbol").agg(
        F.count("iret").alias("bars_total"), F.count(F.when(on, 1)).alias("bars_selected"), F.sum(F.when(on, F.col("iret"))).alias("signed_sum"), F.sum(F.when(on, F.log1p(F.abs("iret")))).alias("log_total"))


DROP1 = """SELECT symbol, et_date, pos, open, 1 AS direction FROM (SELECT *, min(CASE WHEN below THEN ts END) OVER (PARTITION BY symbol, et_date) AS first_ts, lag(ts) OVER (PARTITION BY symbol, et_date ORDER BY ts) AS prev_ts FROM (
    SELECT *, (max(high) OVER (PARTITION BY symbol, et_date ORDER BY ts) - close) / max(high) OVER (PARTITION BY symbol, et_date ORDER BY ts) >= 0.8 AS below FROM {{bars_15m}})) WHERE prev_ts = first_ts"""


@query("seq_15_day_high_drop", f"SELECT symbol, et_date, pos, hit, exit_pos, ret FROM ({settle_sql(DROP1, BARS15, 96, '0.5', '0.3')})", dbl="ret")
def seq_15(spark, sf):
    w = W.partitionBy("symbol", "et_date").orderBy("ts")
    b = v.with_pos(v.bars_15m(spark, sf))
    hi = F.max("high").over(w.rowsBetween(W.unboundedPreceding, 0))
    b = b.withColumn("_below", (hi - F.col("close")) / hi >= 0.8)
    b = b.withColumn("_first", F.min(F.when(F.col("_below"), F.col("ts"))).over(W.partitionBy("symbol", "et_date"))).withColumn("direction", F.when(F.lag("ts").over(w) == F.col("_first"), 1))
    return S.bracket(S.forward_paths(b.drop("_below", "_first"), 96, F.col("direction").isNotNull()), 0.5, 0.3).select("symbol", "et_date", "pos", "hit", "exit_pos", "ret")


AT = lambda p: f"epoch_us((SELECT b.ts FROM {{{{bars_1h}}}} b WHERE b.symbol = h.symbol AND b.pos = h.{p}))"
LAYER = f"""SELECT symbol, theta, "X", "Y", peak_pos, slice_id, peak_p * (1 - lvl) AS p_entry, rebound_p >= peak_p * (1 - lvl) * 1.02 AS hit_tp, CASE WHEN rebound_p >= peak_p * (1 - lvl) * 1.02 THEN 2000.0 * 0.02 ELSE 2000.0 * (rebound_p / (peak_p * (1 - lvl)) - 1) END AS pnl,
    CAST(ceil((rt - (pt + floor((tt - pt) * CASE WHEN lvl = 0 THEN 0.0::DOUBLE ELSE lvl / drop_pct END))) / 3600000000.0) AS BIGINT) AS hold_bars
    FROM (SELECT h.*, {AT('peak_pos')} AS pt, {AT('trough_pos')} AS tt, {AT('rebound_pos')} AS rt FROM ({HLH}) h),
    (SELECT unnest([1, 2, 3, 4, 5]) AS slice_id, unnest([0.0, 0.05, 0.05, 0.1, 0.1]::DOUBLE[]) AS lvl) WHERE drop_pct >= lvl"""


def layered(spark, sf):
    return P.layered_fills(hlh(spark, sf), bar_min=60)


@query("seq_16_layered_fills", LAYER, dbl="theta X Y p_entry pnl", dp=7)
def seq_16(spark, sf):
    return layered(spark, sf).select("symbol", "theta", "X", "Y", "peak_pos", "slice_id", "p_entry", "hit_tp", "pnl", "hold_bars")


HOLD_E = f"SELECT b.*, 1 AS direction FROM ({JUMPS}) j JOIN ({DBARS}) b ON b.symbol = j.symbol AND b.d = j.act JOIN (SELECT symbol, max(d) AS last FROM {{{{panel_day}}}} GROUP BY 1) n ON n.symbol = b.symbol WHERE b.d + 19 <= n.last"
HOLD = keep_sql(f"SELECT *, pos + 19 AS busy FROM ({settle_sql(HOLD_E, DBARS, 20, '1e9', '0.2', False)})", "symbol", "pos", "busy")


@query("seq_17_hold_rule", f"SELECT symbol, pos, hit, exit_pos, ret FROM ({HOLD})", dbl="ret", dp=7)
def seq_17(spark, sf):
    e = daily_bars_pos(spark, sf).join(jump_events(spark, sf).select("symbol", F.col("act").alias("d"), F.lit(1).alias("direction")).distinct(), ["symbol", "d"], "left")
    p = S.forward_paths(e, 20, F.col("direction").isNotNull(), same_day=False).filter(F.size("path") == 20)
    t = S.bracket(p, 1e9, 0.2).withColumn("busy", F.col("pos") + 19).withColumn("yr", F.year("et_date"))
    return S.non_overlap(t.select("symbol", "yr", "pos", "busy", "hit", "exit_pos", "ret"), "symbol", "pos", "busy", "yr").select("symbol", "pos", "hit", "exit_pos", "ret")


@query("seq_18_first_passage", f"""SELECT symbol, count(*) AS n, 100.0 * count(*) FILTER (WHERE hit = 'up') / count(*) AS up, 100.0 * count(*) FILTER (WHERE hit = 'dn') / count(*) AS dn, 100.0 * count(*) FILTER (WHERE hit = 'none') / count(*) AS "none" FROM (
    SELECT s.symbol, s.d, CASE coalesce(arg_min(CASE WHEN b.close <= s.close * 0.9 THEN 1 ELSE 2 END, b.d) FILTER (WHERE b.close <= s.close * 0.9 OR b.close >= s.close * 3), 0) WHEN 1 THEN 'dn' WHEN 2 THEN 'up' ELSE 'none' END AS hit, count(*) AS n
    FROM (SELECT *, (close / max(close) OVER ({PW} ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) - 1) * 100 AS dd FROM {{{{panel_day}}}}) s JOIN {{{{panel_day}}}} b ON b.symbol = s.symbol AND b.d > s.d AND b.d <= s.d + 60 WHERE abs(dd + 80) <= 10 GROUP BY 1, 2 HAVING count(*) = 60) GROUP BY symbol HAVING count(*) >= 30""", dbl="up dn none")
def seq_18(spark, sf):
    return P.first_passage(v.panel_day(spark, sf), -80.0, 10.0, 200.0, -10.0)


def _turn_sql(sign, depth):
    agg, opp = ("max", "min") if sign > 0 else ("min", "max")
    far = f"close / max(close) OVER p60 - 1 <= -{depth}" if sign > 0 else f"close / min(close) OVER p60 - 1 >= {depth}"
    loc = f"close = {opp}(close) OVER cen"
    mid = "s.mid < cl.bc * 1.1" if sign > 0 else "s.mid > cl.bc * 0.9"
    lt = "<" if sign > 0 else ">"
    rel = "n.bc / w.kc - 1" if sign > 0 else "1 - n.bc / w.kc"
    return f"""WITH RECURSIVE c0 AS (SELECT *, count(*) OVER p60 >= 60 AND {far} AND {loc} AS cand FROM {{{{panel_day}}}} WINDOW p60 AS ({PW} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), cen AS ({PW} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
    c1 AS (SELECT symbol, d, close, lag(d) OVER ({PW}) AS pd, row_number() OVER ({PW}) AS i FROM c0 WHERE cand),
    c2 AS MATERIALIZED (SELECT c1.symbol, c1.d, c1.close, c1.i, c1.pd, {agg}(b.close) AS mid FROM c1 LEFT JOIN {{{{panel_day}}}} b ON b.symbol = c1.symbol AND b.d BETWEEN c1.pd AND c1.d GROUP BY ALL),
    cl AS (SELECT symbol, i, d, 1 AS cid, d AS bd, close AS bc FROM c2 WHERE i = 1 UNION ALL SELECT s.symbol, s.i, s.d, CASE WHEN s.d - cl.d <= 20 AND {mid} THEN cid ELSE cid + 1 END,
      CASE WHEN s.d - cl.d <= 20 AND {mid} THEN CASE WHEN s.close {lt} cl.bc THEN s.d ELSE cl.bd END ELSE s.d END, CASE WHEN s.d - cl.d <= 20 AND {mid} THEN CASE WHEN s.close {lt} cl.bc THEN s.close ELSE cl.bc END ELSE s.close END FROM cl JOIN c2 s ON s.symbol = cl.symbol AND s.i = cl.i + 1),
    b1 AS MATERIALIZED (SELECT symbol, cid AS i, arg_max(bd, i) AS bd, arg_max(bc, i) AS bc FROM cl GROUP BY symbol, cid),
    w AS (SELECT symbol, i, 1 AS wid, bd AS kd, bc AS kc FROM b1 WHERE i = 1 UNION ALL SELECT n.symbol, n.i, CASE WHEN n.bd - w.kd <= 60 AND {rel} >= -0.05 THEN wid ELSE wid + 1 END,
      CASE WHEN n.bd - w.kd <= 60 AND {rel} > 0.05 THEN w.kd WHEN n.bd - w.kd <= 60 AND {rel} >= -0.05 THEN CASE WHEN n.bc {lt} w.kc THEN n.bd ELSE w.kd END ELSE n.bd END,
      CASE WHEN n.bd - w.kd <= 60 AND {rel} > 0.05 THEN w.kc WHEN n.bd - w.kd <= 60 AND {rel} >= -0.05 THEN CASE WHEN n.bc {lt} w.kc THEN n.bc ELSE w.kc END ELSE n.bc END FROM w JOIN b1 n ON n.symbol = w.symbol AND n.i = w.i + 1),
    pts AS (SELECT symbol, arg_max(kd, i) AS d, arg_max(kc, i) AS close FROM w GROUP BY symbol, wid)"""


PIT_DEPTH, TOP_DEPTH = 0.9, 20.0
PITS = _turn_sql(1, PIT_DEPTH) + """ SELECT symbol, d, close, n_fwd, CASE WHEN t_low IS NOT NULL AND (t_reb IS NULL OR t_low < t_reb) THEN 'false' WHEN t_reb IS NOT NULL THEN 'true' WHEN n_fwd < 60 THEN 'truncated' WHEN mx < 0.1 THEN 'false' ELSE 'mid' END AS label FROM (
    SELECT p.symbol, p.d, p.close, count(b.d) AS n_fwd, min(b.d) FILTER (WHERE b.close >= p.close * 1.25) AS t_reb, min(b.d) FILTER (WHERE b.close <= p.close * 0.9) AS t_low, max(b.close) / p.close - 1 AS mx
    FROM pts p LEFT JOIN {{panel_day}} b ON b.symbol = p.symbol AND b.d > p.d AND b.d <= p.d + 60 GROUP BY 1, 2, 3)"""
TOPS = _turn_sql(-1, TOP_DEPTH) + """ SELECT symbol, d, close, n_fwd, CASE WHEN t_high IS NOT NULL AND (t_fall IS NULL OR t_high < t_fall) THEN 'false' WHEN t_fall IS NOT NULL THEN CASE WHEN (SELECT max(q.close) FROM {{panel_day}} q WHERE q.symbol = x.symbol AND q.d > x.d AND q.d < t_fall) > close THEN 'mid' ELSE 'true' END WHEN n_fwd < 60 THEN 'truncated' ELSE 'mid' END AS label FROM (
    SELECT p.symbol, p.d, p.close, count(b.d) AS n_fwd, min(b.d) FILTER (WHERE b.close <= p.close * 0.8) AS t_fall, min(b.d) FILTER (WHERE b.close >= p.close * 1.1) AS t_high
    FROM pts p LEFT JOIN {{panel_day}} b ON b.symbol = p.symbol AND b.d > p.d AND b.d <= p.d + 60 GROUP BY 1, 2, 3) x"""


@query("seq_19_pits", PITS, dbl="close")
def seq_19(spark, sf):
    p = P.pit_labels(P.turning_points(v.panel_day(spark, sf), 1, PIT_DEPTH))
    return p.select("symbol", "d", "close", F.col("n_fwd").cast("bigint").alias("n_fwd"), "label")


@query("seq_20_tops", TOPS, dbl="close")
def seq_20(spark, sf):
    p = P.top_labels(P.turning_points(v.panel_day(spark, sf), -1, TOP_DEPTH))
    return p.select("symbol", "d", "close", F.col("n_fwd").cast("bigint").alias("n_fwd"), "label")


# ---------------------------------------------------------------- states
AND_T = f"SELECT DISTINCT symbol, act FROM (SELECT e.* FROM ({DENSE_EV}) e WHERE EXISTS (SELECT 1 FROM ({JUMPS}) j WHERE j.symbol = e.symbol AND j.time < e.time AND j.act >= e.act - 20))"


@query("seq_21_triggers", f"SELECT 'AND' AS logic, symbol, act FROM ({AND_T}) UNION ALL (SELECT DISTINCT 'OR', symbol, act FROM (SELECT symbol, act FROM ({DENSE_EV}) UNION ALL SELECT symbol, act FROM ({JUMPS}))) UNION ALL (SELECT DISTINCT 'jump_only', symbol, act FROM ({JUMPS}))")
def seq_21(spark, sf):
    dn, jp = dense_events(spark, sf), jump_events(spark, sf)
    out = [ST.triggers(dn, jp, lg).select(F.lit(lg).alias("logic"), "symbol", "act") for lg in ("AND", "OR", "jump_only")]
    return out[0].unionByName(out[1]).unionByName(out[2])


OFFN = f"SELECT p.*, EXISTS (SELECT 1 FROM ({AND_T}) t WHERE t.symbol = p.symbol AND t.act <= p.d AND p.d < t.act + 20) AS off FROM ({DAYT}) p"


def off_state(spark, sf):
    t = ST.triggers(dense_events(spark, sf), jump_events(spark, sf), "AND")
    return ST.off_days(days(spark, sf), t, F.col("act") + 20)


@query("seq_22_persistent_state", f"SELECT symbol, et_date, off FROM ({OFFN})")
def seq_22(spark, sf):
    return off_state(spark, sf).select("symbol", "et_date", "off")


REV = f"""WITH rl AS (SELECT r.symbol, r.published, p.d AS act FROM (SELECT * FROM {{{{releases}}}} WHERE change_pct < 0) r ASOF JOIN ({DAYT}) p ON p.symbol = r.symbol AND p.open_time > r.published),
    t AS (SELECT a.symbol, a.act, coalesce((SELECT arg_min(rl.act, rl.published) FROM rl WHERE rl.symbol = a.symbol AND rl.published > o.open_time), 1000000000) AS fin FROM ({AND_T}) a JOIN ({DAYT}) o ON o.symbol = a.symbol AND o.d = a.act)
    SELECT p.symbol, p.et_date, EXISTS (SELECT 1 FROM t WHERE t.symbol = p.symbol AND t.act <= p.d AND p.d < t.fin) AS off FROM ({DAYT}) p"""


@query("seq_22_until_reversal", REV)
def seq_22b(spark, sf):
    dd = days(spark, sf)
    rel = J.act_day(v.releases(spark, sf).select("symbol", "published", "change_pct"), dd, time="published")
    t = ST.triggers(dense_events(spark, sf), jump_events(spark, sf), "AND")
    return ST.until_reversal(dd, t, rel).select("symbol", "et_date", "off")


def overlay_sql(src, off="off"):
    return f"""SELECT symbol, et_date, d, switched, exp(sum(ln(CASE WHEN po IS NULL THEN CASE WHEN NOT {off} THEN 0.9999 / 1.0002 * close / open ELSE 1 END WHEN NOT {off} AND NOT po THEN close / pc WHEN {off} AND NOT po THEN open / pc * 0.9998 * 0.9999
    WHEN NOT {off} AND po THEN 0.9999 / 1.0002 * close / open ELSE 1 END)) OVER ({PW})) AS equity FROM (SELECT *, lag({off}) OVER ({PW}) AS po, lag(close) OVER ({PW}) AS pc, CASE WHEN lag({off}) OVER ({PW}) <> {off} THEN 1 ELSE 0 END AS switched FROM ({src}))"""


@query("seq_23_overlay_equity", f"SELECT symbol, et_date, ln(equity) AS log_equity, switched FROM ({overlay_sql(OFFN)})", dbl="log_equity", dp=7)
def seq_23(spark, sf):
    return ST.overlay_equity(off_state(spark, sf)).select("symbol", "et_date", F.log("equity").alias("log_equity"), "switched")


EPS = f"SELECT symbol, g, last(close ORDER BY d) / first(open ORDER BY d) - 1 AS r, count(*) AS n FROM (SELECT *, d - row_number() OVER ({PW}) AS g FROM ({OFFN}) WHERE off) GROUP BY 1, 2"


@query("seq_24_segment_eval", f"""SELECT o.symbol, ln(1 + overlay_total) AS overlay_log, ln(1 + bh_total) AS bh_log, switches, n_eps, n_right, mean_ep_ret, off_days FROM
    (SELECT symbol, arg_max(equity, d) - 1 AS overlay_total, sum(switched) AS switches FROM ({overlay_sql(OFFN)}) GROUP BY 1) o JOIN (SELECT symbol, arg_max(equity, d) - 1 AS bh_total FROM ({overlay_sql(f'SELECT *, false AS never FROM ({DAYT})', 'never')}) GROUP BY 1) h USING (symbol)
    LEFT JOIN (SELECT symbol, count(*) AS n_eps, count(*) FILTER (WHERE r < -0.0005) AS n_right, avg(r) AS mean_ep_ret, sum(n)::BIGINT AS off_days FROM ({EPS}) GROUP BY 1) e USING (symbol)""", dbl="overlay_log bh_log mean_ep_ret", dp=6)
def seq_24(spark, sf):
    s = ST.segment_eval(off_state(spark, sf))
    return s.select("symbol", F.log1p("overlay_total").alias("overlay_log"), F.log1p("bh_total").alias("bh_log"), "switches", "n_eps", "n_right", "mean_ep_ret", "off_days")


LAT = f"""WITH p AS (SELECT *, (close / open - 1) * 0.001 AS r FROM ({SW})), win AS (SELECT * FROM p WHERE et_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'),
    pk AS (SELECT symbol, arg_max(d, {{'c': close, 'd': -d}}) AS peak_d, exp(sum(ln(1 + r))) AS al FROM win GROUP BY 1), bt AS (SELECT w.symbol, arg_min(w.d, {{'c': close, 'd': w.d}}) AS bottom_d FROM win w JOIN pk USING (symbol) WHERE w.d >= peak_d GROUP BY 1),
    a AS (SELECT p.symbol, peak_d, bottom_d, al, min(p.d) FILTER (WHERE p.d >= peak_d AND s1_off) AS off_d, min(p.d) FILTER (WHERE p.d >= bottom_d AND NOT s1_off) AS open_d FROM p JOIN pk USING (symbol) JOIN bt USING (symbol) GROUP BY 1, 2, 3, 4),
    k AS (SELECT w.symbol, coalesce(exp(sum(ln(1 + r)) FILTER (WHERE w.d < off_d)), 1) AS b FROM win w JOIN a USING (symbol) GROUP BY 1)
    SELECT a.symbol, peak_d, bottom_d, off_d - peak_d AS off_lag, CASE WHEN open_d >= off_d THEN open_d - bottom_d END AS reopen_lag, CASE WHEN al < 1 THEN (b - 1) / (al - 1) END AS loss_share FROM a JOIN k USING (symbol)"""


@query("seq_25_switch_latency", LAT, dbl="loss_share", dp=6)
def seq_25(spark, sf):
    s = R.bear_switches(v.panel_day(spark, sf), dd=-0.8)
    return ST.switch_latency(s, "s1_off", "1998-01-01", "1998-12-31", (F.col("close") / F.col("open") - 1) * 0.001)


@query("seq_26_entry_dedup", f"""SELECT symbol, act_d, arg_min(accession, {{'f': filed, 'a': accession}}) AS accession, count(*) AS n_events FROM (SELECT f.symbol, f.accession, f.filed, p.d AS act_d FROM ({FILINGS}) f ASOF JOIN ({DAYT}) p ON p.symbol = f.symbol AND p.open_time > f.filed WHERE f.form <> '10-K') GROUP BY 1, 2""")
def seq_26(spark, sf):
    f = filings(spark, sf).filter("form <> '10-K'").select("symbol", "accession", "filed")
    a = J.act_day(f, days(spark, sf), time="filed").filter("act_d IS NOT NULL")
    return a.groupBy("symbol", "act_d").agg(F.min_by("accession", F.struct("filed", "accession")).alias("accession"), F.count(F.lit(1)).alias("n_events"))


def replay(spark, sf):
    """Journaled orders (one per bar, tagged with its end) replayed on the bars."""
    from ..operators.asof import asof_forward

    b = v.with_pos(v.bars_15m(spark, sf))
    o = b.select("symbol", F.col("pos").alias("order_id"), tm.plus_seconds("ts", 900).alias("anchor"), F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("direction"))
    o = asof_forward(o, b.select("symbol", "ts", F.col("pos").alias("epos")), "symbol", "anchor", "ts", ["epos"], strict=False).filter("epos IS NOT NULL")
    # several orders can point at one bar: each is settled on its own
    p = S.forward_paths(b, 4, F.lit(True)).join(o.select("symbol", F.col("epos").alias("pos"), "order_id", "direction"), ["symbol", "pos"])
    limit = tm.micros("ts") + 3_600_000_000
    p = p.withColumn("path", F.filter("path", lambda x: (F.unix_micros(x["ts"].cast("timestamp")) < limit) & (tm.et_minute(x["ts"]) < 955))).filter(F.size("path") > 0)
    t = S.bracket(p, 0.2, 0.1).withColumn("busy", tm.micros("exit_ts") + 900_000_000 - 1).withColumn("start", tm.micros("ts"))
    t = t.select("symbol", "et_date", "order_id", "pos", "start", "busy", "hit", "exit_pos", "ret")
    return S.non_overlap(t, "symbol", "start", "busy", "et_date")


ORD = "SELECT b.symbol, b.pos AS order_id, CASE WHEN b.close > b.open THEN 1 ELSE -1 END AS direction, b.ts + INTERVAL 15 MINUTE AS anchor FROM {{bars_15m}} b"
ORDE = f"SELECT o.symbol, o.order_id, o.direction, e.pos, e.ts, e.et_date, e.open FROM ({ORD}) o ASOF JOIN {{{{bars_15m}}}} e ON e.symbol = o.symbol AND e.ts >= o.anchor"
REPL = settle_sql(ORDE, f"SELECT * FROM {{{{bars_15m}}}} WHERE {ET_MIN} < 955", 4).replace("GROUP BY ALL", "AND b.ts < e.ts + INTERVAL 1 HOUR GROUP BY ALL")


@query("seq_27_order_replay", "SELECT symbol, order_id, pos, hit, exit_pos, ret FROM (" + keep_sql(f"SELECT r.*, epoch_us(r.ts) AS start, epoch_us(x.ts) + 900000000 - 1 AS busy FROM ({REPL}) r JOIN {{{{bars_15m}}}} x ON x.symbol = r.symbol AND x.pos = r.exit_pos", "symbol", "start", "busy") + ")", dbl="ret")
def seq_27(spark, sf):
    return replay(spark, sf).select("symbol", "order_id", "pos", "hit", "exit_pos", "ret")


def scores_at(spark, sf, now):
    from .joins import interps

    i = interps(spark, sf).join(v.dated(spark, sf).select("event_id", F.col("event_type").alias("symbol")), "event_id")
    return ST.score_interpretations(i, v.bars_day(spark, sf), now)


def scores_sql(now):
    return f"""SELECT event_id, created, direction, d1_date, ret_1d, ret_5d, CASE WHEN direction <> 'neutral' THEN CASE WHEN ret_1d IS NULL THEN 'pending' WHEN (direction = 'bullish' AND ret_1d > 0) OR (direction = 'bearish' AND ret_1d < 0) THEN 'hit' ELSE 'miss' END END AS score_1d,
    CASE WHEN direction <> 'neutral' THEN CASE WHEN ret_5d IS NULL THEN 'pending' WHEN (direction = 'bullish' AND ret_5d > 0) OR (direction = 'bearish' AND ret_5d < 0) THEN 'hit' ELSE 'miss' END END AS score_5d FROM (
    SELECT i.event_id, i.created, i.direction, s.et_date AS d1_date, CASE WHEN s.close_time + INTERVAL 5 MINUTE <= TIMESTAMP '{now}' THEN s.close / s.open - 1 END AS ret_1d,
    CASE WHEN s.c5t + INTERVAL 5 MINUTE <= TIMESTAMP '{now}' THEN s.c5 / s.open - 1 END AS ret_5d FROM (SELECT i.*, e.event_type AS symbol FROM {{{{interps}}}} i JOIN events e USING (event_id)) i ASOF LEFT JOIN (SELECT *, lead(close, 4) OVER ({PW}) AS c5, lead(close_time, 4) OVER ({PW}) AS c5t FROM {{{{bars_day}}}}) s
    ON s.symbol = i.symbol AND s.open_time >= i.created)"""


@query("seq_28_interpretation_scores", f"SELECT event_id, d1_date, ret_1d, ret_5d, score_1d, score_5d FROM ({scores_sql('2024-01-22 12:00:00')})", dbl="ret_1d ret_5d")
def seq_28(spark, sf):
    return scores_at(spark, sf, "2024-01-22 12:00:00").select("event_id", "d1_date", "ret_1d", "ret_5d", "score_1d", "score_5d")


def _old_new(spark, sf):
    cols = ["event_id", "d1_date", "ret_1d", "ret_5d", "score_1d", "score_5d"]
    old = scores_at(spark, sf, "2024-01-12 12:00:00").filter("created < timestamp_ntz'2024-01-16 00:00:00'").select(*cols).withColumn("_row", F.lit(1))
    old = old.withColumn("ret_1d", F.when(F.col("event_id") % 60 == 0, F.col("ret_1d") + 0.01).otherwise(F.col("ret_1d")))
    return old, scores_at(spark, sf, "2024-01-22 12:00:00").select(*cols)


ON = f"WITH o AS (SELECT event_id, d1_date, CASE WHEN event_id % 60 = 0 THEN ret_1d + 0.01 ELSE ret_1d END AS ret_1d, ret_5d, score_1d, score_5d FROM ({scores_sql('2024-01-12 12:00:00')}) WHERE created < TIMESTAMP '2024-01-16'), n AS (SELECT * FROM ({scores_sql('2024-01-22 12:00:00')})) "


@query("seq_29_write_once", ON + """SELECT coalesce(o.event_id, n.event_id) AS event_id, coalesce(o.d1_date, n.d1_date) AS d1_date, coalesce(o.ret_1d, n.ret_1d) AS ret_1d, coalesce(o.ret_5d, n.ret_5d) AS ret_5d,
    CASE WHEN o.event_id IS NULL OR o.score_1d = 'pending' THEN n.score_1d ELSE o.score_1d END AS score_1d, CASE WHEN o.event_id IS NULL OR o.score_5d = 'pending' THEN n.score_5d ELSE o.score_5d END AS score_5d FROM o FULL JOIN n ON o.event_id = n.event_id""", dbl="ret_1d ret_5d")
def seq_29(spark, sf):
    return ST.merge_scores(*_old_new(spark, sf))


@query("seq_29_conflicts", ON + "SELECT o.event_id, 'ret_1d' AS field FROM o JOIN n ON o.event_id = n.event_id WHERE abs(o.ret_1d - n.ret_1d) > 1e-9")
def seq_29b(spark, sf):
    return ST.score_conflicts(*_old_new(spark, sf))


GEO = [(0.1, 0.1), (0.2, 0.1), (0.5, 0.3)]


@query("seq_30_geometries", "SELECT symbol, pos, tp, sl, hit, exit_pos, ret FROM (" + settle_sql(f"SELECT m.*, g.* FROM ({MOM}) m, (SELECT unnest([0.1, 0.2, 0.5]::DOUBLE[]) AS tp, unnest([0.1, 0.1, 0.3]::DOUBLE[]) AS sl) g", BARS15, 8, "tp", "sl") + ")", dbl="tp sl ret")
def seq_30(spark, sf):
    p = nm.grid_rows(S.forward_paths(mom(spark, sf), 8, F.col("direction").isNotNull()), ["tp", "sl"], GEO)
    return S.bracket(p, F.col("tp"), F.col("sl")).select("symbol", "pos", "tp", "sl", "hit", "exit_pos", "ret")


BLIND = f"SELECT symbol, et_date, CASE WHEN extract(day FROM et_date) % 9 = 0 THEN NULL ELSE n END AS n FROM ({SPINE})"
CRED = JUMPS.replace("change_pct >= 30", "change_pct >= 30 AND change_pct < 400")
DET = f"""WITH c AS (SELECT *, quantile_cont(n, 0.9) OVER (PARTITION BY symbol ORDER BY et_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tb FROM ({BLIND})), pd AS (SELECT symbol, et_date, d FROM {{{{panel_day}}}}), cr AS ({CRED}),
    c2 AS (SELECT c.*, pd.d AS t FROM c ASOF JOIN pd ON pd.symbol = c.symbol AND pd.et_date > c.et_date),
    c3 AS (SELECT c2.*, cr.act AS ja, first_value(tb) OVER (PARTITION BY c2.symbol, t ORDER BY et_date) AS thr FROM (SELECT *, CAST(et_date + 1 AS TIMESTAMP) + INTERVAL 5 HOUR - INTERVAL 1 SECOND AS de FROM c2) c2 ASOF LEFT JOIN cr ON cr.symbol = c2.symbol AND cr.time < c2.de),
    r AS (SELECT symbol, t, count(n) > 0 AS valid, bool_or(coalesce(n > thr AND ja >= t - 20, false)) AS hit FROM c3 GROUP BY 1, 2),
    s AS (SELECT pd.*, coalesce(count(*) FILTER (WHERE valid) OVER (PARTITION BY pd.symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_eff_before, coalesce(hit, false) AS hit FROM pd LEFT JOIN r ON r.symbol = pd.symbol AND r.t = pd.d)
    SELECT symbol, et_date, d, n_eff_before, n_eff_before >= 20 AND hit AS triggered, CASE WHEN n_eff_before < 20 THEN 'CALIBRATING' WHEN max(CASE WHEN n_eff_before >= 20 AND hit THEN d + 19 END) OVER (PARTITION BY symbol ORDER BY d) >= d THEN 'RISK_OFF' ELSE 'RISK_ON' END AS state FROM s"""


def blind_counts(spark, sf):
    return daily_counts(spark, sf).withColumn("n", F.when(F.dayofmonth("et_date") % 9 != 0, F.col("n")))


def credible_jumps(spark, sf):
    r = v.releases(spark, sf).filter("change_pct >= 30 AND change_pct < 400")
    a = J.act_day(r.select("symbol", F.col("published").alias("time")), days(spark, sf), time="time")
    return a.filter("act_d is not null").select("symbol", "time", F.col("act_d").alias("act"))


@query("seq_31_detector_state", DET)
def seq_31(spark, sf):
    return ST.detector_daily(days(spark, sf), blind_counts(spark, sf), credible_jumps(spark, sf))


@query("seq_32_shadow_state", f"""SELECT symbol, et_date, d, n_active, t > 0 AS triggered, CASE WHEN n_active > 0 THEN 'RISK_OFF' ELSE 'RISK_ON' END AS state FROM (SELECT p.symbol, p.et_date, p.d, count(j.act) AS n_active, count(j.act) FILTER (WHERE j.act = p.d) AS t
    FROM {{{{panel_day}}}} p LEFT JOIN ({CRED}) j ON j.symbol = p.symbol AND j.act <= p.d AND p.d <= j.act + 29 GROUP BY 1, 2, 3)""")
def seq_32(spark, sf):
    return ST.shadow_daily(days(spark, sf), credible_jumps(spark, sf))


@query("seq_33_effective_baseline", f"""WITH pd AS (SELECT symbol, et_date, d FROM {{{{panel_day}}}}), c AS (SELECT c.*, pd.d AS t FROM ({BLIND}) c ASOF JOIN pd ON pd.symbol = c.symbol AND pd.et_date > c.et_date)
    SELECT symbol, count(DISTINCT t) FILTER (WHERE n IS NOT NULL) AS n_effective, count(DISTINCT et_date) FILTER (WHERE n IS NULL) AS n_blind FROM c GROUP BY symbol""")
def seq_33(spark, sf):
    from ..operators.asof import asof_forward

    c = asof_forward(blind_counts(spark, sf), v.panel_day(spark, sf).select("symbol", F.col("et_date").alias("t_date"), F.col("d").alias("t")), "symbol", "et_date", "t_date", ["t"], strict=True).filter("t IS NOT NULL")
    # one map per trading day: the natural days since the previous one
    rows = c.groupBy("symbol", "t").agg(F.map_from_entries(F.collect_list(F.struct("et_date", F.col("n").cast("int")))).alias("window"))
    return ST.effective_baseline(rows)


@query("seq_34_stream_continuation", f"SELECT symbol, pos, blocked, CASE WHEN NOT blocked THEN sum(CASE WHEN blocked THEN 0 ELSE ln(1 + ret * 0.0005) END) OVER (PARTITION BY symbol ORDER BY pos) END AS log_eq FROM (SELECT *, et_date::VARCHAR LIKE '%5' AS blocked FROM ({keep_sql(f'SELECT * FROM ({BRACK}) WHERE pos > 400', 'symbol', 'pos', 'exit_pos')}))", dbl="log_eq", dp=8)
def seq_34(spark, sf):
    t = mom_trades(spark, sf).select("symbol", "et_date", "pos", "exit_pos", "ret")
    k = S.non_overlap(t, "symbol", "pos", "exit_pos", "et_date", seed=F.lit(400)).withColumn("blocked", F.col("et_date").cast("string").endswith("5"))
    k = spread.running(k, "symbol", "et_date", "pos", _eq=("sum", F.when(F.col("blocked"), 0.0).otherwise(F.log1p(F.col("ret") * 0.0005))))
    return k.select("symbol", "pos", "blocked", F.when(~F.col("blocked"), F.col("_eq")).alias("log_eq"))


DOWNS = JUMPS.replace("change_pct >= 30", "change_pct <= -20")
REDISC = f"""WITH e AS ({DENSE_EV}), u AS ({JUMPS}), dn AS ({DOWNS}), p AS (SELECT symbol, d, lead(close, 19) OVER ({PW}) / open - 1 AS r20, lag(close) OVER ({PW}) / lag(open, 20) OVER ({PW}) - 1 AS past FROM {{{{panel_day}}}}),
    f AS (SELECT e.symbol, e.act, EXISTS (SELECT 1 FROM u WHERE u.symbol = e.symbol AND u.time < e.time AND u.act >= e.act - 20) AS up, EXISTS (SELECT 1 FROM dn WHERE dn.symbol = e.symbol AND dn.time < e.time AND dn.act >= e.act - 20) AS dw FROM e WHERE e.act >= 20),
    g AS (SELECT f.*, r20, past FROM f JOIN p ON p.symbol = f.symbol AND p.d = f.act WHERE f.act + 19 <= 1800)
    SELECT symbol, count(*) FILTER (WHERE NOT up AND dw) AS n_excluded, count(*) FILTER (WHERE up) AS n_pre_up, count(*) FILTER (WHERE NOT up AND NOT dw) AS n_ctrl, avg(r20) FILTER (WHERE up) * 1e4 AS mean_pre_bp, avg(r20) FILTER (WHERE NOT up AND NOT dw) * 1e4 AS mean_ctrl_bp, avg(past) FILTER (WHERE up) * 1e4 AS past_pre_bp FROM g GROUP BY symbol"""


@query("seq_35_rediscovery", REDISC, dbl="mean_pre_bp mean_ctrl_bp past_pre_bp", dp=4)
def seq_35(spark, sf):
    dn = dense_events(spark, sf).filter("act >= 20 AND act + 19 <= 1800")
    up = J.precursor(dn, jump_events(spark, sf), 20).withColumnRenamed("has_pre", "up").drop("gap")
    r = v.releases(spark, sf).filter("change_pct <= -20")
    downs = J.act_day(r.select("symbol", F.col("published").alias("time")), days(spark, sf), time="time").filter("act_d is not null").select("symbol", "time", F.col("act_d").alias("act"))
    both = J.precursor(up, downs, 20).withColumnRenamed("has_pre", "dw")
    w = W.partitionBy("symbol").orderBy("d")
    p = v.panel_day(spark, sf).select("symbol", F.col("d").alias("act"), (F.lead("close", 19).over(w) / F.col("open") - 1).alias("r20"), (F.lag("close").over(w) / F.lag("open", 20).over(w) - 1).alias("past"))
    g = both.join(p, ["symbol", "act"])
    ctrl = ~F.col("up") & ~F.col("dw")
    return g.groupBy("symbol").agg(
        F.count(F.when(~F.col("up") & F.col("dw"), 1)).alias("n_excluded"), F.count(F.when(F.col("up"), 1)).alias("n_pre_up"), F.count(F.when(ctrl, 1)).alias("n_ctrl"),
        (F.avg(F.when(F.col("up"), F.col("r20"))) * 1e4).alias("mean_pre_bp"), (F.avg(F.when(ctrl, F.col("r20"))) * 1e4).alias("mean_ctrl_bp"), (F.avg(F.when(F.col("up"), F.col("past"))) * 1e4).alias("past_pre_bp"))


@query("seq_36_completeness_gate", ON + "SELECT i.event_id FROM {{interps}} i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.event_id = i.event_id AND o.ret_1d IS NOT NULL AND o.ret_5d IS NOT NULL)")
def seq_36(spark, sf):
    from .joins import interps

    return ST.to_score(interps(spark, sf).select("event_id"), _old_new(spark, sf)[0])


DSIM = keep_sql(settle_sql(DENTRY, DBARS, 10, "0.5", "0.3", False), "symbol", "sig_d", "exit_pos")


def daily_sim(spark, sf, tp=0.5, sl=0.3, horizon=10):
    t = S.bracket(daily_paths(spark, sf, horizon), tp, sl).withColumn("sig_d", F.col("pos") - 1).withColumn("yr", F.year("et_date"))
    t = t.select("symbol", "yr", "et_date", "direction", "sig_d", F.col("pos").alias("entry_d"), F.col("exit_pos").alias("exit_d"), "entry_px", "hit", "ret")
    return S.non_overlap(t, "symbol", "sig_d", "exit_d", "yr")


@query("seq_37_daily_simulation", f"SELECT symbol, direction, sig_d, pos AS entry_d, exit_pos AS exit_d, hit, ret FROM ({DSIM})", dbl="ret", dp=8)
def seq_37(spark, sf):
    return daily_sim(spark, sf).select("symbol", "direction", "sig_d", "entry_d", "exit_d", "hit", "ret")


LSIM = keep_sql(settle_sql(DENTRY.replace("s.direction", "1 AS direction").replace(f"({DSIG}) s", f"(SELECT * FROM ({DSIG}) WHERE direction = 1) s"), DBARS, 10, "0.5", "0.3", False), "symbol", "sig_d", "exit_pos")


def long_sim(spark, sf):
    b = daily_entries(spark, sf).withColumn("direction", F.when(F.col("direction") == 1, 1))
    p = S.forward_paths(b, 10, F.col("direction").isNotNull(), same_day=False)
    t = S.bracket(p, 0.5, 0.3).withColumn("sig_d", F.col("pos") - 1).withColumn("yr", F.year("et_date"))
    t = t.select("symbol", "yr", "et_date", "sig_d", F.col("pos").alias("entry_d"), F.col("exit_pos").alias("exit_d"), "entry_px", "hit", (F.col("ret") * 1.0).alias("ret"))
    return S.non_overlap(t, "symbol", "sig_d", "exit_d", "yr")


@query("win_32_mark_to_market", f"""WITH t AS MATERIALIZED (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY symbol ORDER BY pos) AS la FROM ({LSIM}))
    SELECT symbol, et_date, coalesce(last_value(m IGNORE NULLS) OVER ({PW}), 0) AS log_equity FROM (SELECT p.symbol, p.et_date, CASE WHEN p.d = t.exit_pos THEN la WHEN t.pos IS NOT NULL THEN la - ln(1 + t.ret) + ln(p.close / t.entry_px) END AS m
    FROM {{{{panel_day}}}} p LEFT JOIN t ON t.symbol = p.symbol AND p.d BETWEEN t.pos AND t.exit_pos)""", dbl="log_equity", dp=6)
def win_32(spark, sf):
    return S.mark_to_market(long_sim(spark, sf), v.panel_day(spark, sf)).select("symbol", "et_date", F.log("equity").alias("log_equity"))


PORT = f"SELECT symbol, pos AS entry_pos, exit_pos, entry_px, 100.0 + pos % 50 AS alloc, ret FROM ({settle_sql(MOM.replace('{{bars_15m}}', '{{bars_1h}}'), BARS1H, 6)}) WHERE direction = 1"


@query("win_33_portfolio_path", f"""WITH t AS MATERIALIZED ({PORT}), j AS (SELECT t.*, b.pos, b.ts, CASE WHEN b.pos < exit_pos THEN alloc * b.close / entry_px ELSE 0 END AS val FROM t JOIN {{{{bars_1h}}}} b ON b.symbol = t.symbol AND b.pos BETWEEN entry_pos AND exit_pos),
    k AS (SELECT *, val - coalesce(lag(val) OVER (PARTITION BY symbol, entry_pos ORDER BY pos), 0) + CASE WHEN pos = entry_pos THEN -alloc ELSE 0 END + CASE WHEN pos = exit_pos THEN alloc * (1 + ret) ELSE 0 END AS delta, CASE WHEN pos = entry_pos THEN 1 ELSE 0 END - CASE WHEN pos = exit_pos THEN 1 ELSE 0 END AS dc FROM j)
    SELECT ts, 10000 + sum(delta) OVER (ORDER BY ts) AS equity, (sum(dc) OVER (ORDER BY ts))::BIGINT AS n_open FROM (SELECT ts, sum(delta) AS delta, sum(dc) AS dc FROM k GROUP BY ts)""", dbl="equity", dp=5)
def win_33(spark, sf):
    b = v.with_pos(v.bars_1h(spark, sf))
    t = S.bracket(S.forward_paths(S.momentum_entries(b, 0.3), 6, F.col("direction") == 1), 0.2, 0.1)
    t = t.select("symbol", F.col("pos").alias("entry_pos"), "exit_pos", "entry_px", (100.0 + F.col("pos") % 50).alias("alloc"), "ret")
    return S.portfolio_path(t, b, 10000.0)
