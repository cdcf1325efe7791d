"""Statistics queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import settle as S
from ..operators import simulate as SM
from ..operators import spread
from ..operators import stats as T
from ..session import cut
from ..sources.tables import table
from . import sequences as q
from . import views as v
from .joins import DENSE_EV, dense_events, jump_events
from .registry import query
from .selections import COMBO, combos
from .windows import PW

SCR = "SELECT doc_id, score, label, toxic, symbol FROM {{scored}}"


def rank_sql(src, n, seed, rid, extra=""):
    part = f"rep{', ' + extra if extra else ''}"
    return f"SELECT s.*, rep, row_number() OVER (PARTITION BY {part} ORDER BY md5('{seed}:' || rep || ':' || {rid})) AS rk FROM ({src}) s, (SELECT unnest(range({n})) AS rep)"


@query("stat_01_permutation", f"""WITH o AS (SELECT count(*) AS n, sum(label)::BIGINT AS k, sum(score) AS sx, abs(avg(score) FILTER (WHERE label = 1) - avg(score) FILTER (WHERE label = 0)) AS obs FROM ({SCR})),
    p AS (SELECT rep, sum(CASE WHEN rk <= k THEN score ELSE 0 END) AS s FROM ({rank_sql(SCR, 2000, 7, 'doc_id')}), o GROUP BY rep)
    SELECT obs, n, k AS n_pos, avg((abs(s / k - (sx - s) / (n - k)) >= obs - 1e-12)::INT) AS p_value FROM p, o GROUP BY ALL""", dbl="obs p_value", dp=7)
def stat_01(spark, sf):
    return T.permutation_test(v.scored(spark, sf), "score", "label", "doc_id")


@query("stat_02_stratified_permutation", f"""WITH o AS (SELECT count(*) AS n, sum(label) AS k, sum(score) AS sx, avg(score) FILTER (WHERE label = 1) - avg(score) FILTER (WHERE label = 0) AS obs FROM ({SCR})), w AS (SELECT symbol, sum(label) AS ks FROM ({SCR}) GROUP BY 1),
    p AS (SELECT rep, sum(CASE WHEN rk <= ks THEN score ELSE 0 END) AS s FROM ({rank_sql(SCR, 2000, 11, 'doc_id', 'symbol')}) JOIN w USING (symbol) GROUP BY rep)
    SELECT obs, avg((s / k - (sx - s) / (n - k) <= obs + 1e-12)::INT) AS p_one, avg((abs(s / k - (sx - s) / (n - k)) >= abs(obs) - 1e-12)::INT) AS p_two FROM p, o GROUP BY ALL""", dbl="obs p_one p_two", dp=7)
def stat_02(spark, sf):
    return T.stratified_permutation(v.scored(spark, sf), "score", "label", "doc_id", "symbol")


DAYX = "SELECT symbol, d, close / open - 1 AS x FROM {{panel_day}}"


@query("stat_03_stratified_draw", f"WITH sz AS (SELECT symbol, count(*) AS k FROM ({DENSE_EV}) GROUP BY 1) SELECT rep, avg(x) AS mean_x, count(*) AS n FROM ({rank_sql(DAYX, 1000, 13, 'd', 'symbol')}) JOIN sz USING (symbol) WHERE rk <= k GROUP BY rep", dbl="mean_x", dp=7)
def stat_03(spark, sf):
    p = v.panel_day(spark, sf).select("symbol", "d", (F.col("close") / F.col("open") - 1).alias("x"))
    return T.stratified_draw(p, "x", "d", "symbol", dense_events(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("k")), 1000)


POOL = "SELECT et_date, avg(close / open - 1) - 3 AS x FROM {{panel_day}} GROUP BY et_date"


def boot_sql(n, seed, bl):
    return f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY et_date) - 1 AS idx FROM ({POOL})), c AS (SELECT count(*) AS n FROM s), d AS (SELECT rep, (('0x' || substr(md5('{seed}:' || rep || ':' || (idx // {bl})), 1, 12))::BIGINT % n + idx % {bl}) % n AS pick FROM s, c, (SELECT unnest(range({n})) AS rep)),
    m AS (SELECT rep, avg(x) AS mean_x FROM d JOIN s ON s.idx = d.pick GROUP BY rep) SELECT (count(*) FILTER (WHERE mean_x <= 0) + 1) / (count(*) + 1) AS p_value, quantile_cont(mean_x, 0.025) AS lo, quantile_cont(mean_x, 0.975) AS hi FROM m"""


def pool(spark, sf):
    p = v.panel_day(spark, sf).groupBy("et_date").agg((F.avg(F.col("close") / F.col("open") - 1) - 3).alias("x"))
    return p.withColumn("yr", F.year("et_date"))


@query("stat_04_bootstrap", boot_sql(2000, 17, 1), dbl="p_value lo hi", dp=7)
def stat_04(spark, sf):
    return T.bootstrap_summary(T.bootstrap_means(pool(spark, sf), "x", "et_date", "yr", 2000))


@query("stat_05_block_bootstrap", boot_sql(2000, 41, 20), dbl="p_value lo hi", dp=7)
def stat_05(spark, sf):
    return T.bootstrap_summary(T.bootstrap_means(pool(spark, sf), "x", "et_date", "yr", 2000, seed=41, block_len=20))


MCP = f"SELECT symbol, et_date, pos, ret * 0.0005 AS ret, mae * 0.01 AS mae FROM (SELECT t.*, (SELECT least(min(b.close / t.entry_px - 1), 0) FROM {{{{bars_15m}}}} b WHERE b.symbol = t.symbol AND b.pos BETWEEN t.pos AND t.exit_pos) AS mae FROM ({q.BRACK}) t WHERE direction = 1)"
HEX = lambda txt: f"('0x' || substr(md5({txt}), 1, 12))::BIGINT"


@query("stat_06_monte_carlo", f"""WITH pl AS MATERIALIZED ({MCP}), h AS (SELECT *, row_number() OVER (ORDER BY et_date, symbol, pos) - 1 AS idx FROM pl WHERE et_date >= DATE '2024-01-16'), c AS (SELECT *, row_number() OVER (ORDER BY et_date, symbol, pos) - 1 AS idx FROM pl WHERE et_date < DATE '2024-01-16'),
    z AS (SELECT (SELECT count(*) FROM h) AS nh, (SELECT count(*) FROM c) AS nc), gr AS (SELECT path, step, step // 5 AS blk, step % 5 AS off, nh, nc FROM (SELECT unnest(range(10000)) AS path), (SELECT unnest(range(54)) AS step), z),
    g2 AS (SELECT *, {HEX("'29:iid:' || path || ':' || step")} % nh AS iid, ({HEX("'29:h:' || path || ':' || blk")} % nh + off) % nh AS hb, {HEX("'29:c:' || path || ':' || blk")} % (nc - 4) + off AS cb, {HEX("'29:coin:' || path || ':' || blk")} % 1000 < 200 AS coin FROM gr),
    d AS (SELECT path, step, 'iid' AS scheme, 'h' AS src, iid AS idx FROM g2 UNION ALL SELECT path, step, 'block', 'h', hb FROM g2 UNION ALL SELECT path, step, 'contam', CASE WHEN coin THEN 'c' ELSE 'h' END, CASE WHEN coin THEN cb ELSE hb END FROM g2),
    j AS (SELECT d.*, lev, coalesce(h.ret, c.ret) AS ret, coalesce(h.mae, c.mae) AS mae FROM d LEFT JOIN h ON d.src = 'h' AND h.idx = d.idx LEFT JOIN c ON d.src = 'c' AND c.idx = d.idx, (SELECT unnest([1.0, 2.0]::DOUBLE[]) AS lev)),
    e AS (SELECT *, exp(sum(ln(1 + lev * ret)) OVER w) AS eq, sum((ret >= 0)::INT) OVER w AS wins FROM j WINDOW w AS (PARTITION BY scheme, lev, path ORDER BY step)),
    f AS (SELECT *, coalesce(lag(eq) OVER w, 1) * (1 + least(lev * mae, 0)) AS trough, greatest(coalesce(max(eq) OVER (PARTITION BY scheme, lev, path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 1) AS pk FROM e WINDOW w AS (PARTITION BY scheme, lev, path ORDER BY step)),
    st AS (SELECT scheme, lev, path, max(k) AS s FROM (SELECT scheme, lev, path, wins, count(*) AS k FROM f WHERE ret < 0 GROUP BY ALL) GROUP BY ALL),
    m AS (SELECT scheme, lev, path, arg_max(eq, step) - 1 AS total, min(least(trough / pk - 1, eq / greatest(pk, eq) - 1)) AS mdd FROM f GROUP BY ALL)
    SELECT m.scheme, m.lev, {', '.join(f"quantile_cont({c}, {p}) AS {c}_p{int(p * 100)}" for c in ('total', 'mdd') for p in (0.05, 0.5, 0.95))}, max(coalesce(s, 0)) AS worst_streak FROM m LEFT JOIN st ON st.scheme = m.scheme AND st.lev = m.lev AND st.path = m.path GROUP BY 1, 2""",
       dbl="lev total_p5 total_p50 total_p95 mdd_p5 mdd_p50 mdd_p95", dp=7)
def stat_06(spark, sf):
    from ..operators.metrics import mae

    p = mae(q.mom_trades(spark, sf).filter("direction = 1"))
    p = p.select(F.struct("et_date", "symbol", "pos").alias("row_id"), "et_date", (F.col("ret") * 0.0005).alias("ret"), (F.col("mae") * 0.01).alias("mae"))
    p, edge = cut(p, "pool"), F.lit("2024-01-16").cast("date")
    return SM.path_summary(SM.monte_carlo(p.filter(F.col("et_date") >= edge), p.filter(F.col("et_date") < edge), "row_id", "et_date"))


ALLB = q.settle_sql("SELECT symbol, ts, et_date, pos, open, 1 AS direction FROM {{bars_15m}}", q.BARS15, 8)


@query("stat_07_random_entry", f"""WITH a AS MATERIALIZED (SELECT symbol, pos, ret FROM ({ALLB})), rl AS (SELECT symbol, count(*) AS k, avg(ret) * 1e4 AS real_bp FROM ({q.KEPT}) WHERE direction = 1 GROUP BY 1),
    s AS (SELECT symbol, sim, avg(ret) * 1e4 AS avg_bp FROM (SELECT a.*, sim, row_number() OVER (PARTITION BY sim, symbol ORDER BY md5('31:' || sim || ':' || symbol || ':' || pos)) AS rk FROM a, (SELECT unnest(range(200)) AS sim)) JOIN rl USING (symbol) WHERE rk <= k GROUP BY 1, 2)
    SELECT symbol, avg(avg_bp) AS rand_bp_mean, quantile_cont(avg_bp, 0.95) AS rand_bp_p95, avg((avg_bp >= real_bp)::INT) AS share_ge_real FROM s JOIN rl USING (symbol) GROUP BY 1""", dbl="rand_bp_mean rand_bp_p95 share_ge_real", dp=5)
def stat_07(spark, sf):
    b = v.with_pos(v.bars_15m(spark, sf))
    # both are read by more than one pass over the simulations
    a = cut(S.bracket(S.forward_paths(b.withColumn("direction", F.lit(1)), 8, F.lit(True)), 0.2, 0.1).select("symbol", "pos", "ret"), "settled")
    real = cut(q.kept_trades(spark, sf, b).filter("direction = 1").groupBy("symbol").agg(F.count(F.lit(1)).alias("k"), (F.avg("ret") * 1e4).alias("real_bp")), "real")
    sims = SM.random_entries(a, real.select("symbol", "k"), "pos")
    return SM.against_real(sims, real)


@query("stat_08_random_windows", f"""WITH ep AS (SELECT symbol, min(d) AS ep, count(*) AS dur FROM (SELECT *, d - row_number() OVER ({PW}) AS g FROM ({q.OFFN}) WHERE off) GROUP BY symbol, g),
    dl AS (SELECT symbol, d - 1 AS pos, lr FROM (SELECT symbol, d, ln(close / lag(close) OVER ({PW})) AS lr FROM {{{{panel_day}}}}) WHERE d > 0), sz AS (SELECT symbol, count(*) AS n FROM dl GROUP BY 1),
    e AS (SELECT ep.*, n, rep, {HEX("'37:' || rep || ':' || ep.symbol || ':' || ep.ep")} % greatest(n - dur, 1) AS s FROM ep JOIN sz USING (symbol), (SELECT unnest(range(1000)) AS rep)),
    dd AS (SELECT DISTINCT rep, symbol, unnest(generate_series(s, least(s + dur, n) - 1)) AS pos FROM e), k AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY rep, symbol ORDER BY pos) = 1 THEN 0 ELSE 1 END AS nw FROM dd)
    SELECT symbol, rep, -sum(lr) + sum(nw) * -0.0008 AS improvement FROM k JOIN dl USING (symbol, pos) GROUP BY 1, 2""", dbl="improvement", dp=7)
def stat_08(spark, sf):
    w = W.partitionBy("symbol").orderBy("d")
    s = q.off_state(spark, sf)
    ep = s.filter("off").withColumn("_g", F.col("d") - F.row_number().over(w)).groupBy("symbol", "_g").agg(F.min("d").alias("ep"), F.count(F.lit(1)).alias("dur")).drop("_g")
    d = v.panel_day(spark, sf).withColumn("lr", F.log(F.col("close") / F.lag("close").over(w))).filter("d > 0").select("symbol", (F.col("d") - 1).alias("pos"), "lr")
    return SM.random_windows(ep, d, 1000)


def auc_sql(src, keys="", score="score"):
    k, pk = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    sk = f"{keys}, {score}" if keys else score
    return f"SELECT {k}(sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS auc FROM (SELECT *, rank() OVER ({pk} ORDER BY {score}) + (count(*) OVER (PARTITION BY {sk}) - 1) / 2.0 AS rk FROM ({src}))" + (f" GROUP BY {keys}" if keys else "")


@query("stat_09_auc", auc_sql(SCR), dbl="auc")
def stat_09(spark, sf):
    return T.auc(v.scored(spark, sf))


AB = f"""WITH s AS (SELECT doc_id, score, label, CAST((doc_id * 7919) % 1009 AS DOUBLE) + score / 50 AS score2, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM ({SCR})), c AS (SELECT count(*) AS n FROM s),
    d AS (SELECT rep, s2.score, s2.score2, s2.label FROM (SELECT rep, {HEX("'19:' || rep || ':' || idx")} % n AS pick FROM s, c, (SELECT unnest(range(1000)) AS rep)) x JOIN s s2 ON s2.idx = x.pick)
    SELECT a.rep, a.auc AS auc_score, b.auc AS auc_score2, a.auc - b.auc AS delta FROM ({auc_sql('SELECT * FROM d', 'rep')}) a JOIN ({auc_sql('SELECT * FROM d', 'rep', 'score2')}) b USING (rep)"""


def _auc_reps(spark, sf):
    s = v.scored(spark, sf).withColumn("score2", ((F.col("doc_id") * 7919) % 1009).cast("double") + F.col("score") / 50).withColumn("blk", F.floor(F.col("doc_id") / 4096))
    return T.auc_bootstrap(s, ["score", "score2"], "label", "doc_id", "blk").withColumn("delta", F.col("auc_score") - F.col("auc_score2"))


@query("stat_10_auc_bootstrap", AB, dbl="auc_score auc_score2 delta", dp=7)
def stat_10(spark, sf):
    return _auc_reps(spark, sf)


@query("stat_10_auc_interval", f"SELECT quantile_cont(auc_score, 0.025) AS lo, quantile_cont(auc_score, 0.975) AS hi, quantile_cont(delta, 0.025) AS delta_lo, quantile_cont(delta, 0.975) AS delta_hi FROM ({AB})", dbl="lo hi delta_lo delta_hi", dp=7)
def stat_10b(spark, sf):
    p = lambda c, x: F.percentile(c, F.lit(x))
    return _auc_reps(spark, sf).agg(p("auc_score", 0.025).alias("lo"), p("auc_score", 0.975).alias("hi"), p("delta", 0.025).alias("delta_lo"), p("delta", 0.975).alias("delta_hi"))


MW = f"""SELECT symbol, u, (abs(u - n1 * n0 / 2) - 0.5) / nullif(sd, 0) AS z, (u - n1 * n0 / 2 - 0.5) / nullif(sd, 0) AS z_greater FROM (SELECT *, sqrt(n1 * n0 / 12 * ((n + 1) - t / (n * (n - 1)))) AS sd FROM (SELECT symbol, sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0 AS u, sum(label)::DOUBLE AS n1, (count(*) - sum(label))::DOUBLE AS n0, count(*)::DOUBLE AS n, sum(tie * tie - 1)::DOUBLE AS t FROM (
    SELECT *, rank() OVER (PARTITION BY symbol ORDER BY score) + (count(*) OVER (PARTITION BY symbol, score) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY symbol, score) AS tie FROM ({SCR})) GROUP BY symbol))"""


@query("stat_11_mann_whitney", MW, dbl="u z z_greater", dp=7)
def stat_11(spark, sf):
    return T.mann_whitney(v.scored(spark, sf), "score", "label", ["symbol"]).select("symbol", "u", "z", "z_greater")


@query("stat_12_bonferroni", f"SELECT symbol, tp, sl, least(p_value * (SELECT count(*) FROM ({COMBO})), 1) AS p_bonf FROM (SELECT symbol, tp, sl, 1 / (1 + exp(abs(train_bp) * 3)) AS p_value FROM ({COMBO}))", dbl="tp sl p_bonf", dp=7)
def stat_12(spark, sf):
    c = combos(spark, sf).select("symbol", "tp", "sl", (1 / (1 + F.exp(F.abs("train_bp") * 3))).alias("p_value"))
    return T.bonferroni(c).select("symbol", "tp", "sl", "p_bonf")


@query("stat_13_effect_size", f"""SELECT symbol, na, nb, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * (1 - 3 / (4.0 * (na + nb) - 9)) AS hedges_g, (ma - mb) / sqrt(va / na + vb / nb) AS welch_t FROM (SELECT symbol, count(*) FILTER (WHERE label = 1) AS na, count(*) FILTER (WHERE label = 0) AS nb,
    avg(score) FILTER (WHERE label = 1) AS ma, avg(score) FILTER (WHERE label = 0) AS mb, var_samp(score) FILTER (WHERE label = 1) AS va, var_samp(score) FILTER (WHERE label = 0) AS vb FROM ({SCR}) GROUP BY 1)""", dbl="hedges_g welch_t", dp=7)
def stat_13(spark, sf):
    return T.effect_size(v.scored(spark, sf), "score", "label", ["symbol"])


VERD = f"SELECT i.source_id, count(*) FILTER (WHERE score_1d = 'hit') AS hits, count(*) FILTER (WHERE score_1d IN ('hit', 'miss')) AS n FROM ({q.scores_sql('2024-01-22 12:00:00')}) s JOIN {{{{dated}}}} i USING (event_id) GROUP BY 1"


@query("stat_14_binomial_tail", f"SELECT source_id, hits, n, list_sum(list_transform(range(hits, n + 1), lambda k: exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) - n * ln(2.0)))) AS p_tail FROM ({VERD})", dbl="p_tail", dp=7)
def stat_14(spark, sf):
    s = q.scores_at(spark, sf, "2024-01-22 12:00:00").join(v.dated(spark, sf).select("event_id", "source_id"), "event_id")
    c = s.groupBy("source_id").agg(F.count(F.when(F.col("score_1d") == "hit", 1)).alias("hits"), F.count(F.when(F.col("score_1d").isin("hit", "miss"), 1)).alias("n"))
    return T.binomial_tail(c)


CH = lambda src, keys, lab: f"""SELECT {keys}sum(pow(p - np * m / n, 2) / (np * m / n) + pow(m - p - (n - np) * m / n, 2) / ((n - np) * m / n)) AS chi2 FROM (SELECT *, sum(m) OVER ({'PARTITION BY ' + keys.strip(', ') if keys else ''})::DOUBLE AS n, sum(p) OVER ({'PARTITION BY ' + keys.strip(', ') if keys else ''})::DOUBLE AS np FROM (
    SELECT {keys}symbol, count(*) AS m, sum({lab}) AS p FROM ({src}) GROUP BY ALL)){' GROUP BY ' + keys.strip(', ') if keys else ''}"""  # noqa: E731


@query("stat_15_chi_square", f"""WITH o AS ({CH(SCR, '', 'label')}), k AS (SELECT sum(label) AS k FROM ({SCR})), p AS ({CH(f"SELECT r.*, (rk <= k.k)::INT AS lab FROM ({rank_sql(SCR, 2000, 23, 'doc_id')}) r, k", 'rep, ', 'lab')})
    SELECT o.chi2, avg((p.chi2 >= o.chi2 - 1e-9)::INT) AS p_value FROM p, o GROUP BY 1""", dbl="chi2 p_value", dp=7)
def stat_15(spark, sf):
    return T.chi_square_permutation(v.scored(spark, sf), "symbol", "label", "doc_id")


@query("stat_15_two_by_two", f"""WITH o AS ({CH('SELECT toxic AS symbol, label FROM (' + SCR + ')', '', 'label')}), k AS (SELECT sum(label) AS k FROM ({SCR})), p AS ({CH(f"SELECT rep, toxic AS symbol, (rk <= k.k)::INT AS lab FROM ({rank_sql(SCR, 2000, 43, 'doc_id')}) r, k", 'rep, ', 'lab')})
    SELECT o.chi2, avg((p.chi2 >= o.chi2 - 1e-9)::INT) AS p_value FROM p, o GROUP BY 1""", dbl="chi2 p_value", dp=7)
def stat_15b(spark, sf):
    return T.chi_square_permutation(v.scored(spark, sf), "toxic", "label", "doc_id", seed=43)


EVS = f"""SELECT 'jump' AS cls, symbol, act FROM (SELECT DISTINCT symbol, act FROM ({q.JUMPS})) UNION ALL SELECT 'dense', symbol, act FROM (SELECT DISTINCT symbol, act FROM ({DENSE_EV}))"""
SEGS = "SELECT r.*, unnest(['full', CASE WHEN et_date < DATE '1999-01-01' THEN 'train' ELSE 'valid' END]) AS seg FROM (SELECT symbol, et_date, d, lead(close, w - 1) OVER (PARTITION BY w, symbol ORDER BY d) / open - 1 AS r, w FROM {{panel_day}}, (SELECT unnest([5, 20]) AS w)) r WHERE r IS NOT NULL"


@query("stat_16_event_study", f"""WITH s AS MATERIALIZED ({SEGS}), pl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY w, seg ORDER BY et_date, symbol) - 1 AS idx, count(*) OVER (PARTITION BY w, seg) AS n_pool, avg(r) OVER (PARTITION BY w, seg) AS base FROM s), e AS MATERIALIZED (SELECT cls, pl.* FROM ({EVS}) x JOIN pl ON pl.symbol = x.symbol AND pl.d = x.act),
    st AS (SELECT cls, w, seg, count(*) AS n, avg(r) AS m, quantile_cont(r, 0.5) AS md, stddev_samp(r) AS sd, any_value(base) AS base FROM e GROUP BY 1, 2, 3),
    bt AS (SELECT cls, w, seg, rep, avg(p.r) AS bm FROM (SELECT e.cls, e.w, e.seg, rep, {HEX("'47:' || rep || ':' || e.cls || ':' || e.symbol || ':' || e.d")} % n_pool AS pick FROM e, (SELECT unnest(range(1000)) AS rep)) k JOIN pl p USING (w, seg) WHERE p.idx = k.pick GROUP BY 1, 2, 3, 4)
    SELECT cls, w AS "window", seg, n, m * 1e4 AS mean_bp, md * 1e4 AS median_bp, sd * 1e4 AS std_bp, base * 1e4 AS base_bp, (m - base) / (sd / sqrt(n) + 1e-12) AS t_stat, (SELECT avg((bm >= m)::INT) FROM bt WHERE bt.cls = st.cls AND bt.w = st.w AND bt.seg = st.seg) AS p_boot FROM st WHERE n >= 2""", dbl="mean_bp median_bp std_bp base_bp t_stat p_boot", dp=4)
def stat_16(spark, sf):
    return event_study(spark, sf)


def event_study(spark, sf):
    from ..functions.hashing import draw_int

    w = W.partitionBy("symbol").orderBy("d")
    p = v.panel_day(spark, sf)
    r5 = p.withColumn("r5", F.lead("close", 4).over(w) / F.col("open") - 1).withColumn("r20", F.lead("close", 19).over(w) / F.col("open") - 1)
    r = r5.select("symbol", "et_date", "d", F.explode(F.array(F.struct(F.lit(5).alias("window"), F.col("r5").alias("r")), F.struct(F.lit(20).alias("window"), F.col("r20").alias("r")))).alias("x")).select("symbol", "et_date", "d", "x.*").filter("r IS NOT NULL")
    seg = F.when(F.col("et_date") < F.lit("1999-01-01").cast("date"), "train").otherwise("valid")
    s = r.withColumn("seg", F.explode(F.array(F.lit("full"), seg))).withColumn("yr", F.year("et_date"))
    s = pl = cut(spread.positions(s, ["window", "seg"], "yr", ["et_date", "symbol"], name="idx"), "pool")
    tot = s.groupBy("window", "seg").agg(F.count(F.lit(1)).alias("n_pool"), F.avg("r").alias("base"))
    ev = jump_events(spark, sf).select(F.lit("jump").alias("cls"), "symbol", F.col("act").alias("d")).distinct().unionByName(
        dense_events(spark, sf).select(F.lit("dense").alias("cls"), "symbol", F.col("act").alias("d")).distinct())
    e = cut(s.join(ev, ["symbol", "d"]).join(tot, ["window", "seg"]), "events")
    st = e.groupBy("cls", "window", "seg").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.max("base").alias("base"))
    md = spread.quantiles(e, ["cls", "window", "seg"], "r", md=0.5)
    d = T.reps(e.select("cls", "window", "seg", "symbol", "d", "n_pool"), 1000).withColumn("idx", draw_int(47, F.col("n_pool"), "rep", "cls", "symbol", "d"))
    bt = d.join(spread.small(pl.select("window", "seg", "idx", "r")), ["window", "seg", "idx"]).groupBy("cls", "window", "seg", "rep").agg(F.avg("r").alias("bm"))
    pb = bt.join(st.select("cls", "window", "seg", "m"), ["cls", "window", "seg"]).groupBy("cls", "window", "seg").agg(F.avg((F.col("bm") >= F.col("m")).cast("int")).alias("p_boot"))
    o = st.filter("n >= 2").join(md, ["cls", "window", "seg"]).join(pb, ["cls", "window", "seg"], "left")
    return o.select("cls", "window", "seg", "n", (F.col("m") * 1e4).alias("mean_bp"), (F.col("md") * 1e4).alias("median_bp"), (F.col("sd") * 1e4).alias("std_bp"), (F.col("base") * 1e4).alias("base_bp"),
                    ((F.col("m") - F.col("base")) / (F.col("sd") / F.sqrt("n") + 1e-12)).alias("t_stat"), "p_boot")


@query("stat_17_quantile_gate", f"""WITH tr AS (SELECT * FROM ({SCR}) WHERE toxic = 0), pl AS (SELECT quantile_cont(score, 0.9) AS p FROM tr) SELECT s.symbol, coalesce(n, 0) AS n_train, CASE WHEN coalesce(n, 0) < 50 THEN p ELSE t END AS thr, CASE WHEN coalesce(n, 0) < 50 THEN 'pool' ELSE 'own' END AS source
    FROM (SELECT DISTINCT symbol FROM ({SCR})) s LEFT JOIN (SELECT symbol, count(*) AS n, quantile_cont(score, 0.9) AS t FROM tr GROUP BY 1) USING (symbol), pl""", dbl="thr", dp=6)
def stat_17(spark, sf):
    s = v.scored(spark, sf)
    return T.quantile_gate(s.filter("toxic = 0"), s.select("symbol").distinct())


@query("stat_18_matched_gate", f"""WITH s AS (SELECT score, score / 3 + (doc_id * 7919) % 1009 AS ns FROM ({SCR})), g AS (SELECT gate, (SELECT avg((score >= gate)::INT) FROM s) AS retention FROM (SELECT unnest([300, 1000, 5000]::DOUBLE[]) AS gate)),
    o AS (SELECT list(ns ORDER BY ns) AS l, count(*) AS n FROM s) SELECT gate, retention, l[CAST(floor(h) AS BIGINT) + 1] + (l[CAST(ceil(h) AS BIGINT) + 1] - l[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h)) AS new_gate FROM (SELECT *, (1 - retention) * (n - 1) AS h FROM g, o)""", dbl="gate retention new_gate", dp=6)
def stat_18(spark, sf):
    s = v.scored(spark, sf)
    return T.matched_gate(s, s.select((F.col("score") / 3 + (F.col("doc_id") * 7919) % 1009).alias("score")), [300, 1000, 5000])


@query("stat_19_train_relative", f"SELECT doc_id, score / m AS score_rel FROM ({SCR}) LEFT JOIN (SELECT symbol, quantile_cont(score, 0.5) AS m FROM ({SCR}) WHERE toxic = 0 GROUP BY 1) USING (symbol)", dbl="score_rel", dp=7)
def stat_19(spark, sf):
    return T.train_relative(v.scored(spark, sf), "score", F.col("toxic") == 0).select("doc_id", "score_rel")


@query("stat_20_neighbours", f"""SELECT symbol, variant, tp, sl, horizon FROM (SELECT symbol, unnest([{', '.join("{'variant': '" + p + "x" + str(f) + "', 'tp': " + ('tp * ' + str(f) if p == 'tp' else 'tp') + ", 'sl': " + ('sl * ' + str(f) if p == 'sl' else 'sl') + ", 'horizon': " + ('8.0 + ' + ('1' if f > 1 else '-1') if p == 'horizon' else '8.0') + "}" for p in ('tp', 'sl', 'horizon') for f in (0.9, 1.1))}], recursive := true) FROM ({COMBO}))""", dbl="tp sl horizon")
def stat_20(spark, sf):
    c = combos(spark, sf).select("symbol", "tp", "sl", F.lit(8.0).alias("horizon"))
    return T.neighbours(c, ["tp", "sl", "horizon"], integers=("horizon",))


@query("stat_21_rank_correlation", "SELECT corr(ra, rb) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS ra, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS rb FROM orders)", dbl="rho")
def stat_21(spark, sf):
    return T.rank_correlation(table(spark, sf, "orders", "o_totalprice", "o_custkey"), "o_totalprice", "o_custkey")


@query("stat_22_rule_legs", f"""WITH c AS (SELECT symbol, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM ({SCR}) GROUP BY 1), t AS (SELECT *, p / sum(p) OVER () - q / sum(q) OVER () AS df FROM c)
    SELECT (SELECT arg_max(symbol, {{'d': df, 's': symbol}}) FROM t WHERE p > 0) AS category, (SELECT max(df) FROM t WHERE p > 0) AS share_diff, CASE WHEN avg(score) FILTER (WHERE label = 1) > avg(score) FILTER (WHERE label = 0) THEN '>=' ELSE '<=' END AS op, quantile_cont(score, 0.5) AS thr FROM ({SCR})""", dbl="share_diff thr", dp=7)
def stat_22(spark, sf):
    s = v.scored(spark, sf)
    leg = T.numeric_leg(s, "score", "label")
    return T.enriched_category(s, "symbol", "label").withColumn("_l", leg.select(F.struct(*leg.columns)).scalar()).select("category", "share_diff", "_l.*")


@query("stat_23_shifted_threshold", """WITH q AS (SELECT avg((l_extendedprice <= 30000)::INT) AS q0 FROM lineitem), o AS (SELECT list(l_extendedprice ORDER BY l_extendedprice) AS l, count(*) AS n FROM lineitem)
    SELECT shift, level, l[CAST(floor(h) AS BIGINT) + 1] + (l[CAST(ceil(h) AS BIGINT) + 1] - l[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h)) AS threshold FROM (SELECT *, level * (n - 1) AS h FROM (SELECT shift, least(greatest(q0 + shift, 0.01), 0.99) AS level FROM q, (SELECT unnest([-0.1, 0.0, 0.1, 0.7]::DOUBLE[]) AS shift)), o)""", dbl="shift level threshold", dp=5)
def stat_23(spark, sf):
    return T.shifted_threshold(table(spark, sf, "lineitem", "l_extendedprice"), "l_extendedprice", 30000, [-0.1, 0.0, 0.1, 0.7])
