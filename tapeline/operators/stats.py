"""Statistics as row-parallel queries. Randomness is the order of md5 digests, so every draw is reproducible.

Repetitions become a column: (rep, row) pairs are made by exploding a literal range per row and reduced to sums per digest prefix where they
are made; ``spread.drawn`` puts only the one prefix in order that a draw's size cuts.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import draw_int, draws
from ..session import cut
from . import spread
from .joins import attach


def reps(df, n, name="rep"):
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def auc(rows, keys=(), score="score", label="label"):
    """Rank-based AUC with average ranks for ties, per key."""
    keys = list(keys)
    c = rows.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_c"), F.sum(label).alias("_p"))
    r = spread.value_ranks(c, keys, score, weight="_c").drop("n_all")
    j = r.join(c, keys + [score])
    rank = F.col("n_less") + (F.col("n_eq") + 1) / 2.0
    a = j.groupBy(*keys).agg(F.sum(rank * F.col("_p")).alias("_r"), F.sum("_p").alias("_np"), F.sum("_c").alias("_n"))
    u = F.col("_r") - F.col("_np") * (F.col("_np") + 1) / 2.0
    return a.select(*keys, F.try_divide(u, F.col("_np") * (F.col("_n") - F.col("_np"))).alias("auc"))


def _permuted(rows, seed, n, row_id, k, strata=(), **how):
    """Sums over the k rows that each repetition draws (per stratum, with a k of its own). Of a repetition's rows only those near the k-th are told
    apart, so few sums leave a task and every digest is made once."""
    r = draws(spread.dealt(spread.cuts(rows, strata, k), n), n, seed, row_id)
    return spread.drawn(r, ["rep", *strata], "_h", k, near=("_lo", "_hi"), **how)


def permutation_test(rows, x, label, row_id, n=2000, seed=7):
    """Two-group permutation test on |mean difference|: p = share of permutations at least as large."""
    obs = rows.agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("k"), F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"),
        F.abs(F.avg(F.when(F.col(label) == 1, F.col(x))) - F.avg(F.when(F.col(label) == 0, F.col(x)))).alias("obs"))
    own = attach(rows.select(row_id, x), obs, "_o").withColumn("_size", F.col("_o.k")).drop("_o")
    g = attach(_permuted(own, seed, n, row_id, "_size", _s=x), obs, "_o")
    diff = F.abs(F.col("_s") / F.col("_o.k") - (F.col("_o.sx") - F.col("_s")) / (F.col("_o.n") - F.col("_o.k")))
    return g.withColumn("diff", diff).groupBy(F.col("_o.obs").alias("obs"), F.col("_o.n").alias("n"), F.col("_o.k").alias("n_pos")).agg(
        F.avg((F.col("diff") >= F.col("_o.obs") - 1e-12).cast("int")).alias("p_value"))


def stratified_permutation(rows, x, label, row_id, stratum, n=2000, seed=11):
    """Labels shuffled inside each stratum; one-sided (difference <= observed) and two-sided shares."""
    w = rows.groupBy(stratum).agg(F.sum(label).alias("_k"))
    obs = rows.agg(
        F.sum(label).alias("k"), F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"),
        (F.avg(F.when(F.col(label) == 1, F.col(x))) - F.avg(F.when(F.col(label) == 0, F.col(x)))).alias("obs"))
    own = rows.select(row_id, x, stratum).join(w.withColumnRenamed("_k", "_size"), stratum)
    g = _permuted(own, seed, n, row_id, "_size", [stratum], _s=x).groupBy("rep").agg(F.sum("_s").alias("_s"))
    g = attach(g, obs, "_o")
    diff = F.col("_s") / F.col("_o.k") - (F.col("_o.sx") - F.col("_s")) / (F.col("_o.n") - F.col("_o.k"))
    return g.withColumn("diff", diff).groupBy(F.col("_o.obs").alias("obs")).agg(
        F.avg((F.col("diff") <= F.col("_o.obs") + 1e-12).cast("int")).alias("p_one"),
        F.avg((F.abs("diff") >= F.abs(F.col("_o.obs")) - 1e-12).cast("int")).alias("p_two"))


def stratified_draw(rows, x, row_id, stratum, sizes, n=1000, seed=13):
    """k rows per stratum without replacement, n times: the mean of each draw. ``sizes`` holds (stratum, k)."""
    own = rows.select(row_id, x, stratum).join(sizes, stratum)
    p = _permuted(own, seed, n, row_id, "k", [stratum], _s=x, _n_x=F.col(x).isNotNull().cast("bigint"), _rows=F.lit(1).cast("bigint"))
    g = p.groupBy("rep").agg(F.sum("_s").alias("_s"), F.sum("_n_x").alias("_n_x"), F.sum("_rows").alias("n"))
    return g.select("rep", F.try_divide("_s", "_n_x").alias("mean_x"), "n")


def indexed(rows, order, block, name="idx"):
    """Dense 0-based index over all rows, from per-block counts (no single-task window)."""
    return spread.positions(rows.withColumn("_all", F.lit(0)), "_all", block, order, name=name).drop("_all")


def bootstrap_means(rows, x, row_id, block, n=2000, seed=17, block_len=1, pool=None):
    """Resampled means with replacement: one draw per (rep, row), whole blocks when block_len > 1 (circular)."""
    s = indexed(rows.select(row_id, x, block), row_id, block).select("idx", x)
    size = s.agg(F.count(F.lit(1)).alias("n"))
    d = attach(reps(s.select("idx"), n), size, "_n")
    start = draw_int(seed, F.col("_n.n"), "rep", F.floor(F.col("idx") / block_len).cast("bigint"))
    d = d.withColumn("pick", F.pmod(start + F.col("idx") % block_len, F.col("_n.n")))
    # the same pick drawn often is counted once with its multiplicity before the join
    d = d.groupBy("rep", "pick").agg(F.count(F.lit(1)).alias("_m"))
    j = d.join(s.withColumnRenamed("idx", "pick"), "pick")
    return j.groupBy("rep").agg((F.sum(F.col(x) * F.col("_m")) / F.sum("_m")).alias("mean_x"))


def bootstrap_summary(means):
    """One-sided p that the mean is not above zero, (k+1)/(N+1), and a 95% interval over the repetitions."""
    return means.agg(
        ((F.sum((F.col("mean_x") <= 0).cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
        F.percentile("mean_x", F.lit(0.025)).alias("lo"), F.percentile("mean_x", F.lit(0.975)).alias("hi"))


#: Rows of a block of scores, whose draws are counted together; a score that so many rows share is a block of its own.
BLOCK = 1024


def _packed(batches, scores):
    """(score, block, label, codes, counts): draws of up to 2^20 rows sorted and packed. A code is rep * BLOCK + place of the score in its block; codes are
    differences, low bytes first, and a block of one score has counts, so a crowd doesn't grow with its draws."""

    def settled(rep, label, places):
        kinds, at = np.unique(label, return_inverse=True)
        for i in range(scores):
            block, place = places[2 * i], places[2 * i + 1]
            key = (((block * len(kinds) + at) << 32) | (rep * BLOCK + place))[block >= 0]
            key.sort()
            head = key >> 32
            for own in np.split(key, np.flatnonzero(np.diff(head)) + 1) if len(key) else []:
                block_at, kind = divmod(int(own[0] >> 32), len(kinds))
                codes, counts = own & 0xFFFFFFFF, None
                if block_at % 2:
                    codes, counts = np.unique(codes, return_counts=True)
                    counts = counts.astype(np.uint32).tobytes()
                steps = np.diff(codes, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
                yield i, block_at, float(kinds[kind]), steps.tobytes(), counts

    def frames(waiting):
        columns = [np.concatenate(c).astype(np.float64 if k == 1 else np.int64) for k, c in enumerate(zip(*waiting))]
        return pd.DataFrame(settled(columns[0], columns[1], columns[2:]), columns=["score", "block", "label", "codes", "counts"])

    waiting, size = [], 0
    for b in batches:
        waiting.append([b[c].to_numpy() for c in b.columns])
        size += len(b)
        if size >= 1 << 20:
            yield frames(waiting)
            waiting, size = [], 0
    if size:
        yield frames(waiting)


def _block_ranks(key, packed):
    """(score, block, rep, c, p, r): draws in a block of scores, their labels, and the sum of label times average rank inside the block."""
    codes, counts, labels = [], [], []
    for label, steps, many in zip(packed["label"], packed["codes"], packed["counts"]):
        own = np.cumsum(np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)
        codes.append(own)
        counts.append(np.ones(len(own)) if many is None else np.frombuffer(many, np.uint32).astype(np.float64))
        labels.append(np.full(len(own), label))
    codes, counts, labels = map(np.concatenate, (codes, counts, labels))
    out, step = [], 256  # repetitions at once
    for lo in range(0, int(codes.max()) // BLOCK + 1, step):
        here = (codes >= lo * BLOCK) & (codes < (lo + step) * BLOCK)
        at = codes[here] - lo * BLOCK
        c = np.bincount(at, counts[here], minlength=step * BLOCK).reshape(step, BLOCK)
        p = np.bincount(at, counts[here] * labels[here], minlength=step * BLOCK).reshape(step, BLOCK)
        rank = np.cumsum(c, axis=1) - c + (c + 1) / 2
        found = np.flatnonzero(c.any(axis=1))
        out.append(pd.DataFrame({"rep": found + lo, "c": c.sum(1)[found], "p": p.sum(1)[found], "r": (rank * p).sum(1)[found]}))
    out = pd.concat(out)
    out.insert(0, "block", int(key[1]))
    out.insert(0, "score", int(key[0]))
    return out


def auc_bootstrap(rows, scores, label, row_id, block, n=1000, seed=19):
    """AUC of each score column on shared resamples.

    Rows are ranked once, over the table. Rows of neighbouring ranks make a block (equal scores never part), and a draw is but a repetition and its
    row's place in its block, packed to a few bytes: draws move once per score, to their block, which gives each repetition the sum of ranks inside
    it. What lies below comes from running counts over the blocks.
    """
    s = cut(indexed(rows.select(row_id, label, block, *scores), row_id, block), "indexed")
    size = s.agg(F.count(F.lit(1)).alias("n"))
    places = s.select(F.col("idx").alias("pick"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("_l"), *scores)
    for i, c in enumerate(scores):
        at = (F.floor(F.col("n_less") / BLOCK) * 2 + (F.col("n_eq") >= BLOCK).cast("int")).cast("int")
        r = spread.value_ranks(s, [], c).select(F.col(c).alias("_v"), at.alias(f"_b{i}"), (F.col("n_less") % BLOCK).cast("int").alias(f"_i{i}"))
        r = r.withColumn(f"_i{i}", F.when(F.col(f"_b{i}") % 2 == 1, 0).otherwise(F.col(f"_i{i}")))
        places = places.join(r, F.col(c) == F.col("_v"), "left").drop("_v").withColumn(f"_b{i}", F.coalesce(f"_b{i}", F.lit(-1))).withColumn(f"_i{i}", F.coalesce(f"_i{i}", F.lit(0)))
    places = cut(places.drop(*scores), "places")
    d = attach(reps(spread.dealt(s.select("idx"), n), n), size, "_n")
    d = d.select("rep", draw_int(seed, F.col("_n.n"), "rep", "idx").alias("pick")).join(spread.small(places), "pick")
    d = d.select("rep", "_l", *[f"_{x}{i}" for i in range(len(scores)) for x in "bi"])
    few = len(scores)
    packed = d.mapInPandas(lambda batches: _packed(batches, few), "score int, block int, label double, codes binary, counts binary")
    ranks = packed.groupBy("score", "block").applyInPandas(_block_ranks, "score int, block int, rep int, c double, p double, r double")
    spark, conf = s.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(1 << 15))  # narrow rows; the text operators set small batches for long ones
    try:
        ranks = cut(ranks, "ranks")
    finally:
        spark.conf.set(conf, before)
    below = F.coalesce(F.sum("c").over(W.partitionBy("rep").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    out = None
    for i, c in enumerate(scores):
        a = ranks.filter(F.col("score") == i).withColumn("_r", below * F.col("p") + F.col("r")).groupBy("rep").agg(F.sum("_r").alias("_r"), F.sum("p").alias("_np"), F.sum("c").alias("_t"))
        a = a.select("rep", F.try_divide(F.col("_r") - F.col("_np") * (F.col("_np") + 1) / 2.0, F.col("_np") * (F.col("_t") - F.col("_np"))).alias(f"auc_{c}"))
        out = a if out is None else out.join(a, "rep")
    return out


def mann_whitney(rows, x, label, keys=()):
    """U of label 1 against label 0 with average ranks; normal approximation with tie and continuity correction."""
    keys = list(keys)
    c = rows.filter(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_c"), F.sum(label).alias("_p"))
    r = spread.value_ranks(c, keys, x, weight="_c").drop("n_all").join(c, keys + [x])
    rank = F.col("n_less") + (F.col("n_eq") + 1) / 2.0
    t = F.col("n_eq").cast("double")
    a = r.groupBy(*keys).agg(F.sum(rank * F.col("_p")).alias("_r"), F.sum("_p").cast("double").alias("n1"), F.sum("_c").cast("double").alias("_n"), F.sum(t * t * t - t).alias("_t"))
    n1, n = F.col("n1"), F.col("_n")
    n0 = n - n1
    u = F.col("_r") - n1 * (n1 + 1) / 2
    mu = n1 * n0 / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("_t") / (n * (n - 1))))
    return a.select(*keys, u.alias("u"), F.try_divide(F.abs(u - mu) - 0.5, sd).alias("z"), F.try_divide(u - mu - 0.5, sd).alias("z_greater"))


def bonferroni(rows, p="p_value"):
    """p times the number of tests, capped at 1."""
    n = rows.agg(F.count(p).alias("n"))
    return rows.withColumn("p_bonf", F.least(F.col(p) * n.scalar(), F.lit(1.0)))


def effect_size(rows, x, label, keys=()):
    """Hedges g and Welch t from group moments."""
    a, b = F.when(F.col(label) == 1, F.col(x)), F.when(F.col(label) == 0, F.col(x))
    m = rows.groupBy(*keys).agg(
        F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    na, nb = F.col("na"), F.col("nb")
    sp = F.sqrt(((na - 1) * F.col("va") + (nb - 1) * F.col("vb")) / (na + nb - 2))
    g = F.try_divide(F.col("ma") - F.col("mb"), sp) * (1 - 3 / (4 * (na + nb) - 9))
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(F.col("va") / na + F.col("vb") / nb))
    return m.select(*keys, "na", "nb", g.alias("hedges_g"), t.alias("welch_t"))


def binomial_tail(counts, hits="hits", n="n", chunk=4096):
    """P(X >= hits | n, 1/2): log binomial terms from a running sum of logs, spread over chunks of the support.

    Each (key, j) term is one row; a key's support is dealt in chunks, so no row holds more than ``chunk`` of it.
    """
    keys = [c for c in counts.columns if c not in (hits, n)]
    t = counts.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col(n), F.lit(1)) / chunk))))
    t = t.withColumn("j", F.explode(F.sequence(F.greatest(F.col("_b") * chunk, F.lit(1)), F.least(F.col("_b") * chunk + chunk - 1, F.greatest(F.col(n), F.lit(1))))))
    # log C(n, j) = sum_{i<=j} log((n - i + 1) / i)
    t = t.withColumn("_l", F.when(F.col("j") <= F.col(n), F.log((F.col(n) - F.col("j") + 1) / F.col("j"))))
    t = spread.running(t, keys + [n, hits], "_b", "j", _c=("sum", "_l"))
    term = F.when((F.col("j") >= F.col(hits)) & (F.col("j") <= F.col(n)), F.exp(F.col("_c") - F.col(n) * F.log(F.lit(2.0)))).otherwise(0.0)
    zero = F.when(F.col(hits) <= 0, F.pow(F.lit(0.5), F.col(n))).otherwise(0.0)
    return t.groupBy(*keys, hits, n).agg((F.sum(term)).alias("_s")).select(*keys, hits, n, (F.col("_s") + zero).alias("p_tail"))


def chi_square(rows, category, label, keys=()):
    """Chi-square of category x label from counts."""
    return _chi_square(rows.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_m"), F.sum(label).alias("_p")), list(keys))


def _chi_square(c, keys):
    """From counts per category: ``_m`` rows, ``_p`` of them labelled."""
    t = c.groupBy(*keys).agg(F.sum("_m").alias("_n"), F.sum("_p").alias("_np"))
    j = c.join(t, keys) if keys else attach(c, t, "_t").select(*c.columns, "_t.*")
    e1, e0 = F.col("_np") * F.col("_m") / F.col("_n"), (F.col("_n") - F.col("_np")) * F.col("_m") / F.col("_n")
    term = F.coalesce(F.try_divide((F.col("_p") - e1) * (F.col("_p") - e1), e1), F.lit(0.0)) + F.coalesce(
        F.try_divide((F.col("_m") - F.col("_p") - e0) * (F.col("_m") - F.col("_p") - e0), e0), F.lit(0.0))
    return j.groupBy(*keys).agg(F.sum(term).alias("chi2"))


def chi_square_permutation(rows, category, label, row_id, n=2000, seed=23):
    """Permutation p of the chi-square statistic (k/N); serves 2x2 tables in place of Fisher's test as well."""
    k = rows.agg(F.sum(label).alias("k"))
    own = attach(rows.select(row_id, category), k, "_k").withColumn("_size", F.col("_k.k")).drop("_k")
    hit = _permuted(own, seed, n, row_id, "_size", by=[category], _p=F.lit(1).cast("bigint"))
    every = reps(rows.groupBy(category).agg(F.count(F.lit(1)).alias("_m")), n)  # categories that a repetition leaves out count 0
    at = hit.select(F.col("rep").alias("_r"), F.col(category).alias("_cat"), "_p")
    c = every.join(at, (F.col("rep") == F.col("_r")) & F.col(category).eqNullSafe(F.col("_cat")), "left").select("rep", category, "_m", F.coalesce("_p", F.lit(0)).alias("_p"))
    sim = attach(_chi_square(c, ["rep"]), chi_square(rows, category, label).withColumnRenamed("chi2", "obs"), "_o")
    return sim.groupBy(F.col("_o.obs").alias("chi2")).agg(F.avg((F.col("chi2") >= F.col("_o.obs") - 1e-9).cast("int")).alias("p_value"))


def quantile_gate(train, all_symbols, keep=0.10, min_rows=50):
    """Per-symbol score threshold keeping the top share of training rows; symbols with few rows use the pooled one."""
    own = spread.quantiles(train, "symbol", "score", thr=1 - keep)
    n = train.groupBy("symbol").agg(F.count("score").alias("n_train"))
    pooled = spread.quantiles(train, [], "score", thr=1 - keep)
    t = all_symbols.join(n, "symbol", "left").join(own, "symbol", "left").withColumn("_pool", pooled.scalar())
    few = F.coalesce("n_train", F.lit(0)) < min_rows
    return t.select("symbol", F.coalesce("n_train", F.lit(0)).alias("n_train"), F.when(few, F.col("_pool")).otherwise(F.col("thr")).alias("thr"), F.when(few, "pool").otherwise("own").alias("source"))


def matched_gate(old, new, gates):
    """Gate on a new score with the retention the old score had at each gate. The quantile level differs per gate,
    so it is read off the tie-collapsed value counts of the new score."""
    ret = old.agg(*[F.avg((F.col("score") >= g).cast("int")).alias(f"g{i}") for i, g in enumerate(gates)])
    lv = ret.select(F.explode(F.array(*[F.struct(F.lit(float(g)).alias("gate"), F.col(f"g{i}").alias("retention")) for i, g in enumerate(gates)])).alias("x")).select("x.*")
    r = spread.value_ranks(new, [], "score")
    # every value row meets each of the few gates
    r = r.withColumn("_g", lv.agg(F.array_sort(F.collect_list(F.struct("gate", "retention")))).scalar()).withColumn("_g", F.explode("_g"))
    h = (1 - F.col("_g.retention")) * (F.col("n_all") - 1)
    inside = lambda k: (F.col("n_less") <= k) & (k < F.col("n_less") + F.col("n_eq"))
    a = r.groupBy("_g.gate", "_g.retention").agg(
        F.max(F.when(inside(F.floor(h)), F.col("score"))).alias("_a"), F.max(F.when(inside(F.ceil(h)), F.col("score"))).alias("_b"), F.max(h - F.floor(h)).alias("_w"))
    return a.select("gate", "retention", F.when(F.col("retention") > 0, F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("new_gate"))


def train_relative(rows, x, is_train, key="symbol"):
    """Value over the key's training median only."""
    med = spread.quantiles(rows.filter(is_train), key, x, _med=0.5)
    return rows.join(med, key, "left").withColumn(f"{x}_rel", F.try_divide(F.col(x), F.col("_med"))).drop("_med")


def neighbours(params, names, factors=(0.9, 1.1), integers=()):
    """Variants with one parameter moved by +-10% (integers by at least 1)."""
    out = []
    for p in names:
        for f in factors:
            moved = F.col(p) * f
            if p in integers:
                step = F.greatest(F.lit(1.0), F.round(F.abs(F.col(p)) * 0.1))
                moved = F.col(p) + (step if f > 1 else -step)
            out.append(F.struct(F.lit(f"{p}x{f}").alias("variant"), *[(moved if c == p else F.col(c)).cast("double").alias(c) for c in names]))
    rest = [c for c in params.columns if c not in names]
    return params.withColumn("_v", F.explode(F.array(*out))).select(*rest, "_v.*")


def rank_correlation(rows, a, b):
    """Spearman rho: correlation of average ranks."""
    ra = spread.avg_ranks(rows, [], a).select(a, F.col("rank").alias("_ra"))
    rb = spread.avg_ranks(rows, [], b).select(b, F.col("rank").alias("_rb"))
    return rows.join(ra, a).join(rb, b).agg(F.corr("_ra", "_rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def enriched_category(rows, category, label):
    """The category whose share among label 1 exceeds its share among label 0 the most."""
    c = rows.groupBy(category).agg(F.sum(label).alias("_p"), (F.count(F.lit(1)) - F.sum(label)).alias("_q"))
    t = c.agg(F.sum("_p").alias("p"), F.sum("_q").alias("q"))
    s = attach(c.filter("_p > 0"), t, "_t").withColumn("share_diff", F.col("_p") / F.col("_t.p") - F.col("_q") / F.col("_t.q"))
    return s.agg(F.max_by(category, F.struct("share_diff", category)).alias("category"), F.max("share_diff").alias("share_diff"))


def numeric_leg(rows, x, label):
    """Threshold leg: the pooled median, with the side of the higher mean."""
    side = rows.agg(F.avg(F.when(F.col(label) == 1, F.col(x))).alias("m1"), F.avg(F.when(F.col(label) == 0, F.col(x))).alias("m0"))
    q = spread.quantiles(rows, [], x, thr=0.5)
    return side.withColumn("thr", q.scalar()).select(F.when(F.col("m1") > F.col("m0"), ">=").otherwise("<=").alias("op"), "thr")


def shifted_threshold(rows, x, value, shifts):
    """Map a threshold to its empirical share, move it by some points, and map it back (clipped to 1..99%)."""
    q0 = rows.agg(F.avg((F.col(x) <= value).cast("int")).alias("q0"))
    r = spread.value_ranks(rows, [], x)
    r = attach(r, q0, "_q").withColumn("shift", F.explode(F.array(*[F.lit(float(s)) for s in shifts])))
    lvl = F.least(F.greatest(F.col("_q.q0") + F.col("shift"), F.lit(0.01)), F.lit(0.99))
    h = lvl * (F.col("n_all") - 1)
    inside = lambda k: (F.col("n_less") <= k) & (k < F.col("n_less") + F.col("n_eq"))
    a = r.groupBy("shift").agg(
        F.max(lvl).alias("level"), F.max(F.when(inside(F.floor(h)), F.col(x))).alias("_a"), F.max(F.when(inside(F.ceil(h)), F.col(x))).alias("_b"), F.max(h - F.floor(h)).alias("_w"))
    return a.select("shift", "level", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("threshold"))
