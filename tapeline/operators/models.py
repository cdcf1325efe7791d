"""Feature datasets, folds and gradient-boosted models on Spark ML."""

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times as tm
from . import rolling as R
from . import settle as S
from . import spread
from .asof import asof_backward
from .bars import day_position
from .stats import auc

FEATURES = ["rv20", "vol_ratio", "bars_since_open", "open_to_now", "prev_day_ret", "drop_pct"]


def event_dataset(events, bars, daily, tp, sl, horizon):
    """One row per event (symbol, confirm_pos, drop_pct): features known at the confirm bar's close and the label of
    a long entry at the next bar, or the reason the event is dropped."""
    f = R.volume_ratio(R.realised_vol(bars))
    f = day_position(f).withColumn("open_to_now", F.col("close") / F.col("day_open") - 1)
    f = R.prev_day_return(f, daily).select("symbol", F.col("pos").alias("confirm_pos"), F.col("et_date").alias("confirm_date"), F.col("ts").alias("confirm_ts"), *FEATURES[:-1])
    lab = S.triple_barrier(S.forward_paths(bars, horizon, F.lit(True)), tp, sl, horizon)
    lab = lab.select("symbol", (F.col("pos") - 1).alias("confirm_pos"), F.col("et_date").alias("entry_date"), "label")
    j = events.join(f, ["symbol", "confirm_pos"]).join(lab, ["symbol", "confirm_pos"], "left")
    status = (
        F.when(F.col("entry_date").isNull(), "entry_beyond_data").when(F.col("entry_date") != F.col("confirm_date"), "entry_next_day")
        .when(F.col("label").isNull(), "label_unresolved").otherwise("ok")
    )
    return j.withColumn("status", status).withColumn("label", F.when(F.col("status") == "ok", F.col("label"))).drop("entry_date")


def drop_counts(dataset):
    return dataset.groupBy("symbol", "status").agg(F.count(F.lit(1)).alias("n"))


def intel_features(dataset, releases, posts, bar_minutes):
    """As-of features at the confirm bar's close: latest release change and its age, and posts so far on the ET day.
    Posts are NULL outside the fully covered days (strictly after the first, strictly before the last)."""
    d = dataset.withColumn("asof", tm.plus_seconds("confirm_ts", bar_minutes * 60))
    d = asof_backward(d, releases, "symbol", "asof", "published", ["change_pct", "published"], prefix="si_")
    d = d.withColumn("si_days_since", (tm.micros("asof") - tm.micros("si_published")) / 86_400_000_000).withColumnRenamed("si_change_pct", "si_chg_recent").drop("si_published")
    # posts of a day are numbered inside the day (minute by minute), so "so far today" is the number of the last one seen
    p = posts.withColumn("post_day", tm.et_date("post_ts")).withColumn("_h", F.date_trunc("minute", "post_ts"))
    p = spread.positions(p, "post_day", "_h", ["post_ts", "post_id"], name="so_far", start=1).withColumn("_k", F.lit(0))
    d = asof_backward(d.withColumn("_k", F.lit(0)), p, "_k", "asof", "post_ts", ["so_far", "post_day"], unit="minute").drop("_k")
    d = d.withColumn("_day", tm.et_date("asof"))
    cover = posts.agg(F.min(tm.et_date("post_ts")).alias("a"), F.max(tm.et_date("post_ts")).alias("z"))
    d = d.withColumn("_c", cover.select(F.struct("a", "z")).scalar())
    ok = (F.col("_day") > F.col("_c.a")) & (F.col("_day") < F.col("_c.z"))
    n = F.when(F.col("post_day") == F.col("_day"), F.col("so_far")).otherwise(0)
    return d.withColumn("daily_posts", F.when(ok, n)).drop("asof", "so_far", "post_day", "_day", "_c")


def gbt(features, trees=200, depth=3, step=0.05, seed=42):
    """Imputation by training medians, assembly, and boosted trees: 200 trees of depth 3 at rate 0.05 by default."""
    filled = [f"{f}_f" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="features"),
        GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=seed, cacheNodeIds=False),
    ])


def as_doubles(df, features):
    for f in features:
        df = df.withColumn(f, F.col(f).cast("double"))
    return df


def score(model, df):
    return model.transform(df).withColumn("prob", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_score(train, test, features, **kw):
    return score(gbt(features, **kw).fit(as_doubles(train, features)), as_doubles(test, features))


def day_blocks(rows, n_folds, day="et_date"):
    """Distinct days in n_folds + 1 contiguous blocks; block 0 only trains. One row per day (bounded by the calendar)."""
    d = rows.select(day).distinct()
    return d.withColumn("block", F.ntile(n_folds + 1).over(W.partitionBy(F.lit(0)).orderBy(day)) - 1)


def walk_forward(blocks, n_folds, embargo=1, day="et_date"):
    """(fold, day, role): a fold tests its own block and trains on the blocks before it less the last embargo days."""
    w = W.partitionBy("fold").orderBy(F.desc(day))
    b = blocks.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("block"), F.lit(1)), F.lit(n_folds))))
    test = b.filter("fold = block AND block > 0").select("fold", day, F.lit("test").alias("role"))
    tr = b.filter("block < fold").withColumn("_r", F.row_number().over(w))
    return test.unionByName(tr.select("fold", day, F.when(F.col("_r") <= embargo, "embargo").otherwise("train").alias("role")))


def side_by_side(fits, at_once=4):
    """Run independent fits at the same time (a small fit leaves most of a cluster idle); results in order."""
    with ThreadPool(at_once) as pool:
        return pool.map(lambda f: f(), fits, chunksize=1)


def leave_one_out(rows, key, keys, features, **kw):
    """Fit on all other keys, score the held-out one. One model per key, some fitted side by side."""
    one = lambda k: lambda: fit_score(rows.filter(F.col(key) != k), rows.filter(F.col(key) == k), features, **kw)
    scored = side_by_side([one(k) for k in keys])
    return reduce(lambda a, b: a.unionByName(b), scored)


def rolling_folds(rows, first, days, n_folds, day="et_date"):
    """Literal fold table (fold, start, end) of consecutive day ranges."""
    spark = rows.sparkSession
    f = spark.range(1, n_folds + 1).withColumnRenamed("id", "fold")
    start = F.date_add(F.lit(first).cast("date"), ((F.col("fold") - 1) * days).cast("int"))
    return f.select("fold", start.alias("start"), F.date_add(start, days - 1).alias("end"))


def parameter_walk(trades, params, train_days, test_days, min_trades, key="symbol"):
    """Walk-forward parameter choice. Days are numbered per key; a trade belongs to the training window of every fold
    that covers its day and to one test window. Each fold takes the best gated training return."""
    d = trades.select(key, "et_date").distinct()
    d = d.withColumn("o", F.row_number().over(W.partitionBy(key).orderBy("et_date")) - 1)
    last = d.groupBy(key).agg((F.max("o") + 1).alias("n"))
    t = trades.join(d, [key, "et_date"]).join(last, key)
    # fold k trains on [k*test, k*test + train) and tests on the test_days after it, if any day is left there
    n_folds = F.floor((F.col("n") - train_days - 1) / test_days) + 1
    lo = F.greatest(F.floor((F.col("o") - train_days) / test_days) + 1, F.lit(0))
    hi = F.least(F.floor(F.col("o") / test_days), n_folds - 1)
    tr = t.filter(lo <= hi).withColumn("fold", F.explode(F.sequence(lo, hi)))
    g = tr.groupBy(key, "fold", *params).agg(F.round(F.product(1 + F.col("ret")) - 1, 12).alias("train_return"), F.count(F.lit(1)).alias("train_trades"))
    from .select import gated_best

    best = gated_best(g, [key, "fold"], "train_trades", "train_return", min_trades, [F.col(p) for p in params])
    te = t.filter(F.col("o") >= train_days).withColumn("fold", F.floor((F.col("o") - train_days) / test_days))
    tg = te.groupBy(key, "fold", *params).agg((F.product(1 + F.col("ret")) - 1).alias("test_return"), F.count(F.lit(1)).alias("test_trades"))
    return best.join(tg, [key, "fold", *params], "left")


def save_and_load(model, path):
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def gate(scored, threshold):
    return scored.filter(F.col("prob") >= threshold)


def signature(rows, features, label="label"):
    """True against false per feature: counts, means, medians and the rank-sum z (one unpivot, grouped by feature)."""
    from .stats import mann_whitney

    k = len(features)
    u = rows.select(label, F.expr("stack({}, {}) AS (feature, x)".format(k, ", ".join(f"'{f}', double({f})" for f in features)))).filter("x IS NOT NULL")
    one, zero = F.when(F.col(label) == 1, F.col("x")), F.when(F.col(label) == 0, F.col("x"))
    a = u.groupBy("feature").agg(F.count(one).alias("n_true"), F.count(zero).alias("n_false"), F.avg(one).alias("mean_true"), F.avg(zero).alias("mean_false"))
    q = spread.quantiles(u, ["feature", label], "x", m=0.5)
    q = q.groupBy("feature").agg(F.max(F.when(F.col(label) == 1, F.col("m"))).alias("median_true"), F.max(F.when(F.col(label) == 0, F.col("m"))).alias("median_false"))
    return a.join(q, "feature").join(mann_whitney(u, "x", label, ["feature"]).select("feature", "z"), "feature")


def day_split(rows, frac=0.7, min_train=5, min_valid=3, key="symbol", day="et_date"):
    """Train / valid by the first share of distinct days per key; keys with too few days are left out."""
    d = rows.select(key, day).distinct().withColumn("_o", F.row_number().over(W.partitionBy(key).orderBy(day)) - 1)
    n = d.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, key).withColumn("_t", F.floor(F.col("_n") * frac)).filter((F.col("_t") >= min_train) & (F.col("_n") - F.col("_t") >= min_valid))
    return rows.join(d.select(key, day, F.when(F.col("_o") < F.col("_t"), "train").otherwise("valid").alias("part")), [key, day])


def fold_report(scored, keys):
    a = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_pos"), F.avg("prob").alias("mean_prob"))
    return a.join(auc(scored, keys, "prob"), keys, "left")


def report_checks(report):
    """What a report must hold whatever the model: exact counts, probabilities in range, an AUC where both classes are there."""
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    auc_ok = F.when(both, F.col("auc").between(0.0, 1.0)).otherwise(F.col("auc").isNull())
    return report.withColumn("prob_ok", F.col("mean_prob").between(0.0, 1.0)).withColumn("auc_ok", F.coalesce(auc_ok, F.lit(False))).drop("mean_prob", "auc")
