"""Event-store reports: counts, latency, scores, option snapshots, selection and near-duplicate titles."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import times as tm
from . import spread


def lag_seconds():
    return (tm.micros("observed_time") - tm.micros("event_time")) / 1_000_000


def source_counts(events):
    return events.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("observed_time").alias("last_observed"))


def latency(events):
    """min / mean / max lag and the upper median per source. The order statistic comes from tie-collapsed lag counts."""
    e = events.withColumn("lag_s", lag_seconds())
    a = e.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.min("lag_s").alias("lag_min"), F.avg("lag_s").alias("lag_avg"), F.max("lag_s").alias("lag_max"))
    return a.join(spread.order_stat(e, "source_id", "lag_s", lambda n: F.floor(n / 2), "lag_p50"), "source_id")


def steady_latency(events):
    """Latency without each source's first observed day; quantiles at the rounded index."""
    e = events.withColumn("lag_s", lag_seconds()).withColumn("_day", F.to_date("observed_time"))
    first = e.groupBy("source_id").agg(F.min("_day").alias("_first"), F.count(F.lit(1)).alias("_n"))
    s = e.join(first, "source_id").filter(F.col("_day") > F.col("_first"))
    cnt = s.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_steady"))
    at = lambda q: lambda n: F.least(n - 1, F.rint(q * (n - 1)))
    out = first.join(cnt, "source_id", "left").withColumn("n_steady", F.coalesce("n_steady", F.lit(0)))
    for name, q in (("p50", 0.5), ("p90", 0.9)):
        out = out.join(spread.order_stat(s, "source_id", "lag_s", at(q), name), "source_id", "left")
    return out.select("source_id", "n_steady", (F.col("_n") - F.col("n_steady")).alias("n_backfill"), "p50", "p90")


def tier_counts(events, now):
    t = F.lit(now).cast("timestamp_ntz")
    today = F.col("observed_time") >= tm.from_et(F.date_trunc("day", tm.to_et(t)).cast("timestamp_ntz"))
    week = F.col("observed_time") >= tm.plus_seconds(t, -7 * 86400)
    return events.filter(today | week).groupBy("tier").agg(F.count(F.when(today, 1)).alias("today"), F.count(F.when(week, 1)).alias("week"))


def recent_scores(scored, n=100):
    """Mean total score of each source's newest n events (the per-group limit runs before the shuffle)."""
    w = W.partitionBy("source_id").orderBy(F.desc("event_time"), F.desc("event_id"))
    top = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return top.groupBy("source_id").agg(F.avg("total").alias("avg_total"), F.count(F.lit(1)).alias("n"))


def atm_iv(chain, lo=15, hi=60, target=30, band=0.02, valid=(0.10, 3.0), min_quotes=3):
    """At-the-money implied volatility per snapshot: spot between the ITM and OTM call strikes, expiry nearest the
    target, mean of valid quotes in the band; too few quotes give no value. Group aggregates and joins on the day."""
    call = F.col("opt_right") == "C"
    spot = chain.groupBy("snapshot_date").agg(
        ((F.max(F.when(call & F.col("in_the_money"), F.col("strike"))) + F.min(F.when(call & ~F.col("in_the_money"), F.col("strike")))) / 2.0).alias("spot"))
    ex = chain.select("snapshot_date", "expiration").distinct().withColumn("dte", F.datediff("expiration", "snapshot_date"))
    near = F.col("dte").between(lo, hi)
    pick = F.struct(F.when(near, 0).otherwise(1), F.abs(F.col("dte") - target), "expiration")
    ex = ex.filter(near | (F.col("dte") >= 7)).groupBy("snapshot_date").agg(F.min_by("expiration", pick).alias("expiration"))
    q = chain.join(ex, ["snapshot_date", "expiration"]).join(spot.filter("spot IS NOT NULL"), "snapshot_date")
    q = q.filter((F.abs(F.col("strike") - F.col("spot")) <= F.col("spot") * band) & F.col("iv").between(*valid))
    return q.groupBy("snapshot_date").agg(F.avg("iv").alias("iv"), F.count(F.lit(1)).alias("n_quotes")).filter(F.col("n_quotes") >= min_quotes)


def iv_surprise(iv, n=5, k=2):
    """Each valid day against the mean of the n valid days before it (one row per day)."""
    w = W.partitionBy(F.lit(0)).orderBy("snapshot_date").rowsBetween(-n, -1)
    base = F.when(F.count("iv").over(w) >= k, F.avg("iv").over(w))
    return iv.withColumn("base", base).withColumn("surprise", sc.surprise_score(F.col("iv"), F.col("base")))


def option_summary(chain):
    s = lambda c, r: F.coalesce(F.sum(F.when(F.col("opt_right") == r, F.col(c))), F.lit(0))
    g = chain.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("n_contracts"), F.count_distinct("expiration").alias("n_expirations"),
        s("volume", "C").alias("call_volume"), s("volume", "P").alias("put_volume"), s("oi", "C").alias("call_oi"), s("oi", "P").alias("put_oi"))
    vol, oi = F.col("call_volume") + F.col("put_volume"), F.col("call_oi") + F.col("put_oi")
    return g.withColumn("pc_volume", F.when(F.col("call_volume") != 0, F.round(F.col("put_volume") / F.col("call_volume"), 3))).withColumn(
        "pc_oi", F.when(F.col("call_oi") != 0, F.round(F.col("put_oi") / F.col("call_oi"), 3))).withColumn("oi_quality", F.when(oi < 0.1 * vol, "suspect_zero").otherwise("ok"))


def verdict_counts(scores, field="score_1d"):
    return scores.groupBy("direction").pivot(field, ["hit", "miss", "pending"]).agg(F.count(F.lit(1))).na.fill(0)


def insider_clusters(buys, min_usd=1e6, days=30):
    """Big purchases, or two different owners within the trailing window. Owners are first reduced to one row per
    (symbol, day); 'more than one owner' then is a differing minimum and maximum over the window."""
    day = buys.groupBy("symbol", "et_date").agg(F.min("owner").alias("_lo"), F.max("owner").alias("_hi"))
    w = W.partitionBy("symbol").orderBy(F.unix_date("et_date")).rangeBetween(-days, 0)
    d = day.select("symbol", "et_date", (F.min("_lo").over(w) != F.max("_hi").over(w)).alias("multi"))
    j = buys.join(d, ["symbol", "et_date"])
    reason = F.when(F.col("value_usd") >= min_usd, "big").when(F.col("multi"), "multi")
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("multi")


def item_counts(reports, min_n=10):
    """Filings per item, for items with enough filings."""
    i = reports.select("accession", F.explode(F.array_distinct(F.filter(F.transform(F.split("items", ","), lambda s: F.trim(s)), lambda s: s != ""))).alias("item"))
    return i.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)


def feed_health(bars, run="run_id"):
    return bars.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_bars"), F.count_distinct("et_date").alias("n_days"), F.max("missing").alias("max_gap"),
        F.avg(F.when(F.col("lag_ms") > 0, F.col("lag_ms") / 1000)).alias("lag_mean_s"), (F.max(F.when(F.col("lag_ms") > 0, F.col("lag_ms"))) / 1000).alias("lag_max_s"))


def top_markets(markets, min_liquidity, n):
    """Open markets above the liquidity floor, most traded first."""
    ok = F.col("active") & ~F.col("closed") & (F.col("liquidity") >= min_liquidity)
    return markets.filter(ok).orderBy(F.desc("volume"), "market_id").limit(n)


def journal_summary(runs, orders, equity, now):
    """Run count, last run, orders in all and in 7 days, last equity time: three one-row aggregates side by side."""
    since = tm.plus_seconds(F.lit(now).cast("timestamp_ntz"), -7 * 86400)
    r = runs.agg(F.count(F.lit(1)).alias("n_runs"), F.max("started_at").alias("last_run"))
    o = orders.agg(F.count(F.lit(1)).alias("n_orders"), F.count(F.when(F.col("created_at") >= since, 1)).alias("n_orders_7d"))
    e = equity.agg(F.max("ts").alias("last_equity_ts"))
    return r.withColumn("_o", o.select(F.struct(*o.columns)).scalar()).withColumn("last_equity_ts", e.scalar()).select("n_runs", "last_run", "_o.*", "last_equity_ts")


def select_for_reading(events, low_prefixes, low_cap, high_cap):
    """Tier-capped selection. Low-tier rows are unique by title (newest kept) and capped; the rest are capped.
    The caps are the report's own limits; ``truncated`` counts what they left out."""
    low = F.lit(False)
    for p in low_prefixes:
        low = low | F.col("type").startswith(p)
    e = events.withColumn("low", low)
    o = F.struct("observed_time", "event_id")
    row = F.struct(*events.columns)
    lo = e.filter("low").groupBy("title_key").agg(F.max_by(row, o).alias("_r")).filter("title_key <> ''").select("_r.*").unionByName(e.filter("low AND title_key = ''").select(*events.columns))
    hi = e.filter("NOT low").select(*events.columns)
    newest = [F.desc("observed_time"), F.desc("event_id")]
    picked = hi.orderBy(*newest).limit(high_cap).unionByName(lo.orderBy(*newest).limit(low_cap))
    cut = lambda d, cap: d.agg(F.greatest(F.count(F.lit(1)) - cap, F.lit(0)).alias("c"))
    return picked, cut(hi, high_cap), cut(lo, low_cap)


def any_high_tier(events, last_ok):
    """True when a T0, T1 or derived event was observed after the last success."""
    hi = F.col("tier").isin("T0", "T1") | (F.col("source_id") == "detector")
    return events.agg(F.coalesce(F.max(F.when(hi, F.col("observed_time"))) > F.lit(last_ok).cast("timestamp_ntz"), F.lit(False)).alias("has_new_high"))
