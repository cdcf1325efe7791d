"""Bar and event readers, their guards, and table sinks."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times as tm

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("Datetime", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close", "Volume")]
)


def parse_time(text):
    """Mixed ISO text (with zone, with Z, or naive UTC) to a UTC instant; NULL when it does not parse."""
    return F.try_to_timestamp(F.trim(text)).cast("timestamp_ntz")


def load_bars(spark, path, min_rth_share=0.5):
    """CSV bars with an explicit schema. Fails on a missing close, and when too few bars fall into ET 09-16h
    (a file stamped in local time). The guard is one aggregate; the rows are not collected."""
    raw = spark.read.schema(BAR_SCHEMA).option("header", True).csv(path)
    bars = raw.select(
        "symbol", parse_time(F.col("Datetime")).alias("ts"), F.col("Open").alias("open"), F.col("High").alias("high"),
        F.col("Low").alias("low"), F.col("Close").alias("close"), F.col("Volume").alias("volume"),
    )
    h = F.hour(tm.to_et("ts"))
    guard = bars.agg(
        F.sum(F.col("close").isNull().cast("int")).alias("no_close"),
        F.sum(F.col("ts").isNull().cast("int")).alias("no_time"),
        F.avg(((h >= 9) & (h < 16)).cast("int")).alias("rth"),
    ).first()
    if guard["no_close"] or guard["no_time"]:
        raise ValueError(f"{guard['no_close']} bars without close, {guard['no_time']} without time in {path}")
    if guard["rth"] is not None and guard["rth"] < min_rth_share:
        raise ValueError(f"only {guard['rth']:.0%} of bars fall into ET 09-16h: {path} looks stamped in local time")
    return bars.withColumn("et_date", tm.et_date("ts"))


def parse_events(raw, time_col="event_time_utc"):
    """Legacy event rows: mixed ISO text to UTC; unparseable times are dropped."""
    return raw.withColumn("event_time", parse_time(F.col(time_col))).filter(F.col("event_time").isNotNull())


def read_events_csv(spark, path):
    schema = "event_time_utc string, source string, type string, payload string"
    return parse_events(spark.read.schema(schema).option("header", True).option("escape", '"').csv(path))


def expand_payload(events, schema, col="payload"):
    """JSON text to typed columns."""
    return events.withColumn("_p", F.from_json(col, schema)).select(*events.columns, "_p.*").drop(col)


def load_posts(raw, sender, kinds, since):
    """Post archive: one sender (trimmed, any case), known message kinds renamed, unparseable or old rows dropped."""
    m = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    t = parse_time(F.col("created"))
    return (
        raw.filter(F.lower(F.trim("sender")) == sender)
        .filter(F.col("kind").isin(list(kinds)))
        .withColumn("event_time", t)
        .filter(F.col("event_time") >= F.lit(since).cast("timestamp_ntz"))
        .withColumn("type", F.concat(F.lit("post_"), F.try_element_at(m, F.col("kind"))))
    )


def macro_series(raw, freq="monthly"):
    """Macro observations with the time they became knowable: +1 month or +1 day, at 12:00 UTC."""
    nxt = F.add_months("obs_date", 1) if freq == "monthly" else F.date_add("obs_date", 1)
    return (
        raw.withColumn("value", F.col("text").try_cast("double"))
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("available_from", tm.plus_seconds(nxt.cast("timestamp_ntz"), 12 * 3600))
        .drop("text")
    )


def stitch(first, second):
    """Union of two bar segments; the first wins on a shared timestamp."""
    both = first.withColumn("_pri", F.lit(0)).unionByName(second.withColumn("_pri", F.lit(1)))
    vals = [c for c in first.columns if c not in ("symbol", "ts")]
    # a partial aggregate, so no window and no hot key
    return both.groupBy("symbol", "ts").agg(F.min_by(F.struct(*vals), "_pri").alias("_v")).select("symbol", "ts", "_v.*")


def seam_difference(first, second):
    """Largest relative close difference on shared timestamps, per symbol."""
    j = first.select("symbol", "ts", F.col("close").alias("a")).join(second.select("symbol", "ts", F.col("close").alias("b")), ["symbol", "ts"])
    return j.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_overlap"), F.max(F.abs(F.col("b") / F.col("a") - 1)).alias("max_diff"))


def append_checked(old, new, now, overlap_tol=0.01, gap_tol=0.25):
    """Incremental append. Per symbol: the bar at the old tail must agree, the first newer open may not jump beyond
    ``gap_tol``, and the day still running at ``now`` is left out. Returns (rows to append, one verdict row per symbol).
    """
    tail = old.groupBy("symbol").agg(F.max("ts").alias("tail_ts"), F.max_by("close", "ts").alias("tail_close"))
    j = new.join(tail, "symbol")
    newer = F.col("ts") > F.col("tail_ts")
    verdict = j.groupBy("symbol").agg(
        F.max(F.when(F.col("ts") == F.col("tail_ts"), F.abs(F.col("close") / F.col("tail_close") - 1))).alias("overlap_diff"),
        F.min_by(F.when(newer, F.abs(F.col("open") / F.col("tail_close") - 1)), F.when(newer, F.col("ts"))).alias("gap"),
    ).withColumn(
        "verdict",
        F.when(F.col("overlap_diff") > overlap_tol, "overlap_break").when(F.col("gap") > gap_tol, "gap_break").otherwise("ok"),
    )
    today = tm.et_date(F.lit(now).cast("timestamp_ntz"))
    rows = (
        j.filter(newer & (F.col("et_date") < today))
        .join(verdict.filter("verdict = 'ok'").select("symbol"), "symbol", "left_semi")
        .drop("tail_ts", "tail_close")
    )
    return rows, verdict


def close_series(hourly, fine):
    """Daily closes: hourly history, extended by finer bars for days the history lacks."""
    last = lambda df, tag: df.groupBy("symbol", "et_date").agg(F.max_by("close", "ts").alias("close")).withColumn("source", F.lit(tag))
    h, f = last(hourly, "hourly"), last(fine, "fine")
    return h.unionByName(f.join(h, ["symbol", "et_date"], "left_anti"))


def write_table(df, path, partition_by=(), csv=False):
    """Parquet sink partitioned by the given columns, with an optional CSV copy beside it."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    if csv:
        df.write.mode("overwrite").option("header", True).csv(path + "_csv")
    return path


def provenance(df, ts, source, key="symbol"):
    """One sidecar row per table part: rows, first and last time, source."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    ).withColumn("source", F.lit(source))


def freshness(df, now, max_age_days, ts="ts", key="symbol"):
    age = (tm.micros(F.lit(now).cast("timestamp_ntz")) - tm.micros(F.max(ts))) / 86_400_000_000
    return df.groupBy(key).agg(F.max(ts).alias("last_ts"), age.alias("age_days")).withColumn("stale", F.col("age_days") > max_age_days)


def weekly_volume(daily, date="et_date"):
    """Volume by Monday-start week."""
    wk = F.to_date(F.date_trunc("week", F.col(date)))
    return daily.groupBy("symbol", wk.alias("week_start")).agg(F.sum("volume").alias("volume"))


def weekly_venues(rows, market):
    """Merge two weekly venue summaries (ATS and OTC) and set them against the market's weekly volume."""
    p = rows.groupBy("symbol", "week_start").agg(
        F.sum(F.when(F.col("code") == "ATS", F.col("shares"))).alias("ats_shares"),
        F.sum(F.when(F.col("code") == "OTC", F.col("shares"))).alias("otc_shares"),
        F.max("published").alias("published"),
    ).filter(F.col("published").isNotNull())
    off = F.coalesce("ats_shares", F.lit(0.0)) + F.coalesce("otc_shares", F.lit(0.0))
    return p.join(market.withColumnRenamed("volume", "market_volume"), ["symbol", "week_start"], "left").withColumn(
        "off_shares", off
    ).withColumn("off_pct", F.when(F.col("market_volume") != 0, F.col("off_shares") / F.col("market_volume") * 100))


def keep_issues(rows, allow):
    """For reused tickers keep rows whose issue name starts with an allowed prefix; other tickers pass.

    ``allow`` is a literal {ticker: [prefix, ...]} of reused tickers only.
    """
    ok = F.lit(True)
    name = F.lower(F.trim("issue_name"))
    for ticker, prefixes in allow.items():
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | name.startswith(p)
        ok = F.when(F.col("ticker") == ticker, hit).otherwise(ok)
    return rows.filter(ok)
