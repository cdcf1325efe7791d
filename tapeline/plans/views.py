"""Shared inputs of the registered queries, once as DataFrames and once as SQL.

The driver tables hold no bars or filings, so bars, panels and dated events are derived from them.
"""

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import times as tm
from ..operators import bars as B
from ..operators.spread import positions
from ..session import cut
from ..sources.tables import table

ET_DATE = "CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE)"

# fixed values: how an events row is read as a dated public event
SOURCE_OF = {"click": "news_rss", "error": "edgar", "purchase": "edgar_t0", "signup": "finra_short", "view": "x_nitter"}
TYPE_OF = {"click": "news_article", "error": "8k_5.02", "purchase": "form4", "signup": "short_interest", "view": "x_post"}
TIER_OF = {"click": "T3", "error": "T1", "purchase": "T1", "signup": "T0", "view": "T3"}


def _sql_map(m, c="event_type"):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


VIEWS = {
    "ticks": "SELECT event_id, event_type AS symbol, ts, value AS price, 1.0::DOUBLE AS volume FROM events WHERE value > 0",
    "bars_1h": f"""SELECT symbol, ts, et_date, open, high, low, close, volume,
        row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM (
        SELECT symbol, date_trunc('hour', ts) AS ts, {ET_DATE.replace('ts AT', "date_trunc('hour', ts) AT")} AS et_date,
        first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM {{{{ticks}}}} GROUP BY ALL)""",
    "bars_15m": f"""SELECT symbol, ts, {ET_DATE} AS et_date, open, high, low, close, volume,
        row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM (
        SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts,
        first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM {{{{ticks}}}}
        GROUP BY symbol, time_bucket(INTERVAL 15 MINUTE, ts))""",
    "bars_day": """SELECT symbol, et_date, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
        last(close ORDER BY ts) AS close, sum(volume) AS volume, min(ts) AS open_time,
        max(ts) + INTERVAL 1 HOUR AS close_time,
        row_number() OVER (PARTITION BY symbol ORDER BY et_date) - 1 AS d FROM {{bars_1h}} GROUP BY symbol, et_date""",
    "panel_day": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY et_date) - 1 AS d FROM (
        SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS et_date,
        first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
        last(o_totalprice ORDER BY o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
        FROM orders GROUP BY 1, 2)""",
    "panel_wide": """SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS et_date,
        first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open,
        last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close,
        count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "dated": f"""SELECT event_id, ts AS event_time, ts + to_seconds((event_id * 37) % 7200) AS observed_time,
        event_type, {_sql_map(SOURCE_OF)} AS source_id, {_sql_map(TYPE_OF)} AS type, {_sql_map(TIER_OF)} AS tier,
        value, props, user_id FROM events""",
    "polls": """SELECT source_id, date_trunc('hour', observed_time) AS polled_at, max(event_id) AS poll_id,
        max(event_id) % 11 <> 0 AS ok, count(*) AS n_seen,
        count(*) FILTER (WHERE event_id % 3 = 0) AS n_new FROM {{dated}} GROUP BY 1, 2""",
    "releases": """SELECT symbol, et_date, d, published, short_interest,
        100.0 * (short_interest / lag(short_interest) OVER (PARTITION BY symbol ORDER BY et_date) - 1) AS change_pct FROM (
        SELECT symbol, et_date, d, CAST(et_date AS TIMESTAMP) + INTERVAL 21 HOUR AS published,
        1000.0 * volume + close / 100.0 AS short_interest FROM {{panel_day}} WHERE d % 15 = 0)""",
    "posts_daily": f"SELECT {ET_DATE} AS et_date, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1",
    "titles": """SELECT doc_id, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS DATE) AS et_date, source, lang,
        replace(text, chr(10), ' ') AS title FROM documents""",
    "scored": """SELECT l.doc_id, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label, l.toxic, d.lang AS symbol, d.source
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
}


def with_views(sql):
    """Prepend the views a query names, in dependency order."""
    order = []

    def visit(text):
        for name in re.findall(r"\{\{(\w+)\}\}", text):
            if name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    plain = lambda s: re.sub(r"\{\{(\w+)\}\}", r"\1", s)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def ticks(spark, sf):
    e = table(spark, sf, "events", "event_id", "event_type", "ts", "value")
    return e.filter(F.col("value") > 0).select(
        "event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume")
    )


def bars_1h(spark, sf):
    return B.bars_from_ticks(ticks(spark, sf), 60)


def bars_15m(spark, sf):
    return B.bars_from_ticks(ticks(spark, sf), 15)


def with_pos(bars):
    """Bars with their position, written once: pattern and settlement queries pass over them several times."""
    return cut(positions(bars, "symbol", "et_date", "ts"), "bars")


def bars_day(spark, sf):
    return B.with_ordinal(B.daily_bars(bars_1h(spark, sf)))


def panel_day(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    day = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("et_date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return B.with_ordinal(day)


def panel_wide(spark, sf):
    l = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    p = table(spark, sf, "part", "p_partkey", "p_brand")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    dec = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    # order, line, part and supplier packed into one fixed-width number: the aggregate stays a hash aggregate
    o = ((dec("l_orderkey", 14) * 10 + F.col("l_linenumber")) * F.lit("1" + "0" * 11).cast("decimal(12,0)") + F.col("l_partkey")) * F.lit("1" + "0" * 10).cast("decimal(11,0)") + F.col("l_suppkey")
    return (
        l.join(p, l.l_partkey == p.p_partkey)
        .groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("et_date"))
        .agg(F.min_by(px, o).alias("open"), F.max_by(px, o).alias("close"), F.count(F.lit(1)).alias("n"))
    )


def _map(m, c="event_type"):
    out = F.lit(None).cast("string")
    for k, v in reversed(list(m.items())):
        out = F.when(F.col(c) == k, F.lit(v)).otherwise(out)
    return out


def dated(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("ts").alias("event_time"),
        tm.plus_seconds("ts", (F.col("event_id") * 37) % 7200).alias("observed_time"),
        "event_type", _map(SOURCE_OF).alias("source_id"), _map(TYPE_OF).alias("type"), _map(TIER_OF).alias("tier"),
        "value", "props", "user_id",
    )


def polls(spark, sf):
    return dated(spark, sf).groupBy("source_id", F.date_trunc("hour", "observed_time").cast("timestamp_ntz").alias("polled_at")).agg(
        F.max("event_id").alias("poll_id"),
        (F.max("event_id") % 11 != 0).alias("ok"),
        F.count(F.lit(1)).alias("n_seen"),
        F.sum(F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).alias("n_new"),
    )


def releases(spark, sf):
    w = W.partitionBy("symbol").orderBy("et_date")
    return (
        panel_day(spark, sf)
        .filter(F.col("d") % 15 == 0)
        .select(
            "symbol", "et_date", "d",
            tm.plus_seconds(F.col("et_date").cast("timestamp_ntz"), 21 * 3600).alias("published"),
            (1000.0 * F.col("volume") + F.col("close") / 100.0).alias("short_interest"),
        )
        .withColumn("change_pct", 100.0 * (F.col("short_interest") / F.lag("short_interest").over(w) - 1))
    )


def posts_daily(spark, sf):
    e = table(spark, sf, "events", "ts", "event_type").filter(F.col("event_type") == "view")
    return e.groupBy(tm.et_date("ts").alias("et_date")).agg(F.count(F.lit(1)).alias("n"))


def titles(spark, sf, *more):
    d = table(spark, sf, "documents", "doc_id", "text", "source", "lang")
    return d.select(
        "doc_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("et_date"),
        "source", "lang", F.replace("text", F.lit("\n"), F.lit(" ")).alias("title"), *more,
    )


def scored(spark, sf):
    l = table(spark, sf, "labels")
    d = table(spark, sf, "documents", "doc_id", "n_chars", "lang", "source")
    return l.join(d, "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"), "toxic",
        F.col("lang").alias("symbol"), "source",
    )
