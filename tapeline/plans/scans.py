"""Scans, sources and sinks."""

from pyspark.sql import functions as F

from ..functions import times as tm
from ..operators import bars as B
from ..operators import calendar as C
from ..operators import spread
from ..session import run_dir
from ..sources import filings as fl
from ..sources import readers as rd
from ..sources.tables import table
from . import views as v
from .registry import query
from .views import ET_DATE

ET_TS = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
ET_MIN = f"(extract(hour FROM {ET_TS}) * 60 + extract(minute FROM {ET_TS}))"


@query("src_01_load_bars", f"""SELECT symbol, ts, et_date, open, high, low, close, volume FROM {{{{bars_1h}}}}
    WHERE {ET_MIN} >= 570 AND {ET_MIN} < 960""")
def src_01(spark, sf):
    out = B.rth(v.bars_1h(spark, sf)).select(
        "symbol", F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("Datetime"),
        F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    path = run_dir(spark, "bars_csv")
    out.write.option("header", True).csv(path)
    return rd.load_bars(spark, path).select("symbol", "ts", "et_date", "open", "high", "low", "close", "volume")


@query("src_02_bars_from_ticks", "SELECT symbol, ts, et_date, open, high, low, close, volume FROM {{bars_15m}}")
def src_02(spark, sf):
    return v.bars_15m(spark, sf)


@query("src_03_bar_size", """SELECT symbol, quantile_cont(g, 0.5) AS bar_minutes FROM (SELECT symbol,
    (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts))) / 60000000.0 AS g FROM {{bars_15m}})
    GROUP BY symbol""", dbl="bar_minutes")
def src_03(spark, sf):
    return spread.quantiles(B.bar_spacing(v.bars_15m(spark, sf)), "symbol", "gap_min", bar_minutes=0.5)


@query("src_04_rth_filter", f"""SELECT symbol, ts, et_date, close FROM {{{{bars_15m}}}}
    WHERE {ET_MIN} >= 570 AND {ET_MIN} < 960 AND isodow(et_date) < 6""")
def src_04(spark, sf):
    cal = C.calendar(spark, "2023-12-01", "2024-03-31")
    return B.rth(v.bars_15m(spark, sf), cal).select("symbol", "ts", "et_date", "close")


RAW_TIME = """CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S+00:00')
    WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'unknown' END"""


def raw_events(spark, sf):
    e = table(spark, sf, "events")
    t = F.date_trunc("second", F.col("ts").cast("timestamp"))
    iso = lambda p: F.date_format(t, p)
    k = F.col("event_id") % 4
    return e.select(
        "event_id", F.when(k == 0, iso("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.concat(iso("yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")))
        .when(k == 2, iso("yyyy-MM-dd HH:mm:ss")).otherwise("unknown").alias("event_time_utc"),
        F.col("event_type").alias("source"), F.col("props").alias("payload"))


@query("src_05_event_csv", "SELECT event_id, event_type AS source, date_trunc('second', ts) AS event_time FROM events WHERE event_id % 4 <> 3")
def src_05(spark, sf):
    return rd.parse_events(raw_events(spark, sf)).select("event_id", "source", "event_time")


@query("src_06_json_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def src_06(spark, sf):
    e = table(spark, sf, "events", "event_id", F.col("props").alias("payload"))
    return rd.expand_payload(e, "k int")


FILINGS = """SELECT o_orderkey AS accession, CASE o_orderstatus WHEN 'F' THEN '8-K' WHEN 'O' THEN '8-K/A' ELSE '10-K' END AS form,
    CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE (o_orderkey % 9 + 1) || '.0' || (o_custkey % 5 + 1) || ', ' || (o_orderkey % 7 + 1) || '.0' || (o_custkey % 3 + 1) END AS items,
    o_orderdate AS filed, o_orderpriority AS symbol, o_custkey FROM orders"""


def filings(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    part = lambda a, b: F.concat((a + 1).cast("string"), F.lit(".0"), (b + 1).cast("string"))
    return o.select(
        k.alias("accession"), F.when(F.col("o_orderstatus") == "F", "8-K").when(F.col("o_orderstatus") == "O", "8-K/A").otherwise("10-K").alias("form"),
        F.when(k % 17 == 0, "").otherwise(F.concat(part(k % 9, c % 5), F.lit(", "), part(k % 7, c % 3))).alias("items"),
        F.col("o_orderdate").alias("filed"), F.col("o_orderpriority").alias("symbol"), "o_custkey")


@query("src_07_current_reports", f"""SELECT accession, filed, form = '8-K/A' AS is_amendment, CASE WHEN items = '' THEN '8k_unknown' ELSE
    '8k_items_' || array_to_string(list_sort(list_transform(string_split(items, ','), lambda s: trim(s))), '_') END AS type
    FROM ({FILINGS}) WHERE form IN ('8-K', '8-K/A')""")
def src_07(spark, sf):
    return fl.current_reports(filings(spark, sf)).select("accession", "filed", "is_amendment", "type")


def insider_xml(spark, sf):
    """One ownership document per order, one transaction per line item."""
    l = table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate", "l_linenumber")
    tx = F.concat(
        F.lit("<transaction><code>"), F.when(F.col("l_returnflag") == "A", "P").when(F.col("l_returnflag") == "R", "S").otherwise("M"),
        F.lit("</code><shares>"), F.col("l_quantity").cast("string"), F.lit("</shares><price>"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise((F.floor(F.col("l_extendedprice") / F.col("l_quantity"))).cast("string")),
        F.lit("</price><tradeDate>"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("</tradeDate></transaction>"))
    k = F.col("l_orderkey")
    flag = lambda n: F.when(k % n == 0, "1").otherwise("0")
    return l.groupBy("l_orderkey").agg(F.array_join(F.collect_list(tx), "").alias("_tx")).select(
        F.col("l_orderkey").alias("accession"),
        F.concat(F.lit("<ownershipDocument><issuer><issuerTradingSymbol>X</issuerTradingSymbol></issuer><reportingOwner><name>owner "), (k % 50).cast("string"),
                 F.lit("</name><isOfficer>"), flag(2), F.lit("</isOfficer><isDirector>"), flag(3), F.lit("</isDirector><isTenPercentOwner>"), flag(5),
                 F.lit("</isTenPercentOwner></reportingOwner>"), F.col("_tx"), F.lit("</ownershipDocument>")).alias("xml"))


@query("src_08_insider_filings", """SELECT accession, 'owner ' || (accession % 50) AS owner, role, code,
    CASE code WHEN 'P' THEN 'insider_buy' WHEN 'S' THEN 'insider_sell' ELSE 'code_' || code END AS type,
    sum(sh) AS shares, sum(sh * px) AS value_usd, CASE WHEN sum(sh) = 0 THEN 0 ELSE sum(sh * px) / sum(sh) END AS vwap,
    array_to_string(list_sort(list_distinct(list(dt))), ',') AS trade_dates FROM (
    SELECT l_orderkey AS accession, CASE WHEN l_orderkey % 10 = 0 THEN 'ten_pct_officer' WHEN l_orderkey % 2 = 0 THEN 'officer'
      WHEN l_orderkey % 3 = 0 THEN 'director' WHEN l_orderkey % 5 = 0 THEN 'ten_pct' ELSE 'other' END AS role,
      CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'M' END AS code, l_quantity AS sh, floor(l_extendedprice / l_quantity) AS px,
      strftime(l_shipdate, '%Y-%m-%d') AS dt FROM lineitem WHERE l_linenumber <> 7) GROUP BY accession, role, code""",
       dbl="shares value_usd vwap", dp=4)
def src_08(spark, sf):
    return fl.insider_filings(insider_xml(spark, sf))


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


@query("src_09_meeting_pages", """SELECT page_id, make_date(2020 + k, CASE WHEN odd THEN m + 2 ELSE m + 1 END, dd) AS meeting_date, star AS has_projections FROM (
    SELECT page_id, k, page_id % 2 = 1 AS odd, (page_id + k) % 11 AS m, (page_id % 25) + 2 AS dd, (page_id + k) % 3 = 0 AS star
    FROM pages, (SELECT unnest([0, 1]) AS k))""")
def src_09(spark, sf):
    p = table(spark, sf, "pages", "page_id", "html")
    names = F.array(*[F.lit(m) for m in MONTHS])

    def panel(k):
        pid = F.col("page_id")
        m = ((pid + k) % 11).cast("int")
        label = F.when(pid % 2 == 1, F.concat(F.get(names, m), F.lit("/"), F.get(names, m + 1))).otherwise(F.get(names, m))
        star = F.when((pid + k) % 3 == 0, "*").otherwise("")
        return F.concat(F.lit(f"{2020 + k} Meetings<div class='meeting__month'>"), label, F.lit("</div><div class='meeting__date x'>"),
                        (pid % 25 + 1).cast("string"), F.lit("-"), (pid % 25 + 2).cast("string"), star, F.lit("</div>"))

    # the calendar panel sits inside the page's own html
    doc = p.select("page_id", F.concat("html", panel(0), F.lit("<p>"), panel(1)).alias("html"))
    return fl.meeting_days(doc)


@query("src_10_post_archive", """SELECT event_id, date_trunc('second', ts) AS event_time, CASE event_type WHEN 'view' THEN 'post_text' ELSE 'post_repeat' END AS type
    FROM events WHERE user_id % 3 <> 0 AND event_type IN ('view', 'click') AND event_id % 4 <> 3 AND ts >= TIMESTAMP '2024-01-05'""")
def src_10(spark, sf):
    raw = raw_events(spark, sf).join(table(spark, sf, "events", "event_id", "user_id"), "event_id").select(
        "event_id", F.when(F.col("user_id") % 3 == 0, "Other").when(F.col("user_id") % 3 == 1, " Poster").otherwise("POSTER ").alias("sender"),
        F.col("source").alias("kind"), F.col("event_time_utc").alias("created"))
    return rd.load_posts(raw, "poster", {"view": "text", "click": "repeat"}, "2024-01-05").select("event_id", "event_time", "type")


@query("src_11_macro_series", """SELECT series, obs_date, CASE WHEN monthly THEN CAST(obs_date + INTERVAL 1 MONTH AS TIMESTAMP) ELSE CAST(obs_date + INTERVAL 1 DAY AS TIMESTAMP) END
    + INTERVAL 12 HOUR AS available_from, value FROM (
    SELECT o_orderpriority AS series, date_trunc('month', o_orderdate)::DATE AS obs_date, count(*) % 10 <> 0 AS good, CAST(count(*) AS DOUBLE) AS value, true AS monthly FROM orders GROUP BY 1, 2
    UNION ALL SELECT 'daily', o_orderdate::DATE, count(*) % 10 <> 0, CAST(count(*) AS DOUBLE), false FROM orders GROUP BY 2) WHERE good""", dbl="value")
def src_11(spark, sf):
    o = table(spark, sf, "orders", "o_orderdate", "o_orderpriority")
    text = F.when(F.count(F.lit(1)) % 10 == 0, ".").otherwise(F.count(F.lit(1)).cast("string")).alias("text")
    m = o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("obs_date")).agg(text)
    d = o.groupBy(F.lit("daily").alias("series"), F.to_date("o_orderdate").alias("obs_date")).agg(text)
    return rd.macro_series(m, "monthly").unionByName(rd.macro_series(d, "daily"))


@query("src_12_publication_time", """WITH cal AS (SELECT d, row_number() OVER (ORDER BY d) AS o FROM (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6),
    s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS settlement FROM orders),
    r AS (SELECT settlement, (SELECT min(o) FROM cal WHERE d >= settlement) AS o FROM s)
    SELECT settlement, cal.d AS pub_date, ((CAST(cal.d AS TIMESTAMP) + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS published
    FROM r JOIN cal ON cal.o = r.o + 9""")
def src_12(spark, sf):
    s = table(spark, sf, "orders", F.to_date("o_orderdate").alias("settlement")).distinct()
    cal = C.calendar(spark, "1994-12-01", "2002-12-31")
    return C.add_trading_days(s, cal, "settlement", 9, "pub_date").withColumn("published", tm.at_et("pub_date", 16))


WEEKLY = """SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CASE WHEN o_orderkey % 2 = 0 THEN 'ATS' ELSE 'OTC' END AS code,
    o_totalprice AS shares, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 21 END AS published FROM orders"""


@query("src_13_weekly_venues", f"""SELECT w.*, m.volume AS market_volume, coalesce(ats_shares, 0) + coalesce(otc_shares, 0) AS off_shares,
    CASE WHEN m.volume <> 0 THEN (coalesce(ats_shares, 0) + coalesce(otc_shares, 0)) / m.volume * 100 END AS off_pct FROM (
    SELECT symbol, week_start, sum(shares) FILTER (WHERE code = 'ATS') AS ats_shares, sum(shares) FILTER (WHERE code = 'OTC') AS otc_shares, max(published) AS published
    FROM ({WEEKLY}) GROUP BY 1, 2 HAVING max(published) IS NOT NULL) w
    LEFT JOIN (SELECT symbol, CAST(date_trunc('week', et_date) AS DATE) AS week_start, sum(volume) AS volume FROM {{{{panel_day}}}} GROUP BY 1, 2) m USING (symbol, week_start)""",
       dbl="ats_shares otc_shares off_shares market_volume off_pct", dp=3)
def src_13(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    rows = o.select(
        F.col("o_orderpriority").alias("symbol"), F.to_date(F.date_trunc("week", "o_orderdate")).alias("week_start"),
        F.when(F.col("o_orderkey") % 2 == 0, "ATS").otherwise("OTC").alias("code"), F.col("o_totalprice").alias("shares"),
        F.when(F.col("o_orderkey") % 3 != 0, F.date_add(F.to_date("o_orderdate"), 21)).alias("published"))
    return rd.weekly_venues(rows, rd.weekly_volume(v.panel_day(spark, sf)))


SEGS = """WITH a AS (SELECT symbol, ts, close FROM {{bars_1h}} WHERE ts < TIMESTAMP '2024-01-18'),
    b AS (SELECT symbol, ts, close * (1 + (pos % 5) / 1000.0) AS close FROM {{bars_1h}} WHERE ts >= TIMESTAMP '2024-01-15') """


def segments(spark, sf):
    bars = v.with_pos(v.bars_1h(spark, sf))
    a = bars.filter(F.col("ts") < F.lit("2024-01-18").cast("timestamp_ntz")).select("symbol", "ts", "close")
    b = bars.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select(
        "symbol", "ts", (F.col("close") * (1 + (F.col("pos") % 5) / 1000.0)).alias("close"))
    return a, b


@query("src_14_bar_stitch", SEGS + "SELECT symbol, ts, close, 'a' AS src FROM a UNION ALL SELECT symbol, ts, close, 'b' FROM b WHERE ts >= TIMESTAMP '2024-01-18'", dbl="close")
def src_14(spark, sf):
    a, b = segments(spark, sf)
    return rd.stitch(a.withColumn("src", F.lit("a")), b.withColumn("src", F.lit("b")))


@query("src_14_seam_difference", SEGS + "SELECT symbol, count(*) AS n_overlap, max(abs(b.close / a.close - 1)) AS max_diff FROM a JOIN b USING (symbol, ts) GROUP BY symbol", dbl="max_diff")
def src_14b(spark, sf):
    return rd.seam_difference(*segments(spark, sf))


APPEND = """WITH o AS (SELECT * FROM {{bars_1h}} WHERE et_date < DATE '2024-01-16'),
    n AS (SELECT symbol, ts, et_date, open, CASE WHEN symbol = 'click' THEN close * 1.5 ELSE close END AS close FROM {{bars_1h}} WHERE et_date >= DATE '2024-01-14'),
    t AS (SELECT symbol, max(ts) AS tail_ts, arg_max(close, ts) AS tail_close FROM o GROUP BY symbol),
    vd AS (SELECT n.symbol, max(abs(n.close / tail_close - 1)) FILTER (WHERE n.ts = tail_ts) AS overlap_diff,
      arg_min(abs(n.open / tail_close - 1), n.ts) FILTER (WHERE n.ts > tail_ts) AS gap FROM n JOIN t USING (symbol) GROUP BY n.symbol),
    vv AS (SELECT *, CASE WHEN overlap_diff > 0.01 THEN 'overlap_break' WHEN gap > 0.9 THEN 'gap_break' ELSE 'ok' END AS verdict FROM vd) """


def _append(spark, sf):
    bars = v.bars_1h(spark, sf)
    old = bars.filter("et_date < date'2024-01-16'")
    new = bars.filter("et_date >= date'2024-01-14'").withColumn("close", F.when(F.col("symbol") == "click", F.col("close") * 1.5).otherwise(F.col("close")))
    return rd.append_checked(old, new, "2024-01-25 15:00:00", gap_tol=0.9)


@query("src_15_append_rows", APPEND + """SELECT n.symbol, n.ts, n.close FROM n JOIN t USING (symbol) JOIN vv USING (symbol)
    WHERE verdict = 'ok' AND n.ts > tail_ts AND n.et_date < DATE '2024-01-25'""", dbl="close")
def src_15(spark, sf):
    return _append(spark, sf)[0].select("symbol", "ts", "close")


@query("src_15_append_verdict", APPEND + "SELECT * FROM vv", dbl="overlap_diff gap")
def src_15b(spark, sf):
    return _append(spark, sf)[1]


@query("src_16_close_series", """WITH h AS (SELECT symbol, et_date, arg_max(close, ts) AS close, 'hourly' AS source FROM {{bars_1h}} WHERE et_date < DATE '2024-01-20' GROUP BY 1, 2),
    f AS (SELECT symbol, et_date, arg_max(close, ts) AS close, 'fine' AS source FROM {{bars_15m}} WHERE et_date >= DATE '2024-01-10' GROUP BY 1, 2)
    SELECT * FROM h UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.symbol = f.symbol AND h.et_date = f.et_date)""")
def src_16(spark, sf):
    return rd.close_series(v.bars_1h(spark, sf).filter("et_date < date'2024-01-20'"), v.bars_15m(spark, sf).filter("et_date >= date'2024-01-10'"))


@query("src_17_sinks", "SELECT symbol, et_date, open, high, low, close, volume FROM {{panel_day}}")
def src_17(spark, sf):
    p = v.panel_day(spark, sf).select("symbol", "et_date", "open", "high", "low", "close", "volume")
    path = rd.write_table(p, run_dir(spark, "panel"), ["symbol"], csv=True)
    return spark.read.schema(p.schema).parquet(path)


@query("src_18_provenance", "SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, 'events' AS source FROM {{bars_15m}} GROUP BY symbol")
def src_18(spark, sf):
    return rd.provenance(v.bars_15m(spark, sf), "ts", "events")


@query("src_19_freshness", """SELECT symbol, last_ts, age_days, age_days > 2.5 AS stale FROM (SELECT event_type || '_' || (user_id % 7) AS symbol, max(ts) AS last_ts,
    (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 86400000000.0 AS age_days FROM events GROUP BY 1)""", dbl="age_days")
def src_19(spark, sf):
    e = table(spark, sf, "events", "event_type", "user_id", "ts")
    e = e.withColumn("symbol", F.concat_ws("_", "event_type", (F.col("user_id") % 7).cast("string")))
    return rd.freshness(e, "2024-02-01 00:00:00", 2.5)


FORMS = ["SC 13D", "SC 13D/A", "SCHEDULE 13G", "SCHEDULE 13G/A", "144", "144/A", "10-Q"]
FORM_SQL = "list_extract(['SC 13D', 'SC 13D/A', 'SCHEDULE 13G', 'SCHEDULE 13G/A', '144', '144/A', '10-Q'], CAST(o_orderkey % 7 + 1 AS INTEGER))"
TYPE_SQL = """CASE replace(form, 'SCHEDULE ', 'SC ') WHEN 'SC 13D' THEN 'sc13d' WHEN 'SC 13D/A' THEN 'sc13d_amend' WHEN 'SC 13G' THEN 'sc13g' WHEN 'SC 13G/A' THEN 'sc13g_amend'
    WHEN '144' THEN 'form144' WHEN '144/A' THEN 'form144_amend' END"""


def _form():
    return F.get(F.array(*[F.lit(f) for f in FORMS]), (F.col("o_orderkey") % 7).cast("int"))


@query("src_20_form_type", f"SELECT accession, form, {TYPE_SQL} AS type FROM (SELECT o_orderkey AS accession, {FORM_SQL} AS form FROM orders)")
def src_20(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("accession"), _form().alias("form"))
    return o.withColumn("type", fl.form_type(F.col("form")))


@query("src_21_filing_arrays", f"""SELECT CAST(o_orderkey AS VARCHAR) AS dedupe_key, {TYPE_SQL} AS type, fd AS filing_date,
    form || ' ' || CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderkey AS VARCHAR) ELSE 'desc ' || o_orderstatus END AS title
    FROM (SELECT *, {FORM_SQL} AS form, strftime(o_orderdate, '%Y-%m-%d') AS fd FROM orders) WHERE form <> '10-Q' AND fd >= '1997-06-01'""")
def src_21(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    rows = o.select(F.floor(F.col("o_orderkey") / 256).alias("batch"), F.struct(
        F.col("o_orderkey").cast("string").alias("accession"), _form().alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("desc "), "o_orderstatus")).alias("description")).alias("r"))
    g = rows.groupBy("batch").agg(F.collect_list("r").alias("r"))
    batches = g.select(*[F.col(f"r.{c}").alias(c) for c in ("form", "accession", "filing_date", "description")])
    return fl.filing_rows(batches, [f for f in FORMS if f != "10-Q"], "1997-06-01")


@query("src_22_feed_items", """SELECT source || ':' || CASE WHEN doc_id % 5 = 0 THEN title ELSE CAST(doc_id AS VARCHAR) END AS dedupe_key, 'news_' || source AS type,
    CAST(et_date AS TIMESTAMP) AS event_time, title, substr(summary, 1, 1000) AS summary FROM (SELECT t.*, d.text AS summary FROM {{titles}} t JOIN documents d USING (doc_id))
    WHERE (source IN ('src1', 'src2') OR contains(lower(title || ' ' || summary), 'the') OR contains(lower(title || ' ' || summary), 'und')) AND doc_id % 9 <> 0""")
def src_22(spark, sf):
    d = v.titles(spark, sf, F.col("text").alias("summary"))
    items = d.select(
        F.col("source").alias("feed"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("item_id"), F.lit(None).cast("string").alias("link"),
        F.when(F.col("doc_id") % 9 != 0, F.col("et_date").cast("timestamp_ntz")).alias("published"), "title", "summary")
    return fl.feed_items(items, ["src1", "src2"], ["the", "und"])


@query("src_23_patents", """SELECT CASE WHEN p_size % 2 = 0 THEN 'grant:' ELSE 'pub:' END || p_partkey AS dedupe_key,
    CASE WHEN p_size % 2 = 0 THEN 'patent_grant' ELSE 'patent_application' END AS type, DATE '2020-01-01' + CAST(p_partkey % 900 AS INTEGER) AS event_date FROM part""")
def src_23(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_size").select(
        F.col("p_partkey").cast("string").alias("doc"), "p_size", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")).alias("day"))
    return fl.patent_rows(p.filter("p_size % 2 = 0"), p.filter("p_size % 2 = 1"))


@query("src_23_earnings_window", """SELECT l_orderkey, min(l_shipdate::DATE) AS event_date,
    array_to_string(list_sort(list_distinct(list(CAST(l_shipdate::DATE AS VARCHAR)))), ',') AS dates FROM lineitem GROUP BY l_orderkey""")
def src_23b(spark, sf):
    return fl.earnings_window(table(spark, sf, "lineitem", "l_orderkey", F.to_date("l_shipdate").alias("day")), "l_orderkey")


@query("src_24_weekly_volume", "SELECT symbol, CAST(date_trunc('week', et_date) AS DATE) AS week_start, sum(volume) AS volume FROM {{panel_day}} GROUP BY 1, 2")
def src_24(spark, sf):
    return rd.weekly_volume(v.panel_day(spark, sf))


@query("src_25_reused_tickers", "SELECT p_partkey, p_brand AS ticker, p_name AS issue_name FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') OR (p_brand = 'Brand#1' AND (lower(p_name) LIKE 'small%' OR lower(p_name) LIKE 'red%')) OR (p_brand = 'Brand#2' AND lower(p_name) LIKE 'blue%')")
def src_25(spark, sf):
    p = table(spark, sf, "part", "p_partkey", F.col("p_brand").alias("ticker"), F.col("p_name").alias("issue_name"))
    return rd.keep_issues(p, {"Brand#1": ["small", "red"], "Brand#2": ["blue"]})
