"""Filing, feed and calendar-page rows to typed event rows."""

from pyspark.sql import functions as F

# fixed values: filing form to event type
FORM_TYPES = {
    "SC 13D": "sc13d", "SC 13D/A": "sc13d_amend", "SC 13G": "sc13g", "SC 13G/A": "sc13g_amend",
    "144": "form144", "144/A": "form144_amend",
}

FORM4_SCHEMA = (
    "issuer struct<issuerTradingSymbol:string>, "
    "reportingOwner array<struct<name:string, isOfficer:string, isDirector:string, isTenPercentOwner:string>>, "
    "transaction array<struct<code:string, shares:string, price:string, tradeDate:string>>"
)


def item_key(items):
    """Comma list of items to a sorted type key."""
    parts = F.filter(F.transform(F.split(F.coalesce(items, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, F.concat(F.lit("8k_items_"), F.array_join(F.array_sort(parts), "_"))).otherwise("8k_unknown")


def current_reports(index):
    """8-K rows of a filing index (form, items)."""
    return index.filter(F.col("form").isin("8-K", "8-K/A")).withColumn("type", item_key(F.col("items"))).withColumn(
        "is_amendment", F.col("form") == "8-K/A"
    )


def form_type(form):
    m = F.create_map(*[F.lit(x) for kv in FORM_TYPES.items() for x in kv])
    return F.try_element_at(m, F.replace(form, F.lit("SCHEDULE "), F.lit("SC ")))


def insider_filings(docs):
    """Ownership XML (accession, xml) to one row per (accession, code): shares, value, VWAP, trade dates, role."""
    x = docs.withColumn("_x", F.from_xml("xml", FORM4_SCHEMA)).select(
        "accession", "_x.reportingOwner", F.explode("_x.transaction").alias("t")
    )
    own = lambda f: F.exists("reportingOwner", lambda o: o[f].isin("1", "true"))
    role = (
        F.when(own("isTenPercentOwner") & own("isOfficer"), "ten_pct_officer")
        .when(own("isOfficer"), "officer").when(own("isDirector"), "director")
        .when(own("isTenPercentOwner"), "ten_pct").otherwise("other")
    )
    t = x.select(
        "accession", role.alias("role"), F.get("reportingOwner", F.lit(0))["name"].alias("owner"), F.col("t.code").alias("code"),
        F.col("t.shares").try_cast("double").alias("shares"), F.col("t.price").try_cast("double").alias("price"),
        F.col("t.tradeDate").alias("trade_date"),
    ).filter(F.col("shares").isNotNull() & F.col("price").isNotNull())
    g = t.groupBy("accession", "role", "owner", "code").agg(
        F.sum("shares").alias("shares"), F.sum(F.col("shares") * F.col("price")).alias("value_usd"),
        F.array_join(F.sort_array(F.collect_set("trade_date")), ",").alias("trade_dates"),
    )
    return g.withColumn("vwap", F.when(F.col("shares") != 0, F.col("value_usd") / F.col("shares")).otherwise(0.0)).withColumn(
        "type", F.when(F.col("code") == "P", "insider_buy").when(F.col("code") == "S", "insider_sell").otherwise(F.concat(F.lit("code_"), "code"))
    )


def meeting_days(pages, text="html"):
    """Yearly calendar pages ('<year> Meetings' panels with month and date cells) to one row per meeting day.

    The last number in the date cell and the last month name count; a star marks a projections meeting.
    """
    seg = pages.withColumn("_panels", F.split(text, r"(?=\d{4} Meetings)")).select(
        *[c for c in pages.columns if c != text], F.explode("_panels").alias("seg")
    )
    seg = seg.withColumn("year", F.regexp_extract("seg", r"^(\d{4}) Meetings", 1)).filter("year <> ''")
    cells = seg.withColumn("_m", F.regexp_extract_all("seg", F.lit(r"meeting__month[^>]*>([^<]+)"), F.lit(1))).withColumn(
        "_d", F.regexp_extract_all("seg", F.lit(r"meeting__date[^>]*>([^<]+)"), F.lit(1))
    )
    n = F.least(F.size("_m"), F.size("_d"))
    z = cells.withColumn("_z", F.explode(F.arrays_zip(F.slice("_m", F.lit(1), n).alias("m"), F.slice("_d", F.lit(1), n).alias("d"))))
    last_month = F.element_at(F.split(F.trim(F.col("_z.m")), r"[/ ]+"), -1)
    nums = F.regexp_extract_all(F.col("_z.d"), F.lit(r"\d+"), F.lit(0))
    day = F.when(F.size(nums) > 0, F.element_at(nums, -1))
    iso = F.concat_ws("-", "year", last_month, day)
    return z.select(
        *[c for c in pages.columns if c != text],
        F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MMMM-d"))).alias("meeting_date"),
        F.col("_z.d").contains("*").alias("has_projections"),
    ).filter(F.col("meeting_date").isNotNull())


def filing_rows(batches, forms, since):
    """Parallel arrays (one array per field) to one event row per filing of the wanted forms and dates."""
    z = batches.select(F.explode(F.arrays_zip("form", "accession", "filing_date", "description")).alias("z"))
    return z.select("z.*").filter(F.col("form").isin(list(forms)) & (F.col("filing_date") >= since)).select(
        F.col("accession").alias("dedupe_key"), form_type(F.col("form")).alias("type"), "filing_date",
        F.concat_ws(" ", "form", F.coalesce(F.nullif("description", F.lit("")), "accession")).alias("title"),
    ).dropDuplicates(["dedupe_key"])


def feed_items(items, dedicated, keywords, max_summary=1000):
    """Feed rows: keep dedicated feeds or keyword hits, drop undated rows, truncate the summary, build key and type."""
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | text.contains(k)
    return items.filter(F.col("feed").isin(list(dedicated)) | hit).filter(F.col("published").isNotNull()).select(
        F.concat_ws(":", "feed", F.coalesce("item_id", "link", "title")).alias("dedupe_key"),
        F.concat(F.lit("news_"), "feed").alias("type"), F.col("published").alias("event_time"), "title",
        F.substring("summary", 1, max_summary).alias("summary"),
    )


def patent_rows(grants, publications):
    """Grants and publications as one event table."""
    g = grants.select(F.concat(F.lit("grant:"), "doc").alias("dedupe_key"), F.lit("patent_grant").alias("type"), F.col("day").alias("event_date"))
    p = publications.select(F.concat(F.lit("pub:"), "doc").alias("dedupe_key"), F.lit("patent_application").alias("type"), F.col("day").alias("event_date"))
    return g.unionByName(p)


def earnings_window(dates, key):
    """Collapse an expected window to its first day, keeping every date."""
    return dates.groupBy(key).agg(F.min("day").alias("event_date"), F.array_join(F.sort_array(F.collect_set(F.col("day").cast("string"))), ",").alias("dates"))
