"""Event scoring. The tables below are fixed values that results depend on."""

from pyspark.sql import functions as F

# fixed values: position score by source tier
POSITION_BY_TIER = {"T0": 1.0, "T1": 1.0, "T2": 0.7, "T3": 0.3}
POSITION_DERIVED, POSITION_DEFAULT = 0.5, 0.3
DERIVED_SOURCES = ["detector"]

# fixed values: fact score by event type, then by prefix, then default
FACT_BY_TYPE = {
    "form4": 1.0, "form144": 1.0, "sc13d": 1.0, "sc13g": 1.0, "sc13d_amend": 1.0, "sc13g_amend": 1.0,
    "short_interest": 1.0, "ats_weekly": 1.0, "options_snapshot": 1.0, "polymarket_odds": 1.0,
    "detector_state": 1.0, "detector_split_guard": 1.0,
    "fomc_meeting": 0.6, "fomc_meeting_sep": 0.6, "earnings_date": 0.6,
}
FACT_BY_PREFIX = [("8k", 1.0), ("uspto", 1.0), ("patent", 1.0), ("news_", 0.2), ("youtube", 0.2), ("x_", 0.2)]
FACT_DEFAULT = 0.2

# fixed values: half-life class by source, then by type prefix, then default; half-life in days per class
CLASS_BY_SOURCE = {
    "edgar": "data", "edgar_t0": "data", "finra_short": "data", "finra_ats": "data",
    "options_snapshot": "data", "polymarket": "data", "detector": "data", "uspto": "data",
    "fed_fomc": "calendar", "earnings_cal": "calendar",
    "news_rss": "news", "youtube": "news", "x_nitter": "news", "x_api_paid": "news",
}
CLASS_BY_PREFIX = [("news_", "news"), ("youtube", "news"), ("x_", "news"), ("fomc", "calendar"), ("earnings", "calendar")]
CLASS_DEFAULT = "news"
HALF_LIFE_DAYS = {"data": 14.0, "news": 2.0}


def lookup(values, key):
    m = F.create_map(*[F.lit(v) for kv in values.items() for v in kv])
    return F.try_element_at(m, key)


def by_prefix(rules, text, default):
    out = F.lit(default)
    for prefix, value in reversed(rules):
        out = F.when(text.startswith(prefix), F.lit(value)).otherwise(out)
    return out


def position_score(source, tier):
    return F.when(source.isin(DERIVED_SOURCES), POSITION_DERIVED).otherwise(
        F.coalesce(lookup(POSITION_BY_TIER, tier), F.lit(POSITION_DEFAULT))
    )


def fact_score(event_type):
    t = F.coalesce(event_type, F.lit(""))
    return F.coalesce(lookup(FACT_BY_TYPE, t), by_prefix(FACT_BY_PREFIX, t, FACT_DEFAULT))


def source_class(source, event_type):
    t = F.coalesce(event_type, F.lit(""))
    return F.coalesce(lookup(CLASS_BY_SOURCE, source), by_prefix(CLASS_BY_PREFIX, t, CLASS_DEFAULT))


def recency_score(cls, age_days):
    """exp(-ln2 * age / half-life); calendar rows never decay, future rows count as fresh, unknown time is 0."""
    decay = F.exp(-F.log(F.lit(2.0)) * age_days / lookup(HALF_LIFE_DAYS, cls))
    return (
        F.when(cls == "calendar", 1.0)
        .when(age_days.isNull(), 0.0)
        .when(age_days <= 0, 1.0)
        .otherwise(decay)
    )


def surprise_score(iv, base, full=0.30):
    return F.when(base > 0, F.least(F.lit(1.0), F.abs(iv - base) / base / full))
