"""Title normalisation."""

from pyspark.sql import functions as F


def strip_outlet(title):
    """Drop one trailing ' - outlet' part."""
    return F.regexp_replace(title, r"\s+-\s+[^-]{1,40}$", "")


def tokens(title):
    return F.regexp_extract_all(F.lower(title), F.lit(r"[a-z0-9]+"), F.lit(0))


def title_key(title):
    return F.array_join(tokens(strip_outlet(title)), "")


def token_set(title):
    return F.array_distinct(tokens(strip_outlet(title)))
