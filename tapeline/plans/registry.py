"""Registered queries: a Spark callable and, where SQL can express it, the equivalent DuckDB text."""

from ..functions.numeric import rounded
from ..session import configure
from .views import with_views

QUERIES = {}
ORACLES = {}


def query(key, sql=None, dbl="", dp=9):
    """Register ``fn(spark, sf_dir)``. ``dbl`` names the double columns rounded on both sides to ``dp`` digits.

    ``{{name}}`` inside the SQL refers to a shared view of the driver tables (see ``views.py``).
    """
    doubles = dbl.split()

    def deco(fn):
        def run(spark, sf_dir):
            configure(spark)
            return rounded(fn(spark, sf_dir), doubles, dp)

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            body = with_views(sql)
            if doubles:
                rep = ", ".join(
                    f"CASE WHEN round(CAST({c} AS DOUBLE), {dp}) = 0 THEN 0.0::DOUBLE ELSE round(CAST({c} AS DOUBLE), {dp}) END AS {c}"
                    for c in doubles
                )
                body = f"SELECT * REPLACE ({rep}) FROM ({body}) q"
            ORACLES[key] = body
        return fn

    return deco
