"""Null-safe numeric helpers and guarded rolling aggregates."""

from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a, b):
    """a / b with NULL when b is NULL or zero (missing is NULL, never NaN)."""
    return F.when(b != 0, a / b)


def guarded(agg, x, w, k):
    """agg(x) over w once at least k non-null values are in the frame (rolling min_periods)."""
    return F.when(F.count(x).over(w) >= k, agg(x).over(w))


def pct_rank_last(x, w, k=1):
    """Average-tie rank of the current value inside its frame, as a share of the frame's non-null count."""
    vals = F.collect_list(x).over(w)
    less = F.size(F.filter(vals, lambda v: v < x))
    same = F.size(F.filter(vals, lambda v: v == x))
    return F.when((F.size(vals) >= k) & x.isNotNull(), (less + (same + 1) / 2.0) / F.size(vals))


def clip(x, lo, hi):
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def rounded(df, names, digits=9):
    """Round double columns, mapping negative zero to zero, so results compare across engines."""
    for c in names:
        r = F.round(F.col(c).cast(T.DoubleType()), digits)
        df = df.withColumn(c, F.when(r == 0, F.lit(0.0)).otherwise(r))
    return df


def grid(df, **axes):
    """Attach every combination of a few literal parameter values to each row (no join, no shuffle)."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def grid_rows(df, names, rows):
    """Attach a literal list of parameter tuples to each row."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return df.withColumn("_g", F.explode(F.array(*structs))).select(*df.columns, *[F.col(f"_g.{n}").alias(n) for n in names])
