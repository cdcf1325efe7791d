"""Quantiles over a frame that grows from the start of a key, without sorting the frame anew at every row.

Two levels. Rows fall into blocks of positions and values into blocks of ranks; how many values of each rank block stand before each block of
rows is a running sum of counts. Inside a block of rows, walking those counts tells in which rank block the wanted order statistics lie, and at
which place in it (first pass). Each of these pairs of blocks is then searched by itself: the rank block's values from before, as counts, and
the block's own values (second pass). Work is linear in rows for blocks near the square root of a key's length, and no task holds more than
one block of rows and one block of ranks.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from . import spread

SIZE = 4096


def expanding_quantile(df, key, order, value, q, name, inclusive=True, size=SIZE):
    """``df`` with ``name``: the linearly interpolated q-quantile of ``value`` over the key's rows up to this one (or before it, if not
    ``inclusive``); NULLs don't count; NULL where there is nothing yet. ``order`` (a date or number) is different for a key's rows."""
    key = [key] if isinstance(key, str) else list(key)
    kind = df.schema[order].dataType.typeName()
    number = F.unix_date(order) if kind == "date" else F.col(order)
    rows = df.select(*key, F.col(order).alias("_o"), F.col(value).cast("double").alias("_v"), F.floor(number / 1024).alias("_d"))
    rows = cut(spread.positions(rows, key, "_d", "_o", name="_p").drop("_d"), "rows")
    longest = rows.agg(F.max("_p")).first()[0]
    if longest is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    size = max(size, math.isqrt(longest))
    ranks = spread.value_ranks(rows, key, "_v").select(*key, "_v", F.floor(F.col("n_less") / size).alias("_vb"))
    rows = cut(rows.withColumn("_db", F.floor(F.col("_p") / size)).join(ranks, key + ["_v"], "left"), "ranked")
    points = rows.filter("_v IS NOT NULL")
    keys_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key).schema)

    # values of each rank block before each block of rows
    ends = rows.groupBy(*key).agg(F.max("_db").alias("_a"), F.max("_vb").alias("_z")).filter("_z IS NOT NULL")
    grid = ends.select(*key, "_z", F.explode(F.sequence(F.lit(0).cast("bigint"), "_a")).alias("_db")).select(*key, "_db", F.explode(F.sequence(F.lit(0).cast("bigint"), "_z")).alias("_vb"))
    own = points.groupBy(*key, "_db", "_vb").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*key, "_vb").orderBy("_db").rowsBetween(W.unboundedPreceding, -1)
    before = grid.join(own, key + ["_db", "_vb"], "left").withColumn("_n", F.coalesce(F.sum(F.coalesce("_n", F.lit(0))).over(w), F.lit(0)))
    names = [f"_{i}" for i in range(len(key))]
    before = before.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col("_db").alias("_b"), "_vb", "_n")

    def places(rows, before):
        rows, before = rows.sort_values("_p"), before.sort_values("_vb")
        count = before["_n"].to_numpy(np.int64).copy()
        total, out = int(count.sum()), []
        for p, vb in zip(rows["_p"].tolist(), rows["_vb"].tolist()):
            known = vb is not None and vb == vb
            if known and inclusive:
                count[int(vb)] += 1
                total += 1
            if total:
                h, upto = q * (total - 1), np.cumsum(count)
                for side, k in enumerate((math.floor(h), math.ceil(h))):
                    at = int(np.searchsorted(upto, k, side="right"))
                    out.append((p, side, at, k - int(upto[at] - count[at]), h - math.floor(h)))
            if known and not inclusive:
                count[int(vb)] += 1
                total += 1
        t = pd.DataFrame(out, columns=["_p", "_side", "_vb", "_k", "_share"])
        for c in [*key, "_db"]:
            t[c] = rows[c].iloc[0] if len(rows) else None
        return t[[*key, "_db", "_p", "_side", "_vb", "_k", "_share"]]

    asked = rows.groupBy(*key, "_db").cogroup(before.groupBy(*names, "_b")).applyInPandas(
        places, keys_ddl + ", _db bigint, _p bigint, _side int, _vb bigint, _k bigint, _share double")
    asked = cut(asked, "asked")

    # search inside the pairs of blocks that are asked for
    pairs = asked.select(*key, "_db", "_vb").distinct()
    older = points.groupBy(*key, "_vb", "_v", F.col("_db").alias("_from")).agg(F.count(F.lit(1)).alias("_m"))
    older = older.join(pairs, key + ["_vb"]).filter("_from < _db").groupBy(*key, "_db", "_vb", "_v").agg(F.sum("_m").alias("_m"))
    none = lambda kind: F.lit(None).cast(kind)
    cols = [*key, "_db", "_vb"]
    task = older.select(*cols, none("bigint").alias("_p"), "_v", "_m", none("int").alias("_side"), none("bigint").alias("_k"), none("double").alias("_share"))
    task = task.unionByName(points.join(pairs, cols, "left_semi").select(*cols, "_p", "_v", F.lit(1).cast("bigint").alias("_m"), none("int").alias("_side"), none("bigint").alias("_k"), none("double").alias("_share")))
    task = task.unionByName(asked.select(*cols, "_p", none("double").alias("_v"), none("bigint").alias("_m"), "_side", "_k", "_share"))

    def search(t):
        asks = t["_side"].notna()
        values = np.unique(t.loc[~asks, "_v"].to_numpy())
        count = np.zeros(len(values), np.int64)
        old = t[t["_p"].isna()]
        np.add.at(count, np.searchsorted(values, old["_v"].to_numpy()), old["_m"].to_numpy(np.int64))
        new = t[t["_p"].notna()].assign(_turn=asks if inclusive else ~asks).sort_values(["_p", "_turn"], kind="stable")
        out = []
        for p, v, side, k, share in zip(new["_p"].tolist(), new["_v"].tolist(), new["_side"].tolist(), new["_k"].tolist(), new["_share"].tolist()):
            if side != side or side is None:
                count[np.searchsorted(values, v)] += 1
            else:
                out.append((int(p), int(side), values[np.searchsorted(np.cumsum(count), k, side="right")], share))
        r = pd.DataFrame(out, columns=["_p", "_side", "_x", "_share"])
        for c in key:
            r[c] = t[c].iloc[0]
        return r[[*key, "_p", "_side", "_x", "_share"]]

    found = task.groupBy(*cols).applyInPandas(search, keys_ddl + ", _p bigint, _side int, _x double, _share double")
    lo, hi = F.max(F.when(F.col("_side") == 0, F.col("_x"))), F.max(F.when(F.col("_side") == 1, F.col("_x")))
    found = found.groupBy(*key, "_p").agg((lo + (hi - lo) * F.max("_share")).alias(name))
    out = rows.select(*key, "_o", "_p").join(found, key + ["_p"], "left").select(*key, F.col("_o").alias(order), name)
    return df.join(out, key + [order], "left")
