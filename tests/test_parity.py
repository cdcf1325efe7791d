"""Registered queries against their SQL on DuckDB. TAPELINE_ALL=1 runs every query, otherwise a sample per family."""

import collections
import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = """src_01 src_03 src_08 src_09 src_15 prj_12 prj_21 cal_03 cal_06 jn_01 jn_02 jn_05 jn_14 jn_18 jn_23 bar_02 agg_02 agg_11 agg_20 agg_25 agg_28 agg_35
win_01 win_05 win_08 win_12 win_16 win_20 win_25 win_32 win_33 seq_02 seq_04 seq_05 seq_09 seq_10 seq_11 seq_19 seq_20 seq_27 seq_29 seq_31 top_06 set_05 set_06
stat_01 stat_05 stat_06 stat_08 stat_11 stat_14 stat_16 str_01 str_03 str_05 ml_01 ml_04_walk_forward_folds ml_07""".split()
ALL = [k for k in queries() if k in oracle_sql()]
KEYS = ALL if os.environ.get("TAPELINE_ALL") else [k for k in ALL if any(k.startswith(s) for s in SAMPLE)]


def norm(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET memory_limit='4GB'; SET max_temp_directory_size='1GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_same_rows(spark, sf, duck, key):
    df = queries()[key](spark, sf)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    cur = duck.execute(oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    ix = [names.index(c) for c in cols]
    want = collections.Counter(tuple(norm(r[i]) for i in ix) for r in cur.fetchall())
    assert got == want


def test_every_query_has_sql_but_two_models():
    own = {k for k in queries() if not k.startswith(("op", "pipeline"))}  # the text operators have tests of their own
    assert own - set(oracle_sql()) == {"ml_06_rolling_folds", "ml_08_batch_inference"}
