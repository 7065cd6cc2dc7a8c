"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float("%.9g" % v)
    return v


def rows(cols, names, data):
    at = [names.index(c) for c in cols]
    return sorted((tuple(plain(r[i]) for i in at) for r in data), key=str)


@pytest.mark.parametrize("name", ["ticks_chainlink", "transport_events", "ticks_deep", "candidates_deep", "quote_errors", "routed_market", "latest_quote_asof", "heartbeat_freshness", "segment_catalog", "manifest_roundtrip", "heartbeat_cadence", "quote_poll_failures", "jsonl_roundtrip", "hourly_counts_stream"])
def test_query_matches_sql(spark, base, name):
    df = queries.queries()[name](spark, SF)
    got = rows(sorted(df.columns), df.columns, [tuple(r) for r in df.collect()])
    cur = base.execute(oracles.oracle_sql()[name])
    want = rows(sorted(df.columns), [d[0] for d in cur.description], cur.fetchall())
    assert got and got == want


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())
