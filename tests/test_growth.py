"""What large tables need: costly readings run once a row, and little is moved."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators import health, quotes, results, routing, segments
from tidemark.plans import adapters, queries
from tidemark.sources import schemas
from tidemark.sources.workdir import stored
from tidemark.streaming import heartbeats

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
POLLS = "poll_id string, poll_ts timestamp, asset string, market_id string, slug string, title string, condition_id string, token_yes string, token_no string, start_time string, end_time string, status string"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def books(spark, bodies):
    rows = [("1", None, "BTC", str(i), 200, "https", None, None, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, schemas.BOOK_RESPONSES)


def test_filter_reads_books_once(spark):
    taken = quotes.snapshots(books(spark, ["{}"]))
    assert optimized(taken.where("is_crossed")).count("variant_get") <= optimized(taken).count("variant_get")


def test_quote_rows_read_books_once(spark):
    rows = quotes.quote_rows(spark.createDataFrame([], POLLS), quotes.snapshots(books(spark, ["{}"])))
    assert optimized(rows).count("Generate inline") == optimized(quotes.snapshots(books(spark, ["{}"]))).count("Generate inline")


def test_book_levels(spark):
    """Levels read by path and by the general way: texts, numbers, zeros, odd members."""
    want = {
        '{"bids":[{"price":"0.4","size":2}],"asks":[["0.5",1.5]]}': (0.4, 2.0, 0.5, 1.5, None),
        '{"bids":[{"p":"1_0","q":" 2 "}],"asks":[[true,"1e1"]]}': (10.0, 2.0, 1.0, 10.0, None),
        '{"bids":[{"price":0,"p":7,"size":1}],"asks":[{"price":"0","size":"0.0"}]}': (7.0, 1.0, 0.0, 0.0, None),
        '{"data":{"bids":[["x",1]],"asks":[["2","1"]]}}': (None, None, None, None, "could not convert a level to numbers"),
        '{"bids":"none","asks":[]}': (None, None, None, None, "could not convert a level to numbers"),
        '{"book":null,"orderbook":{"bids":[[1]],"asks":[null,["2","1"]]},"bids":[["1","1"]]}': (None, None, None, None, None),
        '{"bids":0,"asks":[["3",null]]}': (None, None, None, None, "could not convert a level to numbers"),
        "[1]": (None, None, None, None, "non-dict-orderbook"),
    }
    got = quotes.snapshots(books(spark, list(want))).orderBy("token_id").collect()
    assert [(r.best_bid, r.bid_size, r.best_ask, r.ask_size, r.error) for r in got] == list(want.values())


@given
def test_responses_move_ids_not_bodies(spark):
    plan = optimized(adapters.catalog_responses(spark, SF))
    assert plan.index("eventStartTime") < plan.index("Join")


@given
def test_route_reads_responses_once(spark, monkeypatch):
    """Bodies are parsed in what route() stores, and not again in what goes on from there."""
    kept = []
    monkeypatch.setattr(routing, "stored", lambda df, label: kept.append(df) or stored(df, label))
    got = routing.route(adapters.catalog_responses(spark, SF))
    files = got.inputFiles()
    assert len(kept) == 1 and files and all("candidates" in f for f in files)


def test_beats_reduce_parts(spark):
    """A task sends on the last row of a beat and signal, of several parts."""
    pd = pytest.importorskip("pandas")
    part = lambda *rows: pd.DataFrame(rows, columns=["asset", "signal", "seq", "value", "us"])
    parts = [part(("B", "x", "1", "a", 5), ("B", "x", "2", "b", 5), ("B", "y", None, "c", 1)), part(("B", "x", None, "d", 4), ("B", "x", "1", "e", 10_000_001))]
    got = pd.concat(list(heartbeats.latest_of_parts(10)(iter(parts))))
    assert sorted(got["value"]) == ["b", "c", "e"]


def test_tick_signals_read_ticks_once(spark):
    rows = spark.createDataFrame([], "asset string, at timestamp, seq string, family string, source string, warning string, error string")
    assert optimized(health.tick_signals(rows)).count("Union") == 0


def test_tick_values_by_path_as_the_general_way(spark):
    """Plain members are read by paths; odd ones give what the general reading gives."""
    bodies = ['{"value":"1.5","timestamp":1700000000}', '{"value":"1_0","timestamp":"1700000000123"}', '{"value":0,"timestamp":0,"ts":5}', '{"value":[2],"timestamp":1.7e9}', '{"price":"-3","timestamp":"x"}',
              '{"value":true,"time":99999999999999999}', '{"value":"none","answer":" 7 ","timestamp":999999999999999}', "[4]", "5", '{"value":null,"timestamp":10000000000}', '{"timestamp":"0012","value":{"price":8}}', None]
    v, keys, times = F.col("v"), ("value", "price", "answer"), ("timestamp", "ts", "time")
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select(E.parse(F.col("b")).alias("v")).select(
        F.struct(E.quick_find(v, keys), E.quick_number(v, "value"), E.quick_source_time(v, *times)).alias("quick"),
        F.struct(E.find_numeric(v, keys), E.number(E.get(v, "value")), E.source_time(E.first_truthy(*[E.get(v, k) for k in times]))).alias("whole"))
    rows = got.collect()
    assert [tuple(r.quick) for r in rows] == [tuple(r.whole) for r in rows] and rows[0].quick[0] == 1.5


def test_dates_of_a_column(spark):
    texts = ["2024-01-01T00:00:00+00:00", " 2024-01-01T00:00:00Z ", "2024-13-01T00:00:00Z", "20240101T101500", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(E.datetime_of(F.col("s")).alias("a"), E.parse_datetime(F.col("s")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a is not None


def test_catalogue_reads_segments_once(spark):
    """Segments and manifests come together in one join, whatever their state."""
    found = spark.createDataFrame([("d", h) for h in ("01", "02", "03", "04", "04")], "segment_date string, segment_hour string")
    told = spark.createDataFrame([("d", "02", "x")], "segment_date string, segment_hour string, segment_end_utc string")
    got = segments.catalogue(found, told)
    assert sorted((r.segment_hour, r.state, r.segment_end_utc) for r in got.collect()) == [("01", "orphaned", None), ("02", "closed", "x"), ("03", "orphaned", None), ("04", "active", None)]
    assert optimized(got).count("Join") == 1


@given
def test_segment_catalog_reads_ticks_once(spark):
    files = queries.segment_catalog(spark, SF).inputFiles()
    assert files and all("segmented" in f for f in files)


@given
def test_route_results_work_out_responses_once(spark):
    files = results.route_results(adapters.catalog_responses(spark, SF)).inputFiles()
    assert files and not any("events.parquet" in f for f in files)
