"""Stream jobs against their batch forms, with restarts and rows out of order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, health, quotes, routing, segments
from tidemark.sources import schemas
from tidemark.streaming import asof as stream_asof
from tidemark.streaming import heartbeats, jobs, routes
from tidemark.streaming import quotes as stream_quotes
from tidemark.streaming import segments as stream_segments

T0 = datetime(2024, 1, 1, 0, 0, 3)


@pytest.fixture()
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def fed(spark, folder, parts, schema, build):
    """Run a stream once per part: it stops after each and goes on from its checkpoint."""
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{folder}/in")
        build(spark.readStream.schema(schema).parquet(f"{folder}/in"))


def signals(seed):
    r = random.Random(seed)
    rows = []
    for i in range(400):
        at = T0 + timedelta(milliseconds=r.randrange(600_000))
        name = r.choice(health.SIGNALS)
        value = r.choice([None, "true", "false"]) if name.endswith(("_up", "_fallback")) else at.isoformat() if name.endswith("_at") else r.choice([None, f"e{i}"])
        value = r.choice([None, f'{{"market_id":"m{i}","slug":"s"}}']) if name == "market" else value
        rows.append((r.choice(["BTC", "ETH"]), name, at, str(i), value))
    rows += [("BTC", "quote_error", rows[5][2], "8", "first"), ("BTC", "quote_error", rows[5][2], "9", None), ("SOL", "quote_error", T0 + timedelta(seconds=31), None, "once")]
    return rows


@pytest.mark.parametrize("seed", [2])
def test_heartbeats_on_a_stream(spark, rocksdb, tmp_path, seed):
    rows, folder = signals(seed), f"file://{tmp_path}"
    # Parts overlap by less than the lateness; the second stop lies between two beats.
    cuts = [T0 + timedelta(seconds=s) for s in (0, 203, 407, 700)]
    late = random.Random(seed)
    at = [r[2] + timedelta(seconds=late.randrange(25)) for r in rows]
    parts = [[r for r, t in zip(rows, at) if a <= t < b] for a, b in zip(cuts, cuts[1:])]
    sink = lambda s: jobs.run_once(
        heartbeats.beats(s, every_seconds=10, lateness="30 seconds").writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), f"{folder}/state"
    )
    fed(spark, folder, parts, health.SIGNAL_ROWS, sink)
    told = spark.read.schema(heartbeats.BEATS).parquet(f"{folder}/out")
    got = {(r.asset, r.ts): r for r in health.heartbeats_told(told, output_dir="d").collect()}
    times = told.select("asset", F.col("at").alias("ts"))
    want = {(r.asset, r.ts): r for r in health.heartbeats(times, spark.createDataFrame(rows, health.SIGNAL_ROWS), output_dir="d").collect()}
    assert got == want
    end = max(r[2] for r in rows) - timedelta(seconds=30)
    for asset in ("BTC", "ETH", "SOL"):
        first = min(r[2] for r in rows if r[0] == asset)
        beats = sorted(r.at for r in told.where(F.col("asset") == asset).collect())
        assert len(beats) == len(set(beats)) and all((b - a).seconds == 10 for a, b in zip(beats, beats[1:]))
        assert first <= beats[0] < first + timedelta(seconds=10) and end - timedelta(seconds=10) < beats[-1] <= end


def test_heartbeat_by_hand(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    decisions = spark.createDataFrame(
        [("BTC", at(0), "1", 5, "m", "s", "t", "open", "a", "b"), ("BTC", at(20), "2", None, None, None, None, None, None, None)],
        "asset string, poll_ts timestamp, poll_id string, routing_score int, market_id string, slug string, title string, status string, start_time string, end_time string")
    ticks = spark.createDataFrame(
        [("BTC", at(1), "", "chainlink", "x", None, None), ("BTC", at(12), "", "chainlink", "x", "rtds_reconnect", "gone"), ("BTC", at(3), "", "binance", "binance_rest", None, None)],
        "asset string, at timestamp, seq string, family string, source string, warning string, error string")
    polls = spark.createDataFrame([("BTC", at(2), "1", True, "no=x"), ("BTC", at(8), "2", True, None), ("BTC", at(15), "3", False, "timeout")], "asset string, at timestamp, seq string, taken boolean, last_error string")
    all_of = health.route_signals(decisions).unionByName(health.tick_signals(ticks)).unionByName(health.quote_signals(polls))
    beats = spark.createDataFrame([("BTC", at(s)) for s in (-1, 5, 10, 25)], "asset string, ts timestamp")
    none, one, two, three = health.heartbeats(beats, all_of, output_dir="d").orderBy("ts").collect()
    assert none.active_market.market_id is None and none.freshness_seconds == (None, None, None, None) and none.transport_state == (False, None, False, False, None, None)
    assert one.active_market == ("m", "s", "t", "open", "a", "b") and one.freshness_seconds == (5.0, 4.0, 2.0, 3.0)
    assert one.transport_state == (True, None, True, True, None, "no=x")
    assert two.transport_state.quote_last_error is None and two.freshness_seconds.quotes == 2.0
    assert three.active_market.market_id is None and three.freshness_seconds == (5.0, 13.0, 22.0, 17.0)
    assert three.transport_state == (False, "gone", True, True, None, "timeout")


def seconds(s):
    return T0 + timedelta(seconds=s)


def body(i, tokens=True):
    more = ',"clobTokenIds":["y","n"],"outcomes":["Up","Down"]' if tokens else ""
    return f'{{"id":"m{i}","slug":"btc-updown-5m-{i}","startTime":"2024-01-01T00:00:00Z","endDate":"2024-01-01T00:05:00Z"{more}}}'


def response(poll, at, seq, text, expected=None):
    return (str(poll), seconds(at), "BTC", "slug", seq, "slug_exact_market_path", "s", "/markets/slug/s", {"a": "b"}, {}, 200, None, None, text, expected)


def test_polls_split_over_files(spark, rocksdb, tmp_path):
    """A poll that is told by its number of attempts, one by the watermark, one never."""
    folder, schema = f"file://{tmp_path}", f"{schemas.CATALOG_RESPONSES}, n_expected int"
    first = [response(1, 1, 0, "no json", 2), response(2, 5, 1, body(2)), response(3, 90, 0, body(3, tokens=False))]
    second = [response(1, 1, 1, body(1), 2), response(2, 5, 0, body(9)), response(4, 400, 0, body(4))]
    late = [response(2, 5, 2, body(7)), response(5, 401, 0, body(5), 1)]
    build = lambda s: routes.record_routes(s, f"{folder}/out", f"{folder}/state", lateness="2 minutes")
    fed(spark, folder, [first, second, late], schema, build)
    got = spark.read.parquet(f"{folder}/out/decisions")
    rows = spark.createDataFrame([r for r in first + second + late[1:] if r[0] != "4"], schema).drop("n_expected")
    want = routing.route(rows)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {(r.poll_id, r.market_id, r.n_ok) for r in got.collect()} == {("1", "m1", 1), ("2", "m9", 2), ("3", None, 1), ("5", None, 1)}


def test_routes_by_another_router(spark, rocksdb, tmp_path):
    folder, schema = f"file://{tmp_path}", f"{schemas.CATALOG_RESPONSES}, n_expected int"
    count = lambda rows: rows.groupBy("poll_id").count()
    fed(spark, folder, [[response(1, 1, 0, "x", 2), response(1, 1, 1, "x", 2)]], schema, lambda s: routes.record_routes(s, f"{folder}/out", f"{folder}/state", route=count))
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{folder}/out/decisions").collect()] == [("1", 2)]


@pytest.mark.parametrize("seed", [1])
def test_asof_of_streams(spark, rocksdb, tmp_path, seed):
    r, folder = random.Random(seed), f"file://{tmp_path}"
    schema = "side int, k string, ts timestamp, id int, v string"
    rows = [(r.randrange(2), r.choice("ab"), T0 + timedelta(milliseconds=r.randrange(0, 300_000, 250)), i, r.choice([None, f"v{i}"])) for i in range(300)]
    shift = [x[2] + timedelta(seconds=r.randrange(25)) for x in rows]
    cuts = [seconds(s) for s in (0, 100, 210, 400)]
    parts = [[x for x, t in zip(rows, shift) if a <= t < b] for a, b in zip(cuts, cuts[1:])]
    sides = lambda d: (d.where("side = 1").select("k", "ts", "id"), d.where("side = 0").select("k", "ts", "v", F.lpad(F.col("id").cast("string"), 4, "0").alias("tie")))

    def build(s):
        left, right = sides(s)
        told = stream_asof.asof_join(left, right, by=["k"], values=["v"], tie="tie", lateness="30 seconds")
        jobs.run_once(told.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), f"{folder}/state")

    fed(spark, folder, parts, schema, build)
    got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()), key=str)
    left, right = sides(spark.createDataFrame(rows, schema))
    end = max(x[2] for x in rows) - timedelta(seconds=31)
    want = sorted([tuple(x) for x in asof.asof_join(left, right, by=["k"], values=["v"], tie=["tie"]).collect()], key=str)
    assert [x for x in want if x[1] < end] == [x for x in got if x[1] < end] and len(got) >= len([x for x in want if x[1] < end]) > 100
    assert set(got) <= set(want) and len(set(got)) == len(got)


def test_quotes_paired_on_streams(spark, tmp_path):
    """A missing NO book gives a partial failure once the watermark has passed."""
    folder = f"file://{tmp_path}"
    polls = "poll_id string, poll_ts timestamp, asset string, market_id string, slug string, title string, condition_id string, token_yes string, token_no string, start_time string, end_time string, status string"
    book = '{"bids":[["0.4","1"]],"asks":[["0.5","1"]]}'
    poll = lambda i, at: (str(i), seconds(at), "BTC", f"m{i}", "s", "t", "c", f"y{i}", f"n{i}", "a", "b", "open")
    taken = lambda i, at, side: (str(i), seconds(at), "BTC", f"{side}{i}", 200, "https", None, None, book)
    parts = [([poll(1, 0), poll(2, 10), poll(3, 20)], [taken(1, 0, "y"), taken(1, 0, "n"), taken(2, 10, "y")]), ([poll(4, 30), poll(5, 31)], [taken(3, 20, "n"), taken(3, 20, "y"), taken(4, 30, "n")]),
             ([poll(9, 9_000)], [taken(9, 9_000, "y"), taken(9, 9_000, "n")])]
    for some, books in parts:
        spark.createDataFrame(some, polls).write.mode("append").parquet(f"{folder}/polls")
        spark.createDataFrame(books, schemas.BOOK_RESPONSES).write.mode("append").parquet(f"{folder}/books")
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{folder}/{name}")
        told = stream_quotes.sides(read("polls", polls), read("books", schemas.BOOK_RESPONSES), lateness="1 minute")
        jobs.run_once(told.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), f"{folder}/state")
    rows = stream_quotes.paired_sides(spark.read.schema(told.schema).parquet(f"{folder}/out"))
    got = {r.poll_id: r.quote_capture_status for r in rows.collect() if r.poll_id != "9"}
    assert got == {"1": "ok", "2": "partial_failure", "3": "ok", "4": "partial_failure", "5": "failed"}
    every = quotes.quote_rows(spark.createDataFrame([x for p, _ in parts for x in p], polls), quotes.snapshots(spark.createDataFrame([x for _, b in parts for x in b], schemas.BOOK_RESPONSES)))
    assert got == {r.poll_id: r.quote_capture_status for r in every.collect() if r.poll_id != "9"}


def test_segments_close_on_streams(spark, rocksdb, tmp_path):
    folder, schema = f"file://{tmp_path}", "asset string, at timestamp, family string"
    row = lambda minute, family="binance", asset="BTC": (asset, seconds(60 * minute), family)
    # Hour 1 is skipped; a row of hour 0 comes late; the stream stops within hour 2.
    parts = [[row(0), row(59), row(10, "chainlink"), row(3, asset="ETH")], [row(130), row(58), row(131, "quotes")], [row(190), row(65, asset="ETH")], [row(215)]]
    build = lambda s: jobs.run_once(
        stream_segments.closed_segments(s, lateness="5 minutes").writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), f"{folder}/state")
    fed(spark, folder, parts[:2], schema, build)
    assert spark.read.schema(stream_segments.CLOSED).parquet(f"{folder}/out").count() == 1
    fed(spark, folder, parts[2:], schema, build)
    told = segments.manifests_told(spark.read.schema(stream_segments.CLOSED).parquet(f"{folder}/out"), output_root="r")
    got = {(r.asset, r.segment_start_utc[11:13], r.segment_end_utc[11:13], r.row_counts["binance.jsonl"], r.row_counts["chainlink.jsonl"], r.row_counts["quotes.jsonl"]) for r in told.collect()}
    assert got == {("BTC", "00", "02", 3, 1, 0), ("BTC", "02", "03", 1, 0, 1)}
    assert told.count() == 2 and set(told.first().row_counts) == {f"{f}.jsonl" for f in ("chainlink", "binance", "quotes", "meta", "heartbeat")}


def test_changes_over_batches(spark, tmp_path):
    folder = f"file://{tmp_path}"
    schema = "poll_id string, poll_ts timestamp, asset string, routing_score int, " + ", ".join(f"{c} string" for c in routing.IDENTITY)
    r = random.Random(1)
    rows = []
    for i in range(120):
        market = r.choice([None, "m1", "m2"])
        rows.append((f"{i:03}", seconds(600 * i), r.choice(["BTC", "ETH", None]), None if market is None else i, market, *[None if market is None else "x"] * 6))
    build = lambda s: jobs.route_changes(s, f"{folder}/out", f"{folder}/state")
    fed(spark, folder, [rows[:50], rows[50:53], rows[53:]], schema, build)
    got = sorted((x.poll_id, x.market_changed) for x in spark.read.parquet(f"{folder}/out/rows").collect())
    assert got == sorted((x.poll_id, x.market_changed) for x in routing.route_rows(spark.createDataFrame(rows, schema)).collect())


def test_recorded_sides_are_told_once(spark, tmp_path):
    """As the join of streams tells them: books before and after their poll, late and
    doubled ones, a side without a book, rows behind the watermark, with restarts."""
    folder = f"file://{tmp_path}"
    polls = "poll_id string, poll_ts timestamp, asset string, market_id string, slug string, title string, condition_id string, token_yes string, token_no string, start_time string, end_time string, status string"
    book = '{"bids":[["0.4","1"]],"asks":[["0.5","1"]]}'
    poll = lambda i, at: (str(i), seconds(at), "BTC", f"m{i}", "s", "t", "c", f"y{i}", f"n{i}", "a", "b", "open")
    taken = lambda i, at, side: (str(i), seconds(at), "BTC", f"{side}{i}", 200, "https", None, None, book)
    parts = [([poll(1, 0), poll(2, 10), poll(3, 20)], [taken(1, 60, "y"), taken(1, 61, "n"), taken(2, 10, "y"), taken(4, 29, "y")]),
             ([poll(4, 30), poll(5, 31)], [taken(3, 20, "n"), taken(3, 20, "y"), taken(1, 0, "y"), taken(4, 30, "n")]),
             ([poll(9, 9_000)], [taken(9, 9_000, "y")]), ([poll(6, 40)], [taken(6, 40, "y"), taken(6, 40, "n"), taken(9, 9_001, "n")])]
    for some, books in parts:
        spark.createDataFrame(some, polls).write.mode("append").parquet(f"{folder}/polls")
        spark.createDataFrame(books, schemas.BOOK_RESPONSES).write.mode("append").parquet(f"{folder}/books")
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{folder}/{name}")
        stream_quotes.record_sides(read("polls", polls), read("books", schemas.BOOK_RESPONSES), f"{folder}/out", f"{folder}/state", lateness_seconds=60)
    told = spark.read.parquet(f"{folder}/out/rows")
    sides = sorted((r.poll_id, r.side, r.snapshot is not None) for r in told.collect())
    with_book = [("1", "yes"), ("2", "yes"), ("3", "no"), ("3", "yes"), ("4", "no"), ("4", "yes"), ("9", "no"), ("9", "yes")]
    without = [("1", "no"), ("2", "no"), ("5", "no"), ("5", "yes")]
    assert sides == sorted([(*x, True) for x in with_book] + [(*x, False) for x in without])
    got = {r.poll_id: r.quote_capture_status for r in stream_quotes.paired_sides(told).collect()}
    assert got == {"1": "partial_failure", "2": "partial_failure", "3": "ok", "4": "ok", "5": "failed", "9": "ok"}


def test_polls_leave_once_and_without_a_state(spark, tmp_path):
    """A batch's polls are counted as a table: rows after their poll has left, behind the
    watermark or without a time are dropped, through restarts and a batch run again."""
    folder, schema = f"file://{tmp_path}", f"{schemas.CATALOG_RESPONSES}, n_expected int"
    untimed = (*response(9, 0, 0, body(9), 1)[:1], None, *response(9, 0, 0, body(9), 1)[2:])
    parts = [[response(1, 1, 0, "x", 2), response(2, 300, 0, "x", 2), response(2, 300, 1, "x", 2), response(3, 290, 0, "x", 3), untimed], [response(2, 300, 2, "x", 2), response(3, 290, 1, "x", 3), response(1, 1, 1, "x", 2)],
             [response(2, 300, 3, "x", 2), response(3, 290, 2, "x", 3), response(5, 340, 0, "x")], [response(2, 300, 4, "x", 1), response(6, 900, 0, "x", 1)]]
    count = lambda rows: rows.groupBy("poll_id").count()
    build = lambda s: routes.record_routes(s, f"{folder}/out", f"{folder}/state", lateness="1 minute", route=count)
    fed(spark, folder, parts, schema, build)
    want = [("1", 1, 0), ("2", 2, 0), ("3", 3, 2), ("5", 1, 3), ("6", 1, 3)]
    told = lambda: sorted((r.poll_id, r["count"], r.batch) for r in spark.read.parquet(f"{folder}/out/decisions").collect())
    assert told() == want
    assert not (tmp_path / "state" / "state").exists()
    (tmp_path / "state" / "commits" / "3").unlink()
    (tmp_path / "state" / "commits" / ".3.crc").unlink(missing_ok=True)
    build(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    assert told() == want
