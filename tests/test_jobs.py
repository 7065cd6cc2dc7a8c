from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.config import BTC, ETH, Settings
from tidemark.operators import asof, diagnostics, health, quotes, results, routing, segments, ticks
from tidemark.sources import schemas, store

NOW = datetime(2026, 4, 20, 12, 3)


def frames(spark, rows):
    full = [(f, NOW, raw, event, error, None) for f, raw, event, error in rows]
    return spark.createDataFrame(full, schemas.RAW_FRAMES)


def test_chainlink_frames(spark):
    rows = [
        ('{"topic":"crypto_prices_chainlink","type":"update","payload":{"symbol":"btc/usd","value":1.5,"full_accuracy_value":"15","timestamp":1713470400123}}'),
        ('{"topic":"crypto_prices","type":"subscribe","payload":{"symbol":"btc/usd","data":[{"value":1,"timestamp":1},{"value":"2","timestamp":1713470400}]}}'),
        "", "hello", '[{"price":"2"}]', '{"foo":1}', '{"payload":{"data":[{"value":3},7]},"symbol":"x"}',
    ]
    table = frames(spark, [("chainlink", r, None, None) for r in rows] + [("chainlink", None, "rtds_reconnect", "gone")])
    got = {r.raw_payload_fragment: r for r in ticks.chainlink_rows(table).collect()}
    live = got[rows[0]]
    assert (live.record_type, live.price, live.message_family, live.source_ts) == ("tick", 1.5, "live_update", "2024-04-18T20:00:00.123000+00:00")
    assert (got[rows[1]].price, got[rows[1]].message_family) == (2.0, "snapshot_subscribe")
    assert (got[""].record_type, got[""].symbol) == ("keepalive", None)
    assert (got["hello"].warning, got["hello"].symbol) == ("non_json_message", "BTC/USD")
    assert (got[rows[4]].price, got[rows[4]].message_family, got[rows[4]].topic) == (2.0, "unknown", None)
    assert got[rows[5]].warning == "unparsed_chainlink_payload"
    assert (got[rows[6]].price, got[rows[6]].message_family, got[rows[6]].symbol) == (3.0, "unknown", "x")
    event = got['{"url":null}']
    assert (event.warning, event.error, event.received_ts) == ("rtds_reconnect", "gone", None)
    assert ticks.without_keepalives(ticks.chainlink_rows(table)).count() == 7


def test_binance_frames(spark):
    rows = ['{"p":"1.5","E":1713470400123}', '{"p":"x"}', "7", '{"p":0,"price":"2"}']
    table = frames(spark, [("binance_ws", r, None, None) for r in rows] + [("binance_rest", '{"price":"3"}', None, None), ("binance_rest", "{}", None, None)])
    got = sorted((r.source, r.record_type, r.price, r.observed_at, r.warning) for r in ticks.binance_rows(table).collect() if r.price or r.warning)
    assert sorted(got, key=str) == sorted([
        ("binance_ws", "tick", 1.5, "1713470400123", None), ("binance_ws", "warning", None, None, "unparsed_binance_payload"),
        ("binance_ws", "warning", None, None, "non_json_message"), ("binance_ws", "tick", 2.0, None, None),
        ("binance_rest", "tick", 3.0, None, None), ("binance_rest", "warning", None, None, "rest_poll_failed")], key=str)


def book(spark, *bodies, status=200):
    rows = [(str(i), NOW, "BTC", f"t{i}", status, "https", None, None, b) for i, b in enumerate(bodies)]
    return quotes.snapshots(spark.createDataFrame(rows, schemas.BOOK_RESPONSES)).orderBy("poll_id").collect()


def test_snapshots(spark):
    plain, wrapped, empty, bad, crossed, zero, text, listed, nan = book(
        spark,
        '{"bids":[{"price":"0.41","size":"12"}],"asks":[{"price":"0.43","size":"9"}]}',
        '{"book":{"bids":[["0.4","1"]],"asks":[]}}', '{"bids":[],"asks":[]}', '{"bids":[["0.4","1"]],"asks":[["x","1"]]}',
        '{"bids":[["0.6",1]],"asks":[["0.5",1]]}', '{"bids":[{"price":0,"size":1}],"asks":[["0.5",1]]}', '"x"', "[1]", '{"bids":[["nan",1]],"asks":[["0.5",1]]}')
    assert (plain.best_bid, plain.ask_size, round(plain.mid, 9), round(plain.spread, 9), plain.fetch_ok) == (0.41, 9.0, 0.42, 0.02, True)
    assert (wrapped.best_bid, wrapped.best_ask, wrapped.mid, wrapped.fetch_ok) == (0.4, None, None, True)
    assert (empty.is_empty, empty.fetch_ok, empty.error_kind) == (True, False, None)
    assert (bad.best_bid, bad.best_ask, bad.error_kind, bad.is_empty) == (None, None, "parse_failure", True)
    assert crossed.is_crossed and not nan.is_crossed
    assert (zero.best_bid, zero.best_ask) == (None, 0.5)  # the number 0 counts as absent, the text "0" would not
    assert text.error == listed.error == "non-dict-orderbook"
    denied, = book(spark, "no", status=403)
    assert (denied.error_kind, denied.error, denied.fetch_ok) == ("http_failure", "HTTP 403", False)


def test_quote_rows_and_errors(spark):
    poll = [("p", NOW, "BTC", "m", "s", "t", "c", "y", "n", "a", "b", "open")]
    polls = spark.createDataFrame(poll, "poll_id string, poll_ts timestamp, asset string, market_id string, slug string, title string, condition_id string, token_yes string, token_no string, start_time string, end_time string, status string")
    rows = [("p", NOW, "BTC", t, s, "https", None, None, '{"bids":[["1",1]],"asks":[["2",1]]}') for t, s in (("y", 200), ("n", 403))]
    taken = quotes.snapshots(spark.createDataFrame(rows, schemas.BOOK_RESPONSES))
    got = quotes.quote_errors(quotes.quote_rows(polls, taken)).first()
    assert (got.quote_capture_status, got.quote_capture_ok, got.yes.mid, got.last_error) == ("partial_failure", True, 1.5, "partial_quote_failure yes=ok no=http_failure")
    got = quotes.quote_errors(quotes.quote_rows(polls, taken.where("token_id = 'n'"))).first()
    assert (got.quote_capture_status, got.last_error) == ("failed", "yes=unknown; no=http_failure")
    assert quotes.quote_warnings(polls.withColumn("token_no", F.lit(""))).first().warning == "no_active_market_for_quote_poll"


def catalog(spark, *payloads, phase="slug"):
    rows = [("p", NOW, "BTC", phase, i, "src", "s", "/markets/slug/s", {}, {"A": "b"}, 200, None, None, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, schemas.CATALOG_RESPONSES)


def market(slug="btc-updown-5m-1", start=-60, end=240, tokens=True, **more):
    import json

    stamp = lambda s: (NOW + timedelta(seconds=s)).isoformat() + "Z"
    body = {"id": slug, "slug": slug, "eventStartTime": stamp(start), "endDate": stamp(end), "active": True} | more
    if tokens:
        body |= {"outcomes": '["Up","Down"]', "clobTokenIds": ["y", "n"]}
    return json.dumps(body)


def test_candidates_from_nested_payloads(spark):
    rows = catalog(spark, '{"markets":[' + market() + '],"slug":"top"}', '{"events":[{"market":' + market("x") + "}]}", "[" + market() + "]",
                   '{"id":"k","tokens":[{"id":"a","side":"yes"},{"tokenId":"b","name":"Down"},{"side":"no"}]}', '{"id":"f","yesTokenId":1,"noTokenId":"2"}')
    got = {(r.attempt_seq, r.market_id): r for r in routing.normalized(rows).collect()}
    assert got[0, "btc-updown-5m-1"].token_yes == "y" and got[0, "btc-updown-5m-1"].status == "open"
    assert (0, None) in got and got[0, None].slug == "top"
    assert (1, "x") in got and not any(k[0] == 2 for k in got)
    assert (got[3, "k"].token_yes, got[3, "k"].token_no) == ("a", "b")
    assert (got[4, "f"].token_yes, got[4, "f"].token_no) == ("1", "2")
    assert any(k[0] == 2 for k in ((r.attempt_seq, 0) for r in routing.normalized(rows, expand_lists=True).collect()))


def test_waterfall_score_and_selection(spark):
    rows = catalog(
        spark, market("btc-updown-5m-9", 600, 900), market("btc-updown-5m-2"), market("btc-updown-5m-3", closed=True, active=False), market("other"),
        market("btc-updown-5m-4", tokens=False), market("btc-updown-5m-5", 100, 50), market("btc-updown-5m-6", -900, -600), market("btc-updown-5m-7", -60, 840))
    judged = routing.judged(routing.deduped(routing.normalized(rows)))
    why = {r.market_id[-1]: (r.exclusion, r.score) for r in judged.collect()}
    assert why["2"] == (None, 0) and why["3"] == (None, 1000) and why["9"] == (None, 600 + 1000) and why["7"] == (None, 600)
    assert why["r"] == ("not_in_family", 5000) and why["4"] == ("missing_tokens", 7500)
    assert why["5"] == ("missing_market_window", 40000) and why["6"] == ("outside_relevant_window", 35000)
    total = routing.waterfall(judged).first()
    assert (total.normalized_total, total.family_match, total.time_relevant, total.token_complete) == (8, 6, 5, 4)
    best = routing.route(rows).first()
    assert (best.market_id, best.routing_score, best.selection_mode) == ("btc-updown-5m-2", 0, "active")
    assert best.routing_reason.startswith("active; duration_off_seconds=0; timing_penalty=0;")


def test_dedupe_runs_before_the_filter(spark):
    rows = catalog(spark, market(tokens=False), market())
    assert routing.route(rows).first().routing_reason == "rows_returned_but_filtered_out"


def test_broad_phase_counts_only_without_a_slug_hit(spark):
    slug, broad = catalog(spark, market("btc-updown-5m-1")), catalog(spark, market("btc-updown-5m-2", -60, 240), phase="broad")
    assert routing.combined(routing.normalized(slug.union(broad))).count() == 1
    assert routing.combined(routing.normalized(catalog(spark, market(tokens=False)).union(broad))).count() == 2


def test_failures(spark):
    bad = catalog(spark, "<html>").withColumn("http_status", F.lit(500))
    assert routing.route(bad).first().routing_reason == "gamma_http_failure"
    assert routing.route(catalog(spark, "{}")).first().routing_reason == "no_candidates_found"
    kinds = diagnostics.classified(bad, book=False).select("error_kind", "error_text").first()
    assert tuple(kinds) == ("http_failure", "HTTP 500")


def test_slugs_and_family(spark):
    polls = spark.createDataFrame([("p", datetime(2026, 4, 20, 12, 3), "ETH")], "poll_id string, poll_ts timestamp, asset string")
    slugs = [r.slug for r in routing.candidate_slugs(polls).orderBy("attempt_seq").select("slug").distinct().collect()]
    base = 1776686400
    assert sorted(slugs) == [f"eth-updown-5m-{base + o}" for o in (-300, 0, 300, 600)]
    rows = [("ETH", "eth-updown-5m-1", ""), ("ETH", "x", "Ethereum 5 minute"), ("ETH", "x", "Bitcoin 5 minute"), ("BTC", "x", "BTC 15m")]
    table = routing.with_profile(spark.createDataFrame(rows, "asset string, slug string, title string"), (BTC, ETH))
    got = {(r.asset, r.slug, r.title): r.f for r in table.withColumn("f", routing.in_family()).collect()}
    assert [got[r] for r in rows] == [True, True, False, True]
    assert Settings(upcoming_seconds=1).upcoming_seconds == 300


def test_changes_ignore_score(spark):
    cols = "poll_id string, poll_ts timestamp, asset string, market_id string, slug string, condition_id string, token_yes string, token_no string, start_time string, end_time string, routing_score int"
    one = lambda i, m, s: (str(i), NOW + timedelta(seconds=i), "BTC", m, "s", "c", "y", "n", "a", "b", s)
    rows = [one(1, None, None), one(2, "m1", 5), one(3, "m1", 9), one(4, "m2", 5), one(5, None, None)]
    got = routing.route_rows(spark.createDataFrame(rows, cols)).orderBy("poll_id").collect()
    assert [r.market_changed for r in got] == [False, True, False, True, True]


def test_asof_equals_brute_force(spark):
    import random

    r = random.Random(3)
    at = lambda: NOW + timedelta(seconds=r.randrange(0, 20_000))
    left = [(i, r.choice("ab"), at()) for i in range(120)] + [(900, "a", None), (901, None, NOW), (902, "z", NOW)]
    right = [(r.choice("ab"), at(), r.choice([None, j])) for j in range(60)]
    got = asof.asof_join(
        spark.createDataFrame(left, "id int, k string, ts timestamp"), spark.createDataFrame(right, "k string, ts timestamp, v int"),
        by=["k"], values=["v"], tie=["v"], tolerance_seconds=4000.0, slice_seconds=600).collect()
    assert len(got) == len(left)
    for row in got:
        before = [x for x in right if x[0] == row.k and row.ts and x[1] <= row.ts]
        best = max(before, key=lambda x: (x[1], x[2] is not None, x[2] or 0), default=None)
        if best is None or (row.ts - best[1]).total_seconds() > 4000:
            assert (row.asof_ts, row.v) == (None, None)
        else:
            assert row.asof_ts == best[1] and (row.v == best[2])


def test_interval_join_equals_brute_force(spark):
    import random

    r = random.Random(5)
    instants = [(i, "a", NOW + timedelta(seconds=r.randrange(0, 300_000))) for i in range(60)]
    spans = [(f"m{j}", "a", NOW + timedelta(seconds=(s := r.randrange(0, 300_000))), NOW + timedelta(seconds=s + r.choice([300, 600, 200_000]))) for j in range(40)]
    got = asof.interval_join(spark.createDataFrame(instants, "id int, asset string, at timestamp"), spark.createDataFrame(spans, "m string, asset string, start timestamp, end timestamp"),
                             by=["asset"], ts="at", start="start", end="end", lead_seconds=1800)
    want = {(i, m) for i, _, t in instants for m, _, s, e in spans if s - timedelta(seconds=1800) <= t < e}
    rows = [(x.id, x.m) for x in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_health(spark):
    at = spark.createDataFrame([(1, NOW)], "id int, ts timestamp")
    events = spark.createDataFrame([("binance", NOW - timedelta(seconds=7)), ("binance", NOW + timedelta(seconds=1))], "feed string, ts timestamp")
    row = health.freshness(at, events).first()
    assert (row.binance_seconds, row.router_seconds) == (7.0, None)
    assert health.beats(NOW, NOW + timedelta(seconds=20), spark).count() == 5
    errors = spark.createDataFrame([("a", NOW - timedelta(seconds=9), "bad"), ("b", NOW - timedelta(seconds=2), None)], "poll_id string, poll_ts timestamp, last_error string")
    assert health.last_quote_error(at, errors).first().quote_last_error is None
    assert health.last_quote_error(at, errors.where("poll_id = 'a'")).first().quote_last_error == "bad"


def test_segments_rotate_on_the_hour_and_round_trip(spark, tmp_path):
    rows = [("2026-04-20T10:59:59+00:00", "quote_snapshot", None), ("2026-04-20T11:00:00+00:00", "quote_snapshot", "m")]
    table = spark.createDataFrame(rows, "ts string, record_type string, market_id string")
    store.write_segments(table, str(tmp_path), "quotes")
    back = store.read_segments(spark, str(tmp_path), "quotes").withColumn("family", F.lit("quotes"))
    assert sorted((r.ts, r.market_id, r.segment_hour) for r in back.collect()) == [(rows[0][0], None, "10"), (rows[1][0], "m", "11")]
    first, = segments.manifests(back).collect()
    assert (first.segment_start_utc, first.segment_end_utc, first.row_counts["quotes.jsonl"], first.row_counts["meta.jsonl"]) == (
        "2026-04-20T10:00:00+00:00", "2026-04-20T11:00:00+00:00", 1, 0)
    states = {r.segment_hour: r.state for r in segments.catalogue(back, segments.manifests(back)).collect()}
    assert states == {"10": "closed", "11": "active"}
    closed = segments.manifests(back, closed_at=F.lit(datetime(2026, 4, 20, 11, 59, 59)))
    store.write_manifests(closed, str(tmp_path))
    assert store.read_manifests(spark, str(tmp_path)).count() == 2
    assert segments.latest_closed(closed).first().segment_end_utc == "2026-04-20T11:59:59+00:00"


def test_jobs_take_empty_tables(spark):
    none = spark.createDataFrame([], schemas.CATALOG_RESPONSES)
    assert routing.route(none).count() == 0
    assert ticks.all_ticks(spark.createDataFrame([], schemas.RAW_FRAMES)).count() == 0
    assert quotes.snapshots(spark.createDataFrame([], schemas.BOOK_RESPONSES)).count() == 0


def test_asof_with_bounds_from_the_data(spark):
    """A hundred times as many rows in one hour: slices follow the rows."""
    import random

    r = random.Random(3)
    at = lambda: NOW + timedelta(seconds=r.randrange(3600)) if r.random() < 0.99 else NOW + timedelta(hours=r.randrange(1, 100))
    events = [(at(), i, None if i % 7 == 0 else i) for i in range(3000)]
    asks = [(i, r.choice([at(), events[i][0]])) for i in range(400)] + [(-1, None), (-2, NOW - timedelta(days=1))]
    right = spark.createDataFrame(events, "ts timestamp, seq int, v int").withColumn("k", F.lit("a"))
    left = spark.createDataFrame(asks, "id int, ts timestamp").withColumn("k", F.lit("a"))
    bounds = asof.slice_bounds(right, "ts", 37)
    assert len(bounds) > 30
    slots = right.select(asof._slot_by(bounds)("ts").alias("s")).groupBy("s").count().collect()
    assert len(slots) == len(bounds) + 1 and max(x["count"] for x in slots) < 3000 // 15
    got = {x.id: (x.asof_ts, x.v) for x in asof.asof_join(left, right, by=["k"], values=["v"], tie=["seq"], bounds=bounds).collect()}
    for i, t in asks:
        seen = max((e for e in events if t is not None and e[0] <= t), default=(None, None, None))
        assert got[i] == (seen[0], seen[2]), i


def test_whole_results_keep_few_samples(spark):
    many = [market(slug=f"btc-updown-5m-{i}", id=f"m{i}", tokens=i % 2 == 0) for i in range(25)]
    responses = catalog(spark, *many)
    (row,) = results.route_results(responses).collect()
    d = row.diagnostics
    assert row.market.market_id == "m0" and row.routing_reason.startswith("active") and d.selection_summary.selected_market_id == "m0"
    assert [x.attempt_seq for x in d.request_diagnostics] == list(range(25)) and d.request_diagnostics[3].normalization_result.extracted_candidate_count == 1
    assert d.slug_phase_summary.normalized_candidate_count == 25 and d.slug_phase_summary.filtered_candidate_count == 13 and not d.broad_phase_summary.attempted
    samples = d.combined_filter_summary.samples
    assert [x.slug[-2:] for x in samples.normalized] == [f"-{i}" for i in range(8)] and len(samples.final_candidates) == 8 == len(samples.excluded.missing_tokens)
    assert d.combined_filter_summary.exclusion_counts.missing_tokens == 12 and len(d.candidate_slugs_attempted) == 4


def test_segments_are_listed_without_reading_them(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([("2024-01-01T10:59:59+00:00", 1), ("2024-01-01T11:00:00+00:00", 2)], "ts string, value int")
    for family in ("quotes", "meta"):
        store.write_segments(rows, root, family)
    for path in tmp_path.rglob("part-*"):
        path.write_bytes(b"\0not json")  # what the files hold does not matter
    got = store.list_segments(spark, root)
    assert {(r.family, r.segment_date, r.segment_hour) for r in got.collect()} == {(f, "2024-01-01", h) for f in ("quotes", "meta") for h in ("10", "11")}
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()
