"""Registered queries over the recorder's jobs."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import diagnostics, health, quotes, results, routing, segments, ticks
from ..sources import schemas, store
from ..sources.workdir import new_folder, stored
from ..streaming import heartbeats, jobs, routes
from ..streaming import quotes as quote_streams
from ..streaming import segments as segment_streams
from . import adapters as A

TICK = ["ts", "record_type", "source", "symbol", "price", "warning"]


def ticks_binance(spark, sf_dir):
    return ticks.binance_rows(A.raw_frames(spark, sf_dir)).where("source = 'binance_ws'").select(*TICK, "observed_at")


def ticks_rest(spark, sf_dir):
    return ticks.binance_rows(A.raw_frames(spark, sf_dir)).where("source = 'binance_rest'").select(*TICK, "observed_at")


def ticks_chainlink(spark, sf_dir):
    rows = ticks.without_keepalives(ticks.chainlink_rows(A.raw_frames(spark, sf_dir)))
    return rows.select(*TICK, "source_ts", "topic", "type", "message_family", F.col("full_accuracy_value").cast("double").alias("full_accuracy"), "error")


def ticks_union(spark, sf_dir):
    return ticks.all_ticks(A.raw_frames(spark, sf_dir)).select("family", *TICK)


def transport_events(spark, sf_dir):
    return ticks.all_ticks(A.transport_frames(spark, sf_dir)).select("family", *TICK, "error", "raw_payload_fragment")


def ticks_deep(spark, sf_dir):
    """Prices that lie up to 13 pairs of levels down."""
    return ticks.chainlink_rows(A.deep_frames(spark, sf_dir)).select("ts", "record_type", "price", "warning")


def candidates_deep(spark, sf_dir):
    """Candidates of events inside events, in the order found."""
    return routing.normalized(A.nested_responses(spark, sf_dir)).select("poll_id", "market_id", "nth")


def response_diagnostics(spark, sf_dir):
    return diagnostics.attempts(A.catalog_responses(spark, sf_dir)).select(
        "poll_id", "attempt_seq", "phase", "ok", "error_kind", "error", "exact_slug_endpoint_used", "browser_like_headers_applied", "payload_empty", "n_rows",
        F.col("payload_sample_rows")[0]["slug"].alias("first_slug"), F.col("payload_sample_rows")[0]["end"].alias("first_end"),
    )


SNAPSHOT = ["poll_id", "token_id", "best_bid", "best_ask", "mid", "spread", "bid_size", "ask_size", "is_empty", "is_crossed", "fetch_ok", "error_kind", "http_status", "error"]


def quote_snapshots(spark, sf_dir):
    return quotes.snapshots(A.book_responses(spark, sf_dir)).select(*SNAPSHOT)


def crossed_books(spark, sf_dir):
    return quotes.snapshots(A.book_responses(spark, sf_dir)).where("is_crossed").select("token_id", "best_bid", "best_ask", "spread")


def _quotes(spark, sf_dir):
    return quotes.quote_rows(A.quote_polls(spark, sf_dir), quotes.snapshots(A.book_responses(spark, sf_dir)))


def quote_rows(spark, sf_dir):
    return _quotes(spark, sf_dir).select(
        "poll_id", "ts", "quote_capture_ok", "quote_capture_status", "market_id", F.col("yes.mid").alias("yes_mid"), F.col("no.mid").alias("no_mid"),
        F.col("yes.spread").alias("yes_spread"), F.col("quote_age_diagnostics.max_age_seconds").alias("max_age_seconds"),
    )


def quote_errors(spark, sf_dir):
    return quotes.quote_errors(_quotes(spark, sf_dir)).select("poll_id", "quote_capture_status", "last_error")


def quote_warnings(spark, sf_dir):
    return quotes.quote_warnings(A.quote_polls(spark, sf_dir)).select("poll_id", "ts", "warning", "market_id")


def quote_poll_failures(spark, sf_dir):
    """Quote polls of which every eleventh failed as a whole, with its error."""
    key = F.col("poll_id").cast("long")
    polls = A.quote_polls(spark, sf_dir).withColumn("poll_error", F.when(key % 11 == 3, F.concat(F.lit("timeout "), "poll_id")))
    return quotes.quote_warnings(polls).select("poll_id", "ts", "record_type", "warning", "market_id", "error")


def _requests(spark, sf_dir):
    """Snapshots taken (views) and asked for (purchases), by token."""
    e = A.events(spark, sf_dir).withColumn("token_id", (F.col("user_id") % 50).cast("string"))
    taken = e.where("event_type = 'view'").select(
        "token_id", F.col("ts").alias("poll_ts"), F.col("event_id").alias("poll_id"), F.col("value").alias("best_bid"),
        (F.col("value") + 1).alias("best_ask"), (F.col("value") + 0.5).alias("mid"), F.lit(1.0).alias("spread"), F.lit(True).alias("fetch_ok"),
    )
    asks = e.where("event_type = 'purchase'").select("event_id", "token_id", "ts")
    return asks, taken


def latest_quote_asof(spark, sf_dir):
    got = quotes.reuse_snapshots(*_requests(spark, sf_dir), ttl_seconds=20_000.0)
    return got.select("event_id", "token_id", "best_bid", "best_ask", "age_seconds")


def _polls(spark, sf_dir):
    return A.events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").cast("string").alias("poll_id"), F.col("ts").alias("poll_ts"), F.lit("ETH").alias("asset"))


def candidate_slugs(spark, sf_dir):
    return routing.candidate_slugs(_polls(spark, sf_dir)).select("poll_id", "bucket", "slug", "attempt_seq", "source", "path")


CANDIDATE = ["poll_id", "attempt_seq", "phase", "market_id", "slug", "title", "token_yes", "token_no", "start_time", "end_time", "status", "start_source", "end_source"]


def normalized_candidates(spark, sf_dir):
    return routing.normalized(A.catalog_responses(spark, sf_dir)).select(*CANDIDATE)


def deduped_candidates(spark, sf_dir):
    return routing.deduped(routing.normalized(A.catalog_responses(spark, sf_dir))).select("poll_id", "attempt_seq", "market_id", "slug", "token_yes", "end_time")


def _combined(spark, sf_dir):
    return routing.combined(routing.normalized(A.catalog_responses(spark, sf_dir)))


def filter_waterfall(spark, sf_dir):
    return routing.waterfall(_combined(spark, sf_dir))


def scored_candidates(spark, sf_dir):
    return _combined(spark, sf_dir).select("poll_id", "attempt_seq", "market_id", "exclusion", "selection_bucket", "score", "reason")


def routed_market(spark, sf_dir):
    got = routing.route(A.catalog_responses(spark, sf_dir))
    return got.select("poll_id", "asset", "market_id", "slug", "token_yes", "token_no", "start_time", "end_time", "status", "routing_score", "routing_reason", "selection_mode", "n_ok", "n_candidates", "n_final")


def route_failures(spark, sf_dir):
    return routing.route(A.catalog_responses(spark, sf_dir)).where("routing_score is null").select("poll_id", "routing_reason", "n_ok", "n_extracted")


def route_results(spark, sf_dir):
    """The whole results of the polls, told by some of their nested fields."""
    d, got = F.col("diagnostics"), results.route_results(A.catalog_responses(spark, sf_dir))
    listed = lambda path, field: F.array_join(F.transform(d[path[0]][path[1]][path[2]], lambda x: x[field]), ",")
    return got.select(
        "poll_id", "routing_reason", "detection_source", F.col("market.title").alias("title"), d["bucket_ts"].alias("bucket_ts"), F.array_join(d["candidate_slugs_attempted"], ",").alias("slugs"),
        F.array_join(F.transform(d["request_diagnostics"], lambda x: F.concat_ws(":", x["attempt_seq"].cast("string"), F.coalesce(x["error_kind"], F.lit("ok")), x["normalization_result"]["extracted_candidate_count"].cast("string"))), ",").alias("requests"),
        d["slug_phase_summary"]["normalized_candidate_count"].alias("n_slug"), d["slug_phase_summary"]["filtered_candidate_count"].alias("f_slug"),
        d["broad_phase_summary"]["attempted"].alias("broad_attempted"), d["broad_phase_summary"]["normalized_candidate_count"].alias("n_broad"),
        d["selection_summary"]["normalized_candidate_count"].alias("n_both"), d["selection_summary"]["filtered_candidate_count"].alias("f_both"), d["selection_summary"]["selection_mode"].alias("mode"),
        listed(("combined_filter_summary", "samples", "normalized"), "slug").alias("first_slugs"), listed(("combined_filter_summary", "samples", "final_candidates"), "end").alias("final_ends"),
        F.array_join(F.transform(d["combined_filter_summary"]["samples"]["excluded"]["not_in_family"], lambda x: x["slug"]), ",").alias("strangers"),
    )


def attempt_summary(spark, sf_dir):
    responses = A.catalog_responses(spark, sf_dir)
    got = diagnostics.attempt_summaries(diagnostics.attempts(responses), routing.normalized(responses))
    return got.select("poll_id", "attempt_seq", "ok", "extracted_candidate_count", F.col("sample_candidates")[0]["market_id"].alias("first_market_id"))


def _decisions(spark, sf_dir):
    return routing.route(A.catalog_responses(spark, sf_dir))


def route_changes(spark, sf_dir):
    return routing.route_rows(_decisions(spark, sf_dir)).select("poll_id", "ts", "asset", "record_type", "market_id", "market_changed")


def route_backfill(spark, sf_dir):
    at = A.events(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("instant_id"), F.col("ts").alias("at"), F.lit("BTC").alias("asset"))
    return routing.backfill(at, A.catalogue(spark, sf_dir))


def catalogue_window_scan(spark, sf_dir):
    table = A.catalogue(spark, sf_dir).select("market_id", F.col("end").alias("end_date"), "closed").distinct()
    got = routing.window_scan(table, F.lit(datetime(2024, 1, 15)), page=1, reach_seconds=7 * 86_400)
    return got.select("market_id", F.unix_seconds("end_date").alias("end_s"))


def heartbeat_freshness(spark, sf_dir):
    e = A.events(spark, sf_dir)
    # Which event type stands for which feed.
    feed = F.create_map(*[F.lit(x) for x in ("purchase", "router", "click", "chainlink", "view", "binance", "error", "quotes")])
    marks = e.where("event_type <> 'signup'").select(feed[F.col("event_type")].alias("feed"), "ts")
    return health.freshness(e.where("event_type = 'signup'").select(F.col("event_id").alias("id"), "ts"), marks).drop("ts")


def heartbeat_state(spark, sf_dir):
    rows = ticks.all_ticks(A.raw_frames(spark, sf_dir)).select("family", E.parse_datetime(F.col("ts")).alias("ts"), "source", "warning", "error", F.lit(0).alias("seq"))
    at = A.events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "ts")
    return health.transport_state(at, rows).drop("ts")


def heartbeat_market(spark, sf_dir):
    at = A.events(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("id"), "ts", F.lit("BTC").alias("asset"))
    routes = _decisions(spark, sf_dir).select("asset", "poll_ts", "poll_id", "market_id", "slug", "status")
    return health.active_market(at, routes, ["market_id", "slug", "status"]).select("id", "market_id", "slug", "status")


def heartbeat_quote_error(spark, sf_dir):
    errors = quotes.quote_errors(_quotes(spark, sf_dir)).select("poll_id", E.parse_datetime(F.col("ts")).alias("poll_ts"), "last_error")
    at = A.events(spark, sf_dir).where("event_type = 'click'").select(
        F.col("event_id").alias("id"), F.timestamp_seconds(F.lit(1704067200) + F.pmod("event_id", F.lit(86_400))).alias("ts"))
    return health.last_quote_error(at, errors).select("id", "quote_last_error")


def heartbeat_cadence(spark, sf_dir):
    """Times of a heartbeat every five minutes over the span of the events."""
    span = A.events(spark, sf_dir).agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    return health.beats(span["low"], span["high"], spark, every_seconds=300).select(F.unix_micros("ts").alias("ts_us"))


def _signals(spark, sf_dir):
    """What routes, ticks and quote polls tell the heartbeat of BTC."""
    btc = F.lit("BTC").alias("asset")
    rows = ticks.all_ticks(A.raw_frames(spark, sf_dir)).select(btc, E.parse_datetime(F.col("ts")).alias("at"), F.lit("").alias("seq"), "family", "source", "warning", "error")
    polls = quotes.quote_errors(_quotes(spark, sf_dir)).select(btc, E.parse_datetime(F.col("ts")).alias("at"), F.col("poll_id").alias("seq"), F.lit(True).alias("taken"), "last_error")
    return health.route_signals(_decisions(spark, sf_dir)).unionByName(health.tick_signals(rows)).unionByName(health.quote_signals(polls))


def _flat(rows):
    names = {"market_id": "active_market.market_id", "slug": "active_market.slug", "title": "active_market.title", "status": "active_market.status",
             "market_start_time": "active_market.market_start_time", "market_end_time": "active_market.market_end_time",
             **{f"{f}_seconds": f"freshness_seconds.{f}" for f in health.FEEDS},
             **{c: f"transport_state.{c}" for c in ("chainlink_connected", "chainlink_last_error", "binance_connected", "binance_rest_fallback", "binance_last_error", "quote_last_error")}}
    return rows.select("ts", "record_type", "output_dir", "asset", *[F.col(path).alias(name) for name, path in names.items()])


def heartbeat_rows(spark, sf_dir):
    """The whole heartbeat row at every fifth minute of the span of the events."""
    span = A.events(spark, sf_dir).agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    low, high = span.select((F.ceil(F.unix_micros("low") / 300_000_000) * 300).cast("timestamp"), "high").first()
    at = health.beats(low, high, spark, every_seconds=300).select(F.lit("BTC").alias("asset"), "ts")
    # The join reads the signals twice.
    return _flat(health.heartbeats(at, stored(_signals(spark, sf_dir), "signals"), output_dir="store"))


@contextmanager
def _rocksdb(spark):
    """The state store that transformWithState asks for."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def heartbeat_stream(spark, sf_dir):
    """Heartbeats of a stream that stops between two beats of the month and goes on
    from its checkpoint."""
    out = new_folder(spark, "heartbeats")
    signals = store.kept(_signals(spark, sf_dir), f"{out}/all")
    middle = F.to_timestamp(F.lit("2024-01-15 00:02:00"))
    with _rocksdb(spark):
        for part in (F.col("at") < middle, F.col("at") >= middle):
            signals.where(part).write.mode("append").parquet(f"{out}/signals")
            told = heartbeats.beats(spark.readStream.schema(health.SIGNAL_ROWS).parquet(f"{out}/signals"), every_seconds=300)
            jobs.run_once(told.writeStream.format("parquet").option("path", f"{out}/beats").outputMode("append"), f"{out}/state")
    return _flat(health.heartbeats_told(spark.read.schema(heartbeats.BEATS).parquet(f"{out}/beats"), output_dir="store"))


def _segmented(spark, sf_dir):
    rows = ticks.all_ticks(A.raw_frames(spark, sf_dir))
    return segments.with_segment(rows.withColumn("at", E.datetime_of(F.col("ts"))), "at")


def segment_manifest(spark, sf_dir):
    got = segments.manifests(_segmented(spark, sf_dir), asset="BTC", output_root="store", closed_at=F.lit(datetime(2024, 2, 1)))
    return got.select("segment_start_utc", "segment_end_utc", "closed_cleanly", "recorder_version", "asset",
                      *[F.col("row_counts")[f"{f}.jsonl"].alias(f"n_{f}") for f in ("chainlink", "binance", "quotes", "meta", "heartbeat")])


def segment_catalog(spark, sf_dir):
    # The ticks are read once; the catalogue and its manifests count from what is kept.
    rows = stored(_segmented(spark, sf_dir).select("segment_date", "segment_hour", "family"), "segmented")
    return segments.catalogue(rows, segments.manifests(rows)).select("segment_date", "segment_hour", "state", "segment_end_utc")


def segment_listing(spark, sf_dir):
    """The catalogue of written segments, from the listing of their files and from
    their manifests."""
    root = new_folder(spark, "listing")
    rows = store.kept(_segmented(spark, sf_dir).drop("at"), f"{root}/all")
    for family in ("chainlink", "binance"):
        store.write_segments(rows.where(F.col("family") == family).drop("segment_date", "segment_hour"), f"{root}/store", family)
    store.write_manifests(segments.manifests(rows, asset="BTC", output_root="store"), f"{root}/store")
    listed = store.list_segments(spark, f"{root}/store")
    got = segments.catalogue(listed, store.read_manifests(spark, f"{root}/store"))
    return got.select("segment_date", "segment_hour", "state", "segment_end_utc")


def manifest_roundtrip(spark, sf_dir):
    """Manifests of closed segments, written as JSON and read back."""
    root = new_folder(spark, "manifests")
    store.write_manifests(segments.manifests(_segmented(spark, sf_dir), asset="BTC", output_root="store"), root)
    return store.read_manifests(spark, root).select(
        "segment_date", "segment_hour", "segment_start_utc", "segment_end_utc", "closed_cleanly", "asset", "output_root",
        F.col("row_counts")["chainlink.jsonl"].alias("n_chainlink"), F.col("row_counts")["binance.jsonl"].alias("n_binance"))


def latest_segment(spark, sf_dir):
    return segments.latest_closed(segments.manifests(_segmented(spark, sf_dir))).select("segment_start_utc", "segment_end_utc", F.col("row_counts")["binance.jsonl"].alias("n_binance"))


def jsonl_roundtrip(spark, sf_dir):
    """Ticks of the exchange feed, written as hourly JSON lines and read back."""
    root = new_folder(spark, "segments")
    store.write_segments(ticks.binance_rows(A.raw_frames(spark, sf_dir)), root, "binance")
    return store.read_segments(spark, root, "binance").select(*TICK, "observed_at", "segment_date", "segment_hour")


def _stream_frames(spark, sf_dir):
    """raw_frames of the events table, staged as files and read as a stream."""
    root = new_folder(spark, "frames")
    A.raw_frames(spark, sf_dir).select("feed", "received_ts", "raw", "event", "error", "url").write.parquet(root)
    return store.read_landed(spark, "raw_frames", root, stream=True)


def hourly_counts_stream(spark, sf_dir):
    out = new_folder(spark, "hourly")
    counts = jobs.hourly_counts(_stream_frames(spark, sf_dir))

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")

    # Each batch tells the hours it changed; hours behind the watermark leave the state.
    jobs.run_once(counts.writeStream.outputMode("update").foreachBatch(keep), f"{out}/state")
    told = spark.read.schema("segment_start timestamp, family string, record_type string, n_rows long, batch long").parquet(f"{out}/rows")
    got = told.groupBy("segment_start", "family", "record_type").agg(F.max_by("n_rows", "batch").alias("n_rows"))
    return got.select(E.iso(F.col("segment_start")).alias("segment_start"), "family", "record_type", "n_rows")


def ticks_stream(spark, sf_dir):
    """Ticks recorded by the stream job, read back from its segments."""
    out = new_folder(spark, "ticks")
    jobs.record_ticks(_stream_frames(spark, sf_dir), f"{out}/rows", f"{out}/state")
    got = spark.read.schema(f"{schemas.CHAINLINK}, observed_at string, family string, {schemas.PARTITIONS}").json(f"{out}/rows")
    return got.select("family", *TICK, "segment_date", "segment_hour")


def route_changes_stream(spark, sf_dir):
    out = new_folder(spark, "changes")
    kept = store.kept(_decisions(spark, sf_dir), f"{out}/all")
    # The second half of the decisions comes after a restart.
    half = F.col("poll_ts") < F.to_timestamp(F.lit("2024-01-15 12:00:00"))
    for part in (half, ~half):
        kept.where(part).write.mode("append").parquet(f"{out}/in")
        jobs.route_changes(spark.readStream.schema(kept.schema).parquet(f"{out}/in"), out, f"{out}/state")
    got = spark.read.schema("poll_id string, ts string, asset string, market_id string, market_changed boolean").parquet(f"{out}/rows")
    return got.select("poll_id", "ts", "asset", "market_id", "market_changed")


#: Where the streams below stop for a while: within the month of the events.
PAUSE = "2024-01-15 12:00:00"


def routed_market_stream(spark, sf_dir):
    """Routes of a stream. The polls of the hour after the pause are split: the even
    attempts land before it, the others after."""
    out = new_folder(spark, "routes")
    rows = A.catalog_responses(spark, sf_dir)
    rows = store.kept(rows.withColumn("n_expected", F.count(F.lit(1)).over(Window.partitionBy("poll_id"))), f"{out}/all")
    pause = F.to_timestamp(F.lit(PAUSE))
    early = (F.col("poll_ts") < pause) | ((F.col("poll_ts") < pause + F.expr("interval 1 hour")) & (F.col("attempt_seq") % 2 == 0))
    for part in (early, ~early):
        rows.where(part).write.mode("append").parquet(f"{out}/in")
        routes.record_routes(spark.readStream.schema(rows.schema).parquet(f"{out}/in"), f"{out}/rows", f"{out}/state", lateness="2 hours")
    got = spark.read.parquet(f"{out}/rows/decisions")
    return got.select("poll_id", "asset", "market_id", "slug", "token_yes", "token_no", "start_time", "end_time", "status", "routing_score", "routing_reason", "selection_mode", "n_ok", "n_candidates", "n_final")


def latest_quote_stream(spark, sf_dir):
    """Requests and snapshots as streams: answers as far as the watermark has come."""
    out = new_folder(spark, "latest")
    sides = {"asks": "ts", "taken": "poll_ts"}
    tables = dict(zip(sides, (store.kept(x, f"{out}/all-{k}") for k, x in zip(sides, _requests(spark, sf_dir)))))
    pause = F.to_timestamp(F.lit(PAUSE))
    with _rocksdb(spark):
        for first in (True, False):
            for name, at in sides.items():
                tables[name].where(F.col(at) < pause if first else F.col(at) >= pause).write.mode("append").parquet(f"{out}/{name}")
            asks, taken = (spark.readStream.schema(tables[k].schema).parquet(f"{out}/{k}") for k in sides)
            got = quote_streams.reuse_snapshots(asks, taken, ttl_seconds=20_000.0)
            jobs.run_once(got.writeStream.format("parquet").option("path", f"{out}/rows").outputMode("append"), f"{out}/state")
    got = spark.read.schema("event_id long, token_id string, best_bid double, best_ask double, age_seconds double").parquet(f"{out}/rows")
    return got.select("event_id", "token_id", "best_bid", "best_ask", "age_seconds")


def quote_rows_stream(spark, sf_dir):
    """Quote rows of polls and books that arrive as streams. A poll of a later day
    brings the watermark past all others; it is left out."""
    out = new_folder(spark, "pairs")
    polls, books = A.quote_polls(spark, sf_dir), A.book_responses(spark, sf_dir).select(*A.BOOK_COLUMNS)
    last = lambda rows: rows.where("cast(poll_id as long) % 7 <> 0").orderBy("poll_id").limit(1).withColumns({"poll_id": F.lit("end"), "poll_ts": F.col("poll_ts") + F.expr("interval 2 days")})
    for part in (lambda rows: rows, last):
        for name, rows in (("polls", polls), ("books", books)):
            part(rows).write.mode("append").parquet(f"{out}/{name}")
        quote_streams.record_sides(*(spark.readStream.schema(x.schema).parquet(f"{out}/{name}") for name, x in (("polls", polls), ("books", books))), f"{out}/sides", f"{out}/state")
    told = spark.read.parquet(f"{out}/sides/rows").drop("batch")
    got = quote_streams.paired_sides(told.where("poll_id <> 'end'"))
    return got.select(
        "poll_id", "ts", "quote_capture_ok", "quote_capture_status", "market_id", F.col("yes.mid").alias("yes_mid"), F.col("no.mid").alias("no_mid"),
        F.col("yes.spread").alias("yes_spread"), F.col("quote_age_diagnostics.max_age_seconds").alias("max_age_seconds"),
    )


def manifest_stream(spark, sf_dir):
    """Manifests of the segments that a stream of ticks closes, with a restart."""
    out = new_folder(spark, "closing")
    frames = store.kept(A.raw_frames(spark, sf_dir).select("feed", "received_ts", "raw", "event", "error", "url"), f"{out}/all")
    pause = F.to_timestamp(F.lit(PAUSE))
    with _rocksdb(spark):
        for part in (F.col("received_ts") < pause, F.col("received_ts") >= pause):
            frames.where(part).write.mode("append").parquet(f"{out}/in")
            rows = ticks.all_ticks(store.read_landed(spark, "raw_frames", f"{out}/in", stream=True))
            rows = rows.select(F.lit("BTC").alias("asset"), E.parse_datetime(F.col("ts")).alias("at"), "family")
            closed = segment_streams.closed_segments(rows)
            jobs.run_once(closed.writeStream.format("parquet").option("path", f"{out}/rows").outputMode("append"), f"{out}/state")
    got = segments.manifests_told(spark.read.schema(segment_streams.CLOSED).parquet(f"{out}/rows"), output_root="store")
    return got.select("segment_start_utc", "segment_end_utc", "closed_cleanly", "recorder_version", "asset",
                      *[F.col("row_counts")[f"{f}.jsonl"].alias(f"n_{f}") for f in ("chainlink", "binance", "quotes", "meta", "heartbeat")])


QUERIES = [
    ticks_binance, ticks_rest, ticks_chainlink, ticks_union, transport_events, ticks_deep, candidates_deep, response_diagnostics, quote_snapshots, crossed_books, quote_rows, quote_errors,
    quote_warnings, quote_poll_failures, latest_quote_asof, candidate_slugs, normalized_candidates, deduped_candidates, filter_waterfall, scored_candidates,
    routed_market, route_failures, route_results, attempt_summary, route_changes, route_backfill, catalogue_window_scan, heartbeat_freshness, heartbeat_state,
    heartbeat_market, heartbeat_quote_error, heartbeat_cadence, heartbeat_rows, heartbeat_stream, segment_manifest, segment_catalog, segment_listing, manifest_roundtrip, latest_segment, jsonl_roundtrip, hourly_counts_stream,
    ticks_stream, route_changes_stream, routed_market_stream, latest_quote_stream, quote_rows_stream, manifest_stream,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
