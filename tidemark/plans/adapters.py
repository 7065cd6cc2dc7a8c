"""Recorder inputs derived from the star-schema tables, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Catalogue polls see the markets of so many events on either side.
REACH = 8
#: Columns of landed order books, without those that only the SQL needs.
BOOK_COLUMNS = ["poll_id", "poll_ts", "asset", "token_id", "http_status", "transport", "failure", "error", "body"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts as an instant (the files hold it without a zone: UTC)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by event type: view is a trade, signup a ticker poll, click an
    oracle update, purchase an oracle list of two points, error plain text or a
    transport event (every third). Events are dealt out first: their file may hold
    few row groups, and reading a frame costs far more than moving an event."""
    e = events(spark, sf_dir).select("event_id", "ts", "event_type", "value").repartition("event_id")
    ms = F.unix_millis("ts").cast("string")
    value = F.col("value").cast("string")
    kind, odd = F.col("event_type"), F.col("event_id") % 3
    raw = (
        F.when(kind == "view", F.concat(F.lit('{"p":"'), value, F.lit('","E":'), ms, F.lit("}")))
        .when(kind == "signup", F.concat(F.lit('{"symbol":"BTCUSDT","price":"'), value, F.lit('"}')))
        .when(kind == "click", F.concat(
            F.lit('{"topic":"crypto_prices_chainlink","type":"update","payload":{"symbol":"btc/usd","value":'), value,
            F.lit(',"full_accuracy_value":"'), value, F.lit('","timestamp":'), ms, F.lit("}}")))
        .when(kind == "purchase", F.concat(
            F.lit('{"topic":"crypto_prices","type":"subscribe","payload":{"symbol":"btc/usd","data":[{"timestamp":1,"value":0.5},{"timestamp":'), ms,
            F.lit(',"value":'), value, F.lit("}]}}")))
        .otherwise(F.when(odd == 0, F.lit("")).when(odd == 1, F.lit("upstream hiccup")))
    )
    feed = F.when(kind == "view", "binance_ws").when(kind == "signup", "binance_rest").otherwise(F.lit("chainlink"))
    transport = (kind == "error") & (odd == 2)
    return e.select(
        "event_id", feed.alias("feed"), F.col("ts").alias("received_ts"), raw.alias("raw"),
        F.when(transport, "rtds_reconnect").alias("event"), F.when(transport, "closed").alias("error"),
        F.when(transport, "wss://feed.invalid/ws").alias("url"),
    )


def deep_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oracle frames of the click events whose price lies event_id % 14 levels down,
    below lists and objects in turn; every seventh holds no number."""
    levels = (F.col("event_id") % 14).cast("int")
    inner = F.when(F.col("event_id") % 7 == 3, '{"note":"none"}').otherwise(F.concat(F.lit('{"price":"'), F.col("value").cast("string"), F.lit('"}')))
    raw = F.concat(F.repeat(F.lit('{"payload":["no",{"event":'), levels), inner, F.repeat(F.lit("}]}"), levels))
    return events(spark, sf_dir).where("event_type = 'click'").select(
        "event_id", F.lit("chainlink").alias("feed"), F.col("ts").alias("received_ts"), raw.alias("raw"),
        F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("url"),
    )


def nested_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue responses of the click events: two markets, in events inside events,
    event_id % 12 levels down; the level above the last has a market of its own."""
    i, levels = F.col("event_id").cast("string"), (F.col("event_id") % 12).cast("int")
    leaf = F.concat(F.lit('{"id":"e'), i, F.lit('","markets":[{"id":"a'), i, F.lit('"},7,{"id":"b'), i, F.lit('"}]}'))
    above = F.when(levels > 0, F.concat(F.lit('{"id":"u'), i, F.lit('","market":{"id":"m'), i, F.lit('"},"events":['), leaf, F.lit(",[]]}"))).otherwise(leaf)
    body = F.concat(F.repeat(F.lit('{"events":['), F.greatest(levels - 1, F.lit(0))), above, F.repeat(F.lit("]}"), F.greatest(levels - 1, F.lit(0))))
    return events(spark, sf_dir).where("event_type = 'click'").select(
        i.alias("poll_id"), F.col("ts").alias("poll_ts"), F.lit("BTC").alias("asset"), F.lit("slug").alias("phase"), F.lit(0).alias("attempt_seq"),
        F.lit("slug_event_query").alias("source"), F.lit("s").alias("slug"), F.lit("/events").alias("path"), F.create_map().cast("map<string,string>").alias("params"),
        F.create_map().cast("map<string,string>").alias("headers_applied"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("failure"),
        F.lit(None).cast("string").alias("error"), body.alias("body"),
    )


def transport_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport events of both feeds: four named ones by event id, and ticker polls
    (every fifth event) that failed or brought no price."""
    i = F.col("event_id")
    # Transport events as the feeds name them.
    names = ["rtds_reconnect", "missing_poly_rtds_url", "websockets_dependency_unavailable", "ws_reconnect_rest_fallback"]
    event = F.when(i % 5 < 4, F.element_at(F.array(*[F.lit(n) for n in names]), (i % 5 + 1).cast("int")))
    feed = F.when(i % 5 < 2, "chainlink").when(i % 5 == 2, F.when(i % 2 == 0, "chainlink").otherwise("binance_ws")).when(i % 5 == 3, "binance_ws").otherwise("binance_rest")
    poll = F.when(i % 5 == 4, F.when(i % 2 == 0, '{"symbol":"BTCUSDT","price":"none"}').otherwise("busy"))
    return events(spark, sf_dir).select(
        "event_id", feed.alias("feed"), F.col("ts").alias("received_ts"), poll.alias("raw"), event.alias("event"),
        F.when(i % 3 == 0, F.concat(F.lit("lost "), i.cast("string"))).alias("error"), F.lit("wss://feed.invalid/ws").alias("url"),
    )


def book_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order books: the first two lines of an order are the YES and NO book. Bids
    are the line's price, asks that by 1 + tax - discount (crossed where the
    discount is larger); R lines answer 403, A lines with open status have a bad
    level, N lines with F status are empty."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    # Two lines of an order at most are kept; the sort runs inside an order.
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    rest = F.struct("l_discount", "l_tax", "l_returnflag", "l_linestatus")
    two = line.groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list(F.struct(key.alias("k"), rest.alias("r")))), 1, 2).alias("x"))
    two = two.select("l_orderkey", F.posexplode("x").alias("n", "l")).select("l_orderkey", "n", "l.k.*", "l.r.*")
    ask = F.col("l_extendedprice") * (1 + F.col("l_tax") - F.col("l_discount"))
    text = lambda c: c.cast("string")
    book = F.concat(
        F.lit('{"bids":[{"price":"'), text(F.col("l_extendedprice")), F.lit('","size":"'), text(F.col("l_quantity")),
        F.lit('"}],"asks":[["'), text(ask), F.lit('",'), text(F.col("l_quantity")), F.lit("]]}"),
    )
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    body = (
        F.when(flag == "R", "forbidden")
        .when((flag == "A") & (status == "O"), '{"bids":[["x",1]],"asks":[["2",1]]}')
        .when((flag == "N") & (status == "F"), '{"book":{"bids":[],"asks":[]}}')
        .otherwise(book)
    )
    return two.select(
        text(F.col("l_orderkey")).alias("poll_id"),
        (F.timestamp_seconds(F.lit(1704067200) + F.col("l_orderkey") % 86_400)).alias("poll_ts"),
        F.lit("BTC").alias("asset"),
        F.concat(text(F.col("l_orderkey")), F.when(F.col("n") == 0, "-yes").otherwise("-no")).alias("token_id"),
        F.when(flag == "R", 403).otherwise(200).alias("http_status"), F.lit("https").alias("transport"),
        F.lit(None).cast("string").alias("failure"), F.lit(None).cast("string").alias("error"), body.alias("body"),
        F.col("n").alias("side"), "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )


def quote_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote poll per order; every seventh has no NO token."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        key.alias("poll_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("o_orderkey") % 86_400).alias("poll_ts"), F.lit("BTC").alias("asset"),
        F.concat(F.lit("m"), key).alias("market_id"), F.lit("s").alias("slug"), F.lit("t").alias("title"), F.lit("c").alias("condition_id"),
        F.concat(key, F.lit("-yes")).alias("token_yes"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(key, F.lit("-no"))).alias("token_no"),
        F.lit("a").alias("start_time"), F.lit("b").alias("end_time"), F.lit("open").alias("status"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One market per event: its five-minute bucket (two for every fifth), a slug
    with the prefix or (every fourth) a title that only reads like one; some lack
    tokens, are closed, or belong to no family."""
    return _with_market(events(spark, sf_dir).select("event_id", "ts"))


def _with_market(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    start = (F.floor(F.unix_seconds("ts") / 300) * 300).cast("long")
    return e.select(
        "*", start.alias("start_s"), (start + F.when(i % 5 == 0, 600).otherwise(300)).alias("end_s"),
        F.concat(F.lit("m"), start.cast("string"), F.lit("-"), (i % 4).cast("string")).alias("market_id"),
        F.when(i % 4 == 0, F.concat(F.lit("other-"), start.cast("string"))).otherwise(F.concat(F.lit("btc-updown-5m-"), start.cast("string"))).alias("slug"),
        F.when(i % 8 == 0, "Bitcoin up or down, 5 minute").otherwise("Up or down").alias("title"),
        (i % 6 != 0).alias("has_tokens"), (i % 9 == 0).alias("closed"), (i % 10 == 3).alias("nested"), (i % 11 == 4).alias("listed"),
        (i % 13 == 5).alias("broken"), (i % 3 == 0).alias("broad"),
    )


def catalog_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue polls: every purchase polls and sees the markets of the events up
    to REACH before and after it (not its own), each as one response. Polls are
    laid out over the ids that they see, so this is an equi-join. Ids and times alone
    are moved; bodies are built where a poll's rows have come together."""
    e = events(spark, sf_dir)
    polls = e.where("event_type = 'purchase'").select(F.col("event_id").alias("p"), F.col("ts").alias("poll_ts"))
    asked = polls.withColumn("shift", F.explode(F.sequence(F.lit(-REACH), F.lit(REACH)))).where("shift <> 0")
    asked = asked.select(F.col("p").cast("string").alias("poll_id"), "poll_ts", "shift", (F.col("p") + F.col("shift")).alias("event_id"))
    m = _with_market(asked.join(e.select("event_id", "ts"), "event_id").repartition("poll_id"))
    start, end = (F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'") for c in ("start_s", "end_s"))
    tokens = F.when(F.col("has_tokens"), F.concat(
        F.lit(',"outcomes":"[\\"Up\\",\\"Down\\"]","clobTokenIds":["y'), "market_id", F.lit('","n'), "market_id", F.lit('"]'))).otherwise("")
    market = F.concat(
        F.lit('{"id":"'), "market_id", F.lit('","slug":"'), "slug", F.lit('","question":"'), "title", F.lit('","eventStartTime":"'), start,
        F.lit('","endDate":"'), end, F.lit('"'), F.when(F.col("closed"), ',"closed":true').otherwise(',"active":true'), tokens, F.lit("}"))
    body = (
        F.when(F.col("broken"), "<html>")
        .when(F.col("listed"), F.concat(F.lit("["), market, F.lit("]")))
        .when(F.col("nested"), F.concat(F.lit('{"events":[{"markets":['), market, F.lit("]}]}")))
        .otherwise(market)
    )
    return m.withColumn("body", body).select(
        "poll_id", "poll_ts", F.lit("BTC").alias("asset"),
        F.when(F.col("broad"), "broad").otherwise("slug").alias("phase"),
        (F.col("shift") + F.lit(REACH) + F.when(F.col("broad"), 100).otherwise(0)).cast("int").alias("attempt_seq"),
        F.when(F.col("broad"), "broad_market_open_scan").otherwise("slug_exact_market_path").alias("source"), "slug",
        F.when(F.col("broad"), F.lit("/markets")).otherwise(F.concat(F.lit("/markets/slug/"), "slug")).alias("path"),
        F.create_map().cast("map<string,string>").alias("params"),
        F.create_map(F.lit("Accept"), F.lit("application/json")).alias("headers_applied"),
        F.when(F.col("event_id") % 17 == 6, 503).otherwise(200).alias("http_status"),
        F.lit(None).cast("string").alias("failure"), F.lit(None).cast("string").alias("error"), "body",
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markets as a catalogue table."""
    m = markets(spark, sf_dir)
    return m.select(
        F.lit("BTC").alias("asset"), "market_id", "slug", "title",
        F.when(F.col("has_tokens"), F.concat(F.lit("y"), "market_id")).alias("token_yes"),
        F.when(F.col("has_tokens"), F.concat(F.lit("n"), "market_id")).alias("token_no"),
        F.timestamp_seconds("start_s").alias("start"), F.timestamp_seconds("end_s").alias("end"),
        F.when(F.col("closed"), "closed").otherwise("open").alias("status"), "closed",
    ).distinct()
