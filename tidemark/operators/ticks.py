"""Price-feed frames to tick rows.

Input: feed (chainlink, binance_ws, binance_rest), received_ts, raw, event
(NULL for a frame, else a transport event), error, url. All jobs are narrow
projections and run on batches and streams alike. Frames that are not JSON
count as plain text. Other columns of the input are left behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E

# Names that recorded rows carry.
CHAINLINK_SOURCE = "polymarket_rtds"
CHAINLINK_SYMBOL = "BTC/USD"
BINANCE_SYMBOL = "BTCUSDT"

CHAINLINK_COLUMNS = [
    "ts", "received_ts", "record_type", "source", "source_ts", "symbol", "value", "price", "topic", "type",
    "message_family", "full_accuracy_value", "warning", "error", "raw_payload_fragment",
]
BINANCE_COLUMNS = ["ts", "record_type", "source", "symbol", "price", "observed_at", "warning", "error", "raw_payload_fragment"]


def _url_json() -> Column:
    return F.to_json(F.struct(F.col("url").alias("url")), {"ignoreNullFields": "false"})


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def chainlink_rows(frames: DataFrame) -> DataFrame:
    """Oracle frames and transport events. A price comes from the last point of
    a data list, else from an envelope with a full-accuracy value, else from
    anywhere in the message; without one the row is a warning. Empty frames give
    keepalive rows."""
    msg = F.when(F.col("event").isNull(), E.parse(F.col("raw")))
    rows = E.settled(frames.where("feed = 'chainlink'"), v=msg)
    v = F.col("v")
    rows = E.settled(rows, obj=E.is_object(v), payload=E.get(v, "payload"))
    is_obj, payload = F.col("obj"), F.col("payload")
    rows = E.settled(rows, arr=~is_obj & E.is_array(v), env=F.when(E.is_object(payload), payload).when(is_obj, v))
    env = F.col("env")
    rows = E.settled(rows, end=F.try_element_at(E.items(E.get(env, "data")), F.lit(-1)))
    rows = E.settled(rows, last=F.when(E.is_object(F.col("end")), F.col("end")))
    last = F.col("last")
    topic, kind = E.text(E.get(v, "topic")), E.text(E.get(v, "type"))
    there = last.isNotNull()
    rows = E.settled(
        rows, topic=F.when(is_obj, topic), type=F.when(is_obj, kind),
        price_1=F.when(there, E.quick_find(last, ("value", "price", "answer"))), ts_1=F.when(there, E.quick_source_time(last, "timestamp", "ts", "time")),
    )
    full = E.text(E.get(env, "full_accuracy_value"))
    use_full = F.col("price_1").isNull() & full.isNotNull()
    rows = E.settled(
        rows, full=F.when(use_full, full),
        price_2=F.coalesce("price_1", F.when(use_full, E.quick_find(env, ("value", "full_accuracy_value", "price", "answer")))),
        ts_2=F.when(use_full, E.quick_source_time(env, "timestamp", "ts", "time")).otherwise(F.col("ts_1")),
    )
    family = (
        F.when(F.col("full").isNotNull(), F.when((F.col("topic") == "crypto_prices_chainlink") & (F.col("type") == "update"), "live_update").otherwise("full_accuracy_value"))
        .when(last.isNotNull(), F.when((F.col("topic") == "crypto_prices") & (F.col("type") == "subscribe"), "snapshot_subscribe").otherwise("data_points"))
        .otherwise("unknown")
    )
    fallback_ts = E.source_time(E.first_truthy(*[E.get(env, k) for k in ("timestamp", "ts", "time")], E.get(v, "timestamp")))
    rows = E.settled(
        rows, source_ts=F.coalesce("ts_2", F.when(is_obj, fallback_ts)),
        price=F.coalesce("price_2", E.quick_find(v, ("price", "value", "answer", "mark_price", "aggregate_price", "full_accuracy_value"))),
        family=family,
    )
    is_frame = F.col("event").isNull()
    empty = is_frame & (F.coalesce(F.col("raw"), F.lit("")) == "")
    symbol = F.coalesce(E.quick_text(env, "symbol"), E.quick_text(v, "symbol", "pair"), F.lit("btc/usd"))
    rows = E.settled(rows, parsed=is_frame & (is_obj | F.col("arr")), symbol=symbol, at_text=E.iso_of(F.col("received_ts")))
    parsed = F.col("parsed")
    plain = is_frame & ~empty & ~parsed
    warning = F.when(~is_frame, F.col("event")).when(plain, "non_json_message").when(parsed & F.col("price").isNull(), "unparsed_chainlink_payload")
    symbol, ts = F.col("symbol"), F.col("at_text")
    return rows.select(
        ts.alias("ts"),
        F.when(is_frame, ts).alias("received_ts"),
        F.when(empty, "keepalive").when(warning.isNotNull(), "warning").otherwise("tick").alias("record_type"),
        F.lit(CHAINLINK_SOURCE).alias("source"),
        F.when(parsed, F.col("source_ts")).alias("source_ts"),
        F.when(parsed, symbol).when(empty, None).otherwise(CHAINLINK_SYMBOL).alias("symbol"),
        F.when(parsed, F.col("price")).alias("value"),
        F.when(parsed, F.col("price")).alias("price"),
        F.when(parsed, F.col("topic")).alias("topic"),
        F.when(parsed, F.col("type")).alias("type"),
        F.when(empty, "empty_frame").when(plain, "non_json_message").when(parsed, F.col("family")).alias("message_family"),
        F.when(parsed, F.col("full")).alias("full_accuracy_value"),
        warning.alias("warning"),
        F.when(~is_frame, F.col("error")).alias("error"),
        F.when(is_frame, F.coalesce(F.col("raw"), F.lit(""))).otherwise(_url_json()).alias("raw_payload_fragment"),
    )


def without_keepalives(rows: DataFrame) -> DataFrame:
    """Rows that get recorded: all but empty frames."""
    return rows.where("message_family is null or message_family <> 'empty_frame'")


def binance_rows(frames: DataFrame) -> DataFrame:
    """Trade frames, ticker polls and transport events of the exchange feed. A
    ticker poll whose price is no number is a failed poll."""
    rows = E.settled(frames.where("feed in ('binance_ws', 'binance_rest')"), v=F.when(F.col("event").isNull(), E.parse(F.col("raw"))))
    v = F.col("v")
    rest = F.col("feed") == "binance_rest"
    is_frame = F.col("event").isNull()
    traded = F.try_variant_get(v, "$.p", "string")
    known = F.when(traded.rlike(E.PLAIN_NUMBER), F.nullif(traded.try_cast("double"), F.lit(0.0)))
    price = F.when(rest, E.quick_number(v, "price")).otherwise(F.coalesce(known, E.number(E.first_truthy(E.get(v, "p"), E.get(v, "price")))))
    rows = E.settled(rows, obj=E.is_object(v))
    rows = E.settled(rows, price=F.when(F.col("obj"), price), at_text=E.iso_of(F.col("received_ts")))
    plain = is_frame & ~rest & ~F.col("obj")
    warning = (
        F.when(~is_frame, F.col("event"))
        .when(plain, "non_json_message")
        .when(F.col("price").isNull(), F.when(rest, "rest_poll_failed").otherwise("unparsed_binance_payload"))
    )
    failed = ~is_frame | (rest & F.col("price").isNull())
    return rows.select(
        F.col("at_text").alias("ts"),
        F.when(warning.isNull(), "tick").otherwise("warning").alias("record_type"),
        F.col("feed").alias("source"),
        F.lit(BINANCE_SYMBOL).alias("symbol"),
        "price",
        F.when(is_frame & ~rest, E.quick_text(v, "E", "T", "eventTime")).alias("observed_at"),
        warning.alias("warning"),
        F.when(failed, F.coalesce(F.col("error"), F.when(is_frame, "price is not a number"))).alias("error"),
        F.when(failed, _url_json()).otherwise(F.col("raw")).alias("raw_payload_fragment"),
    )


def all_ticks(frames: DataFrame) -> DataFrame:
    """Recorded rows of both feeds, tagged with their family; nothing is deduped."""
    return (
        without_keepalives(chainlink_rows(frames))
        .withColumn("family", F.lit("chainlink"))
        .unionByName(binance_rows(frames).withColumn("family", F.lit("binance")), allowMissingColumns=True)
    )
