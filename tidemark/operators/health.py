"""Heartbeats: how fresh every feed is, and what state it is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import expr as E
from .asof import asof_join

FEEDS = ("router", "chainlink", "binance", "quotes")


def beats(low, high, spark, every_seconds: int = SETTINGS.heartbeat_seconds) -> DataFrame:
    """ts from low to high (timestamps) in steps; laid out hour by hour, so that
    a long span is not one row."""
    steps = 3600 // every_seconds
    span = spark.createDataFrame([(low, high)], "low timestamp, high timestamp")
    hours = span.select("low", "high", F.explode(F.sequence("low", "high", F.expr("interval 1 hour"))).alias("h")).repartition("h")
    ts = F.col("h") + F.make_interval(secs=F.col("i") * every_seconds)
    return hours.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).select(ts.alias("ts"), "high").where("ts <= high").select("ts")


def freshness(at: DataFrame, events: DataFrame, feeds: tuple[str, ...] = FEEDS) -> DataFrame:
    """at (id, ts) with the seconds since the last event (feed, ts) of every feed;
    NULL before the first. One pass over all feeds: heartbeats are laid out per
    feed, matched, and folded again."""
    asks = at.select("id", "ts", F.explode(F.array(*[F.lit(f) for f in feeds])).alias("feed"))
    marks = events.select("feed", "ts").withColumn("there", F.lit(True))
    got = asof_join(asks, marks, by=["feed"], values=["there"])
    age = E.seconds_since(F.col("ts"), F.col("asof_ts"))
    return got.groupBy("id", "ts").agg(*[F.max(F.when(F.col("feed") == f, age)).alias(f"{f}_seconds") for f in feeds])


def transport_state(at: DataFrame, ticks: DataFrame) -> DataFrame:
    """at (id, ts) with what the last recorded rows (family, ts, source, warning,
    error) say: a reconnect warning means disconnected, ticker polls or their
    warnings mean fallback. Reconnects that leave no row cannot be seen."""
    state = ticks.select(
        F.col("family").alias("feed"), "ts",
        (F.coalesce("warning", F.lit("")).isin("rtds_reconnect", "ws_reconnect_rest_fallback") == F.lit(False)).alias("connected"),
        ((F.col("source") == "binance_rest") | (F.coalesce("warning", F.lit("")) == "ws_reconnect_rest_fallback")).alias("fallback"),
        F.col("seq"),
    )
    asks = at.select("id", "ts", F.explode(F.array(F.lit("chainlink"), F.lit("binance"))).alias("feed"))
    got = asof_join(asks, state, by=["feed"], values=["connected", "fallback"], tie=["seq"])
    errors = ticks.where("error is not null").select(F.col("family").alias("feed"), "ts", "error", "seq")
    got = asof_join(got.drop("asof_ts"), errors, by=["feed"], values=["error"], tie=["seq"])
    one = lambda f, c: F.max(F.when(F.col("feed") == f, F.col(c)))
    return got.groupBy("id", "ts").agg(
        F.coalesce(one("chainlink", "connected"), F.lit(False)).alias("chainlink_connected"),
        one("chainlink", "error").alias("chainlink_last_error"),
        F.coalesce(one("binance", "connected"), F.lit(False)).alias("binance_connected"),
        F.coalesce(one("binance", "fallback"), F.lit(False)).alias("binance_rest_fallback"),
        one("binance", "error").alias("binance_last_error"),
    )


def active_market(at: DataFrame, routes: DataFrame, values: list[str]) -> DataFrame:
    """at (id, ts, asset) with columns of the last decision; a decision without
    a market counts and leaves NULLs."""
    return asof_join(at, routes, by=["asset"], right_ts="poll_ts", values=values, tie=["poll_id"]).drop("asof_ts")


def last_quote_error(at: DataFrame, errors: DataFrame) -> DataFrame:
    """at (id, ts) with quote_last_error of the last poll (poll_ts, last_error):
    a poll that went well resets it to NULL."""
    one = F.lit(1).alias("one")
    got = asof_join(at.select("*", one), errors.select("*", one), by=["one"], right_ts="poll_ts", values=["last_error"], tie=["poll_id"])
    return got.withColumnRenamed("last_error", "quote_last_error").drop("asof_ts", "one")


# --- the whole row ---------------------------------------------------------------

#: What a heartbeat tells, by signal: the last value of each counts, NULL included.
SIGNALS = (
    "router_at", "market", "chainlink_at", "chainlink_up", "chainlink_error", "binance_at", "binance_up", "binance_fallback", "binance_error", "quotes_at", "quote_error",
)
SIGNAL_ROWS = "asset string, signal string, at timestamp, seq string, value string"
_MARKET = "struct<market_id:string,slug:string,title:string,status:string,market_start_time:string,market_end_time:string>"


def _signal(rows: DataFrame, **values: Column) -> DataFrame:
    """One row per signal and row (asset, at, seq); values are texts."""
    entries = F.array(*[F.struct(F.lit(name).alias("signal"), v.cast("string").alias("value")) for name, v in values.items()])
    return rows.select("asset", "at", F.col("seq").cast("string").alias("seq"), F.explode(entries).alias("s")).select("asset", "s.signal", "at", "seq", "s.value")


def route_signals(decisions: DataFrame) -> DataFrame:
    """Of decisions (asset, poll_ts, poll_id and the market's fields): when the router
    last answered, and the market it named; a decision without one names none."""
    market = F.struct("market_id", "slug", "title", "status", F.col("start_time").alias("market_start_time"), F.col("end_time").alias("market_end_time"))
    rows = decisions.withColumns({"at": F.col("poll_ts"), "seq": F.col("poll_id")})
    return _signal(rows, router_at=E.iso(F.col("at")), market=F.when(F.col("routing_score").isNotNull(), F.to_json(market)))


def tick_signals(rows: DataFrame) -> DataFrame:
    """Of recorded rows of the price feeds (asset, at, seq, family, source, warning,
    error): the same states as transport_state(); an error stays until the next."""
    warning = F.coalesce("warning", F.lit(""))
    up = ~warning.isin("rtds_reconnect", "ws_reconnect_rest_fallback")
    fallback = (F.col("source") == "binance_rest") | (warning == "ws_reconnect_rest_fallback")
    told = E.settled(rows.select("asset", "at", F.col("seq").cast("string").alias("seq"), "family", "source", "warning", "error"), at_text=E.iso_of(F.col("at")))
    entry = lambda name, when, value: F.when(when, F.struct(F.lit(name).alias("signal"), value.cast("string").alias("value")))
    entries = []
    for f, more in (("chainlink", {}), ("binance", {"binance_fallback": fallback})):
        own = F.col("family") == f
        entries += [entry(name, own, value) for name, value in {f"{f}_at": F.col("at_text"), f"{f}_up": up, **more}.items()]
        entries.append(entry(f"{f}_error", own & F.col("error").isNotNull(), F.col("error")))
    # Every row is read once, whatever it tells.
    return told.select("asset", "at", "seq", F.explode(F.array_compact(F.array(*entries))).alias("s")).select("asset", "s.signal", "at", "seq", "s.value")


def quote_signals(polls: DataFrame) -> DataFrame:
    """Of quote polls (asset, at, seq, taken, last_error): when snapshots were last
    taken, and the error of the last poll; one that went well resets it."""
    entry = lambda name, when, value: F.when(when, F.struct(F.lit(name).alias("signal"), value.alias("value")))
    entries = F.array_compact(F.array(entry("quotes_at", F.col("taken"), E.iso(F.col("at"))), entry("quote_error", F.lit(True), F.col("last_error"))))
    return polls.select("asset", "at", F.col("seq").cast("string").alias("seq"), F.explode(entries).alias("s")).select("asset", "s.signal", "at", "seq", "s.value")


def _assembled(rows: DataFrame, output_dir: str) -> DataFrame:
    """HEARTBEAT rows of asset, at and told (signal to its last value)."""
    of = lambda name: F.get(F.map_values(F.map_filter("told", lambda k, _: k == name)), F.lit(0))
    age = lambda name: E.seconds_since(F.col("at"), E.parse_datetime(of(name)))
    yes = lambda name: F.coalesce(of(name).cast("boolean"), F.lit(False))
    nothing = F.from_json(F.lit("{}"), _MARKET)
    return rows.select(
        E.iso(F.col("at")).alias("ts"), F.lit("heartbeat").alias("record_type"), F.lit(output_dir).alias("output_dir"),
        F.coalesce(F.from_json(of("market"), _MARKET), nothing).alias("active_market"),
        F.struct(*[age(f"{f}_at").alias(f) for f in FEEDS]).alias("freshness_seconds"),
        F.struct(
            yes("chainlink_up").alias("chainlink_connected"), of("chainlink_error").alias("chainlink_last_error"), yes("binance_up").alias("binance_connected"),
            yes("binance_fallback").alias("binance_rest_fallback"), of("binance_error").alias("binance_last_error"), of("quote_error").alias("quote_last_error"),
        ).alias("transport_state"),
        "asset",
    )


def heartbeats(at: DataFrame, signals: DataFrame, *, output_dir: str = "") -> DataFrame:
    """The heartbeat row of every asset and time of ``at`` (asset, ts), from signals
    (SIGNAL_ROWS): the last value of each at or before that time, ties by seq. One
    pass over all signals; a signal not yet seen leaves NULLs, or false for states."""
    asks = at.select("asset", "ts", F.explode(F.array(*[F.lit(s) for s in SIGNALS])).alias("signal"))
    got = asof_join(asks, signals, by=["asset", "signal"], right_ts="at", values=["value"], tie=["seq"])
    told = F.map_from_entries(F.collect_list(F.struct("signal", "value")))
    return _assembled(got.groupBy("asset", F.col("ts").alias("at")).agg(told.alias("told")), output_dir)


def heartbeats_told(beats: DataFrame, *, output_dir: str = "") -> DataFrame:
    """The same rows of beats (asset, at, told as JSON text), as a stream keeps them."""
    return _assembled(beats.select("asset", "at", F.from_json("told", "map<string,string>").alias("told")), output_dir)
