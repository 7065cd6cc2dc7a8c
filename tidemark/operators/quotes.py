"""Order books to quote snapshots and market quote rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import expr as E
from .asof import asof_join
from .diagnostics import classified

SIDE = ["fetch_ok", "error_kind", "http_status", "transport", "best_bid", "best_ask", "mid", "spread", "age_seconds", "error"]


def _members(level: Column) -> Column:
    """struct(p, s) of a book level: a pair, or an object with both; else NULLs."""
    pair = E.let(E.items(level), lambda x: F.when(F.size(x) >= 2, F.struct(x[0].alias("p"), x[1].alias("s"))))
    named = F.struct(
        E.first_truthy(E.get(level, "price"), E.get(level, "p")).alias("p"),
        E.first_truthy(*[E.get(level, k) for k in ("size", "quantity", "qty", "q")]).alias("s"),
    )
    return F.coalesce(pair, E.let(named, lambda x: F.when(x["p"].isNotNull() & x["s"].isNotNull(), x)))


def _number_at(book: Column, path: str) -> Column:
    """E.number() of a member; a plain decimal, a text or not, is read as it stands."""
    text = F.try_variant_get(book, path, "string")
    return F.when(text.rlike(E.PLAIN_NUMBER), text.try_cast("double")).otherwise(E.number(F.try_variant_get(book, path, "variant")))


def _level(book: Column, name: str) -> Column:
    """struct(price, size, there) of the first level of a side as delivered. Pairs and
    plain objects are read by their paths, anything else by _members()."""
    path = f"$.{name}[0]"
    second = F.try_variant_get(book, f"{path}[1]", "variant")
    price, size = (F.try_variant_get(book, f"{path}.{k}", "string") for k in ("price", "size"))
    # A plain number other than 0 is truthy, whether a text or not.
    plain = lambda t: t.rlike(E.PLAIN_NUMBER) & (t.try_cast("double") != 0)
    entry = lambda p, s, there: F.struct(p.alias("price"), s.alias("size"), there.alias("there"))
    other = E.let(_members(F.try_variant_get(book, path, "variant")), lambda m: entry(E.number(m["p"]), E.number(m["s"]), m.isNotNull()))
    nothing = F.try_variant_get(book, path, "variant").isNull()
    return (
        F.when(second.isNotNull(), entry(_number_at(book, f"{path}[0]"), _number_at(book, f"{path}[1]"), F.lit(True)))
        .when(F.coalesce(plain(price) & plain(size), F.lit(False)), entry(price.try_cast("double"), size.try_cast("double"), F.lit(True)))
        .when(nothing, entry(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(False)))
        .otherwise(other)
    )


def _bad(book: Column, name: str, level: Column) -> Column:
    """A member that is no number, or a side (unless falsy) that is no list."""
    side = E.get(book, name)
    member = level["there"] & (level["price"].isNull() | level["size"].isNull())
    return F.coalesce(member | (side.isNotNull() & ~E.is_array(side) & E.is_truthy(side)), F.lit(False))


def snapshots(responses: DataFrame) -> DataFrame:
    """One snapshot per book response. If a level of either side is not numeric,
    both sides stay empty. Age is 0 at the time of the response."""
    rows = classified(responses, book=True)
    v = F.col("v")
    places = [E.get(v, k) for k in ("book", "data", "orderbook")]
    nested = F.get(F.filter(F.array(*places, v), E.is_object), F.lit(0))
    flat = F.coalesce(*places).isNull()
    rows = E.settled(rows, book=F.when(E.is_object(v), F.when(flat, v).otherwise(nested)))
    book = F.col("book")
    rows = E.settled(rows, bid=_level(book, "bids"), ask=_level(book, "asks"))
    rows = E.settled(rows, bid_bad=_bad(book, "bids", F.col("bid")), ask_bad=_bad(book, "asks", F.col("ask")))
    bad = F.col("bid_bad") | F.col("ask_bad")
    none = F.col("book").isNull()
    parse_error = F.when(none, "non-dict-orderbook").when(bad, "could not convert a level to numbers")
    rows = rows.withColumn("parse_error", parse_error)
    for name, side, part in (("best_bid", "bid", "price"), ("best_ask", "ask", "price"), ("bid_size", "bid", "size"), ("ask_size", "ask", "size")):
        rows = rows.withColumn(name, F.when(~bad & ~none, F.col(f"{side}.{part}")))
    b, a = F.col("best_bid"), F.col("best_ask")
    ordered = ~F.isnan(b) & ~F.isnan(a)
    rows = rows.withColumn("is_empty", b.isNull() & a.isNull())
    return rows.select(
        "poll_id", "poll_ts", "asset", "token_id",
        "best_bid", "best_ask", ((a + b) / 2.0).alias("mid"), (a - b).alias("spread"), "bid_size", "ask_size", "is_empty",
        F.coalesce(ordered & (b > a), F.lit(False)).alias("is_crossed"),
        F.lit("clob_orderbook").alias("source"),
        E.iso(F.col("poll_ts")).alias("fetched_at"),
        F.lit(0.0).alias("age_seconds"),
        (F.col("ok") & ~F.col("is_empty") & F.col("parse_error").isNull()).alias("fetch_ok"),
        F.coalesce("error_kind", F.when(F.col("ok") & F.col("parse_error").isNotNull(), "parse_failure")).alias("error_kind"),
        "http_status", "transport",
        F.coalesce("error_text", "parse_error").alias("error"),
        "response_text_sample",
        (~(F.col("ok") & ~F.col("is_empty") & F.col("parse_error").isNull())).alias("fetch_failed"),
        F.lit(0.0).alias("quote_age_seconds"),
        F.col("body").alias("raw"),
    )


def reuse_snapshots(requests: DataFrame, taken: DataFrame, ttl_seconds: float = SETTINGS.quote_ttl_seconds) -> DataFrame:
    """requests (token_id, ts) with the last snapshot of the token that is no
    older than the time to live, and its age then."""
    values = ["best_bid", "best_ask", "mid", "spread", "fetch_ok"]
    got = asof_join(requests, taken, by=["token_id"], right_ts="poll_ts", values=values, tie=["poll_id"], tolerance_seconds=ttl_seconds)
    return got.withColumn("age_seconds", E.seconds_since(F.col("ts"), F.col("asof_ts")))


def quote_rows(polls: DataFrame, taken: DataFrame) -> DataFrame:
    """Market quote rows: polls (poll_id, poll_ts, asset and the market's columns
    with token_yes, token_no) with the snapshots of their two tokens. Polls
    without both tokens are left to quote_warnings."""
    polls = polls.where("token_yes is not null and token_yes <> '' and token_no is not null and token_no <> ''")
    books = taken.groupBy("poll_id").agg(F.collect_list(F.struct("token_id", F.struct(*SIDE).alias("s"))).alias("books"))
    rows = polls.join(books, "poll_id", "left")
    # The snapshots are read once; both sides are taken from a poll's few books.
    for side in ("yes", "no"):
        own = F.filter("books", lambda b: b["token_id"] == F.col(f"token_{side}"))
        rows = rows.select("*", F.explode_outer(F.transform(own, lambda b: b["s"])).alias(side))
    return paired(rows.drop("books"))


def paired(rows: DataFrame) -> DataFrame:
    """Quote rows of polls joined with their snapshots (yes and no, structs of SIDE;
    NULL where a book is missing)."""
    ok_yes, ok_no = F.coalesce(F.col("yes.fetch_ok"), F.lit(False)), F.coalesce(F.col("no.fetch_ok"), F.lit(False))
    age = lambda s: F.coalesce(F.col(f"{s}.age_seconds"), F.lit(0.0))
    return rows.select(
        "poll_id", E.iso(F.col("poll_ts")).alias("ts"), F.lit("quote_snapshot").alias("record_type"), F.lit("clob_poll").alias("source"),
        (ok_yes | ok_no).alias("quote_capture_ok"),
        F.when(ok_yes & ok_no, "ok").when(ok_yes | ok_no, "partial_failure").otherwise("failed").alias("quote_capture_status"),
        "market_id", "slug", "title", "condition_id", "token_yes", "token_no",
        F.col("start_time").alias("market_start_time"), F.col("end_time").alias("market_end_time"), "status", "yes", "no",
        F.struct(F.col("yes.age_seconds").alias("yes_age_seconds"), F.col("no.age_seconds").alias("no_age_seconds"),
                 F.greatest(age("yes"), age("no")).alias("max_age_seconds")).alias("quote_age_diagnostics"),
        "asset",
    )


def quote_errors(rows: DataFrame) -> DataFrame:
    """quote rows with last_error: what the poll left as the last quote error."""
    why = lambda s: F.coalesce(F.col(f"{s}.error_kind"), F.col(f"{s}.error"), F.lit("unknown"))
    part = lambda s: F.coalesce(F.col(f"{s}.error_kind"), F.lit("ok"))
    text = F.when(
        F.col("quote_capture_status") == "failed", F.concat(F.lit("yes="), why("yes"), F.lit("; no="), why("no"))
    ).when(
        F.col("quote_capture_status") == "partial_failure",
        F.concat(F.lit("partial_quote_failure yes="), part("yes"), F.lit(" no="), part("no")),
    )
    return rows.withColumn("last_error", text)


def quote_warnings(polls: DataFrame) -> DataFrame:
    """Warning rows of polls without a complete market, and of polls that failed
    as a whole (column poll_error, where there is one)."""
    incomplete = "coalesce(token_yes, '') = '' or coalesce(token_no, '') = ''"
    failed = F.col("poll_error") if "poll_error" in polls.columns else F.lit(None).cast("string")
    return (
        polls.withColumn("failed", failed)
        .withColumn("warning", F.when(F.expr(incomplete), "no_active_market_for_quote_poll").when(F.col("failed").isNotNull(), "quote_poll_failed"))
        .where("warning is not null")
        .select("poll_id", E.iso(F.col("poll_ts")).alias("ts"), F.lit("warning").alias("record_type"), "warning",
                "market_id", "slug", F.when(F.col("warning") == "quote_poll_failed", F.col("failed")).alias("error"), "asset")
    )
