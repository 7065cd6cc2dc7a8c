"""Quotes from streams: polls joined with the books of their two tokens.

The join is an outer join with watermarks and a range of time, so a poll's side waits
for its book until the watermark has passed that range, and is told without it then.
Both sides go through one join; a second one after it would get sides without a book
behind its own watermark, and lose them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import expr as E
from ..operators import quotes
from .asof import asof_join
from .jobs import run_once

#: Latest times of both streams so far, in microseconds.
MARKS = "asks long, books long"


def sides(polls: DataFrame, books: DataFrame, *, lateness: str = "10 minutes", within: str = "1 minute") -> DataFrame:
    """A stream of polls (as for quotes.quote_rows()) as two rows each: the poll's
    columns, side (yes or no) and snapshot, NULL where no book of the token was fetched
    within that time of the poll. A side is told when its book comes or the watermark
    has passed. Polls without both tokens are left to quote_warnings()."""
    both = polls.where("token_yes is not null and token_yes <> '' and token_no is not null and token_no <> ''")
    tokens = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"token_{s}").alias("token")) for s in ("yes", "no")])
    asked = both.withWatermark("poll_ts", lateness).select("*", F.inline(tokens))
    taken = quotes.snapshots(books).select(
        F.col("poll_id").alias("book_poll"), F.col("token_id").alias("book_token"), E.parse_datetime(F.col("fetched_at")).alias("book_at"), F.struct(*quotes.SIDE).alias("snapshot")
    ).withWatermark("book_at", lateness)
    near = F.expr(f"poll_id = book_poll and token = book_token and book_at >= poll_ts - interval {within} and book_at <= poll_ts + interval {within}")
    return asked.join(taken, near, "left_outer").drop("token", "book_poll", "book_token", "book_at")


def paired_sides(told: DataFrame) -> DataFrame:
    """Quote rows (quotes.paired()) of the table that sides() was written to: polls
    whose two sides are told. Of several books of a side one counts."""
    own = [c for c in told.columns if c not in ("side", "snapshot")]
    one = lambda s: F.first(F.when(F.col("side") == s, F.col("snapshot")), ignorenulls=True).alias(s)
    rows = told.groupBy("poll_id").agg(*[F.first(c).alias(c) for c in own if c != "poll_id"], one("yes"), one("no"), F.count_distinct("side").alias("n_sides"))
    return quotes.paired(rows.where("n_sides = 2"))


def reuse_snapshots(requests: DataFrame, taken: DataFrame, ttl_seconds: float = SETTINGS.quote_ttl_seconds, *, lateness: str = "10 minutes") -> DataFrame:
    """quotes.reuse_snapshots() of streams: requests (token_id, ts) with the token's last
    snapshot (poll_ts, poll_id), unless it is older than the time to live."""
    values = ["best_bid", "best_ask", "mid", "spread", "fetch_ok"]
    got = asof_join(requests, taken, by=["token_id"], right_ts="poll_ts", values=values, tie="poll_id", lateness=lateness)
    age = E.seconds_since(F.col("ts"), F.col("asof_ts"))
    fresh = age <= ttl_seconds
    return got.select(*requests.columns, *[F.when(fresh, F.col(c)).alias(c) for c in ("asof_ts", *values)], F.when(fresh, age).alias("age_seconds"))


def record_sides(polls: DataFrame, books: DataFrame, root: str, checkpoint: str, *, lateness_seconds: int = 600, within_seconds: int = 60) -> None:
    """The rows of sides(), each side once, written to root/rows for paired_sides().

    A batch is joined as a table with what waits from the batch before: sides without
    a book, and books, that the watermark has not passed. Only those are carried on, so
    what arrives together is not held in a state first. The watermark is the lesser of
    the two streams' latest times, less the lateness; rows behind it are dropped. All
    goes to folders named by the batch: a batch that runs again replaces what it wrote."""
    both = polls.where("token_yes is not null and token_yes <> '' and token_no is not null and token_no <> ''")
    tokens = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"token_{s}").alias("token")) for s in ("yes", "no")])
    asked = both.select("*", F.inline(tokens)).select("poll_id", "token", F.col("poll_ts").alias("at"), F.struct(*polls.columns, "side").alias("ask"))
    taken = quotes.snapshots(books).select("poll_id", F.col("token_id").alias("token"), E.datetime_of(F.col("fetched_at")).alias("at"), F.struct(*quotes.SIDE).alias("snapshot"))
    rows = asked.unionByName(taken, allowMissingColumns=True)
    micros = 1_000_000

    def keep(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{root}/landed/batch={n}")
        landed = spark.read.schema(rows.schema).parquet(f"{root}/landed/batch={n}")
        latest = landed.agg(F.max(F.when(F.col("ask").isNotNull(), F.unix_micros("at"))).alias("asks"), F.max(F.when(F.col("ask").isNull(), F.unix_micros("at"))).alias("books"))
        before = spark.read.schema(MARKS).parquet(f"{root}/marks/batch={n - 1}").first() if n else (None, None)
        now = [max((x for x in pair if x is not None), default=None) for pair in zip(before, latest.first())]
        old, mark = (None if None in m else min(m) - lateness_seconds * micros for m in (before, now))
        open_ones = landed if old is None else landed.where(F.unix_micros("at") >= old)
        if n:
            open_ones = open_ones.unionByName(spark.read.schema(rows.schema).parquet(f"{root}/waiting/batch={n - 1}"))
        asks = open_ones.where("ask is not null").drop("snapshot")
        books = open_ones.where("ask is null").select(F.col("poll_id").alias("b_poll"), F.col("token").alias("b_token"), F.col("at").alias("b_at"), "snapshot")
        near = (F.col("poll_id") == F.col("b_poll")) & (F.col("token") == F.col("b_token")) & (F.abs(F.unix_micros("at") - F.unix_micros("b_at")) <= within_seconds * micros)
        passed = F.lit(False) if mark is None else F.unix_micros("at") + within_seconds * micros < mark
        joined = asks.join(books, near, "left").withColumn("told", F.col("b_poll").isNotNull() | passed)
        joined.where("told").select("ask.*", "snapshot").write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
        # What the watermark has passed can meet nothing any more.
        rest = open_ones.where(~passed)
        found = rest.where("ask is null").select(F.col("poll_id").alias("b_poll"), F.col("token").alias("b_token"), F.col("at").alias("b_at"))
        untold = rest.where("ask is not null").join(found, near, "left_anti")
        untold.unionByName(rest.where("ask is null")).write.mode("overwrite").parquet(f"{root}/waiting/batch={n}")
        spark.createDataFrame([tuple(now)], MARKS).write.mode("overwrite").parquet(f"{root}/marks/batch={n}")

    run_once(rows.writeStream.foreachBatch(keep), checkpoint)
