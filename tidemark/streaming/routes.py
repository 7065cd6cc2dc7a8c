"""Routing on a stream of catalogue responses: one decision per poll, once.

A poll's requests land in several files. Its rows wait until all attempts are there
(where the rows say how many there are) or the watermark has passed the poll; then they
leave together, and the batch job routes whole polls.

A batch is taken as a table with the rows that wait from the batch before: polls that
arrive together do not pass through a state, a key at a time, first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

from ..operators import routing
from .jobs import run_once

#: Polls that have left and that the watermark has not passed.
LEFT = "poll_id string, at timestamp"
#: The latest time so far, less the lateness, in microseconds.
MARK = "mark long"


def record_routes(responses: DataFrame, root: str, checkpoint: str, *, lateness: str = "10 minutes", route: Callable[[DataFrame], DataFrame] = routing.route) -> None:
    """Route whole polls of a stream of responses (schemas.CATALOG_RESPONSES, and
    n_expected where the number of a poll's attempts is known) with ``route`` (responses
    to decisions): a poll's rows leave in one batch. Rows after that, behind the
    watermark, and without a time, are dropped.

    The watermark is the latest time less the lateness: rows are behind it by what came
    before their batch, polls leave by what came with it. Everything goes to a folder per
    batch, which a batch that runs again replaces: the open rows to root/polls, by whether
    their poll is complete; decisions to root/decisions; to root/left and root/marks what
    the next batch must know."""
    expected = F.col("n_expected") if "n_expected" in responses.columns else F.lit(None)
    rows = responses.where("poll_ts is not null").withColumn("n_expected", expected.cast("long"))
    own = [c for c in responses.columns if c != "n_expected"]
    poll = Window.partitionBy("poll_id")
    at = F.unix_micros("at")
    held_schema = StructType([*rows.schema, StructField("at", TimestampType()), StructField("complete", BooleanType())])

    def decide(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(MARK).parquet(f"{root}/marks/batch={n - 1}").first()[0] if n else None
        fresh = batch if before is None else batch.where(F.unix_micros("poll_ts") >= before)
        if n:
            left = spark.read.schema(LEFT).parquet(f"{root}/left/batch={n - 1}")
            fresh = fresh.join(left, fresh["poll_id"].eqNullSafe(left["poll_id"]), "left_anti")
            waiting = spark.read.schema(held_schema).parquet(f"{root}/polls/batch={n - 1}").where("not complete")
            waiting = waiting if before is None else waiting.where(at >= before)
            fresh = fresh.unionByName(waiting.select(fresh.columns))
        complete = F.coalesce(F.count(F.lit(1)).over(poll) >= F.max("n_expected").over(poll), F.lit(False))
        kept = fresh.select("*", F.max("poll_ts").over(poll).alias("at"), complete.alias("complete"))
        kept.write.mode("overwrite").partitionBy("complete").parquet(f"{root}/polls/batch={n}")
        held = spark.read.schema(held_schema).parquet(f"{root}/polls/batch={n}")
        latest = held.agg(F.unix_micros(F.max("at") - F.expr(f"interval {lateness}"))).first()[0]
        mark = max((x for x in (before, latest) if x is not None), default=None)
        passed = F.lit(False) if mark is None else at < mark
        whole = held.where(F.col("complete") | passed)
        if not whole.isEmpty():
            route(whole.select(own)).write.mode("overwrite").parquet(f"{root}/decisions/batch={n}")
        gone = whole.select("poll_id", "at")
        if n:
            gone = gone.unionByName(left)
        gone.where(~passed).distinct().write.mode("overwrite").parquet(f"{root}/left/batch={n}")
        spark.createDataFrame([(mark,)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/batch={n}")

    run_once(rows.writeStream.foreachBatch(decide), checkpoint)
