"""Structured Streaming forms of the recorder's jobs.

Stateless jobs (ticks, snapshots, diagnostics) take streams as they are. Here is
what needs state or a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import routing, ticks
from ..operators.segments import with_segment


def run_once(query_writer, checkpoint: str):
    """Run a stream over what is there and stop."""
    q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def record_ticks(frames: DataFrame, root: str, checkpoint: str) -> None:
    """Write a stream of frames as hourly JSON segments of both feeds; every
    file is committed once, also after a restart from the checkpoint."""
    rows = ticks.all_ticks(frames)
    placed = with_segment(rows.withColumn("_at", E.datetime_of(F.col("ts"))), "_at").drop("_at")
    run_once(
        placed.writeStream.format("json").option("ignoreNullFields", "false").option("path", root).partitionBy("family", "segment_date", "segment_hour"),
        checkpoint,
    )


def hourly_counts(frames: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Streaming rows per hour, family and record type; an hour is final when
    the watermark has passed it."""
    rows = ticks.all_ticks(frames).withColumn("at", E.datetime_of(F.col("ts"))).withWatermark("at", lateness)
    return (
        rows.groupBy(F.window("at", "1 hour"), "family", "record_type")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.col("window.start").alias("segment_start"), "family", "record_type", "n_rows")
    )


def route_changes(decisions: DataFrame, root: str, checkpoint: str) -> None:
    """Change detection over a stream of decisions (poll_id, poll_ts, asset,
    routing_score and the identity fields), in the order of its batches.

    A batch runs as routing.route_rows() does, cut into time slices, so an asset's
    batch needs no task of its own; what it starts from is one row per asset, written
    beside the rows of the batch before. Both go to folders named by the batch, so a
    batch that runs again replaces what it wrote."""

    def keep(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows, ends = f"{root}/rows/batch={n}", f"{root}/identities/batch={n}"
        known = spark.read.schema(f"{IDENTITIES}, batch long").parquet(f"{root}/identities") if n else None
        before = known.where(F.col("batch") == n - 1).drop("batch") if n else None
        routing.route_rows(batch, before=before).write.mode("overwrite").parquet(rows)
        last = routing.last_identities(batch)
        if n:
            rest = before.join(last.select("asset"), before["asset"].eqNullSafe(last["asset"]), "left_anti")
            last = last.unionByName(rest)
        last.write.mode("overwrite").parquet(ends)

    run_once(decisions.writeStream.foreachBatch(keep), checkpoint)


IDENTITIES = "asset string, identity struct<i:struct<" + ",".join(f"{c}:string" for c in routing.IDENTITY) + ">>"
