"""Hourly segments: layout, manifests and their catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FAMILIES, RECORDER_VERSION
from ..functions import expr as E


def with_segment(rows: DataFrame, written_at: str = "ts") -> DataFrame:
    """Adds segment_date and segment_hour (texts, UTC) of the time written."""
    return rows.withColumn("segment_date", F.date_format(written_at, "yyyy-MM-dd")).withColumn("segment_hour", F.date_format(written_at, "HH"))


def segment_start() -> Column:
    return F.to_timestamp(F.concat_ws(" ", "segment_date", "segment_hour"), "yyyy-MM-dd HH")


def counts(rows: DataFrame) -> DataFrame:
    """Rows per segment and family, one column per family, zeros kept."""
    return rows.groupBy("segment_date", "segment_hour").pivot("family", list(FAMILIES)).count().na.fill(0, list(FAMILIES))


def manifests(rows: DataFrame, *, asset: str | None = None, output_root: str = "", closed_at: Column | None = None) -> DataFrame:
    """One manifest per segment of rows (segment_date, segment_hour, family). A
    segment ends where the next one with rows starts; the last one ends at
    closed_at, or is left out while still open (closed_at None)."""
    # One row per hour: a window over all segments is small.
    w = Window.orderBy("segment_date", "segment_hour")
    end = F.lead(segment_start()).over(w)
    done = counts(rows).withColumn("start", segment_start()).withColumn("end", end if closed_at is None else F.coalesce(end, closed_at))
    files = F.create_map(*[x for f in FAMILIES for x in (F.lit(f"{f}.jsonl"), F.col(f))])
    return _manifest(done.where("end is not null").withColumn("row_counts", files).withColumn("asset", F.lit(asset).cast("string")), output_root)


def _manifest(done: DataFrame, output_root: str) -> DataFrame:
    return done.select(
        "segment_date", "segment_hour",
        E.iso(F.col("start")).alias("segment_start_utc"), E.iso(F.col("end")).alias("segment_end_utc"),
        F.lit(True).alias("closed_cleanly"), "row_counts", F.lit(RECORDER_VERSION).alias("recorder_version"),
        "asset", F.lit(output_root).alias("output_root"),
    )


def manifests_told(closed: DataFrame, *, output_root: str = "") -> DataFrame:
    """Manifests of closed segments as a stream tells them (asset, start, end, told:
    rows by family as JSON text); families without rows count 0."""
    told = F.from_json("told", "map<string,bigint>")
    files = F.create_map(*[x for f in FAMILIES for x in (F.lit(f"{f}.jsonl"), F.coalesce(told[f], F.lit(0).cast("long")))])
    return _manifest(with_segment(closed, "start").withColumn("row_counts", files), output_root)


def catalogue(rows: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Segments with state closed (with a manifest) or active (the last without);
    earlier ones without a manifest are orphaned."""
    found = rows.select("segment_date", "segment_hour").distinct()
    keys = ["segment_date", "segment_hour"]
    rows = found.join(manifest_rows.withColumn("closed", F.lit(True)), keys, "left")
    key = F.when(F.col("closed").isNull(), F.concat(*keys))
    last = F.max(key).over(Window.partitionBy(F.lit(0)))  # a few rows per segment
    state = F.when(F.col("closed"), "closed").when(key == last, "active").otherwise("orphaned")
    return rows.withColumn("state", state).drop("closed")


def latest_closed(manifest_rows: DataFrame) -> DataFrame:
    """The manifest of the last closed segment."""
    return manifest_rows.groupBy().agg(F.max_by(F.struct(*manifest_rows.columns), "segment_start_utc").alias("m")).where("m is not null").select("m.*")
