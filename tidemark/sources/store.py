"""Read landed tables, write and read hourly segments (JSON lines or Parquet)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators.segments import with_segment
from . import schemas

LANDED = {"raw_frames": schemas.RAW_FRAMES, "book_responses": schemas.BOOK_RESPONSES, "catalog_responses": schemas.CATALOG_RESPONSES}


def read_landed(spark: SparkSession, name: str, path: str, *, format: str = "parquet", stream: bool = False) -> DataFrame:
    """A landed table with its declared schema, as a batch or a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(LANDED[name]).format(format).load(path)


def kept(rows: DataFrame, path: str) -> DataFrame:
    """rows written to path and read back: for what several jobs start from."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def encoded(rows: DataFrame) -> DataFrame:
    """rows with timestamps as ISO text; JSON has no other types to mind."""
    return rows.select(*[E.iso(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name) for f in rows.schema])


def write_segments(rows: DataFrame, root: str, family: str, *, written_at: str = "ts", format: str = "json") -> None:
    """Append rows to the family's files, one folder per UTC hour written; NULLs
    are written out. written_at is a timestamp or ISO text column."""
    at = F.col(written_at)
    placed = rows.withColumn("_at", at if rows.schema[written_at].dataType.typeName() == "timestamp" else E.parse_datetime(at))
    placed = with_segment(placed, "_at").drop("_at")
    encoded(placed).write.mode("append").partitionBy("segment_date", "segment_hour").option("ignoreNullFields", "false").format(format).save(f"{root}/{family}")


def read_segments(spark: SparkSession, root: str, family: str, *, schema: str | None = None, format: str = "json") -> DataFrame:
    """A family's rows with segment_date and segment_hour; filters on these two
    prune folders."""
    ddl = schema or schemas.RECORDED[family]
    return spark.read.schema(f"{ddl}, {schemas.PARTITIONS}").format(format).load(f"{root}/{family}")


def list_segments(spark: SparkSession, root: str) -> DataFrame:
    """family, segment_date, segment_hour, files and bytes of what stands below root,
    from the listing of the files alone: none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(root)
    part = lambda k: F.regexp_extract("path", r"/([^/]+)/segment_date=([0-9-]+)/segment_hour=([0-9]{2})/[^/]+$", k)
    rows = files.select(part(1).alias("family"), part(2).alias("segment_date"), part(3).alias("segment_hour"), "length")
    rows = rows.where("family <> '' and family <> 'segment_manifest'")
    return rows.groupBy("family", "segment_date", "segment_hour").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def write_manifests(manifest_rows: DataFrame, root: str) -> None:
    """Manifests as JSON, members in the order of their names."""
    keys = ["segment_date", "segment_hour"]
    ordered = sorted(c for c in manifest_rows.columns if c not in keys)
    manifest_rows.select(*keys, *ordered).write.mode("append").partitionBy(*keys).option("ignoreNullFields", "false").json(f"{root}/segment_manifest")


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{schemas.SEGMENTS}, {schemas.PARTITIONS}").json(f"{root}/segment_manifest")
