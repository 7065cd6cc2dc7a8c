"""Pieces that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or where
    it is unset a temporary folder set for this session. Only local mode may leave
    it unset: executors of a cluster would each write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialise(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs no more than the
    tasks it was running, and values that depend on task order stay fixed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that no later job reads."""
    for table in tables:
        for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
            if "/tidemark/" in path:
                where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows that one window of a running sum holds at most.
RUN_ROWS = 2_000


def running_before(rows: DataFrame, keys: list[str], order: str, value: str, span: int, out: str = "before") -> DataFrame:
    """rows with the sum of ``value`` over the rows before each, by ``order`` (whole
    numbers in 0..span-1, one row each within ``keys``, which are not null).

    Spans above RUN_ROWS are cut: sums of the cuts run first, by the same way."""
    inside = lambda by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if span <= RUN_ROWS:
        by = keys or [F.lit(0)]
        return rows.withColumn(out, F.coalesce(F.sum(value).over(inside(by)), F.lit(0)))
    cut, part, upto = f"{order}_cut", f"{order}_in", f"{order}_upto"
    rows = rows.withColumn(cut, F.floor(F.col(order) / RUN_ROWS))
    sums = rows.groupBy(*keys, cut).agg(F.sum(value).alias("_sum"))
    sums = running_before(sums, keys, cut, "_sum", -(-span // RUN_ROWS), upto).drop("_sum")
    rows = rows.withColumn(part, F.coalesce(F.sum(value).over(inside([*keys, cut])), F.lit(0)))
    return rows.join(sums, [*keys, cut]).withColumn(out, F.col(part) + F.col(upto)).drop(cut, part, upto)


def ranked(rows: DataFrame, keys: list[str], order: list, label: str) -> DataFrame:
    """rows, written once, with place (from 0, within ``keys``, by ``order``) and
    n_keyed (rows of the key). Null keys are a key.

    Rows are range-sorted over keys and order together, so a key with most of the
    rows spreads over many tasks; windows see one row per key and range."""
    spark = rows.sparkSession
    by = [F.col(k).asc_nulls_first() for k in keys] + order
    placed = rows.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    table = materialise(placed, label).withColumn("_range", F.shiftright("_at", 33))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    per = table.groupBy(*own, F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*(names or [F.lit(0)]))
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n_keyed", F.sum("_n").over(whole))
    same = F.col("_range") == F.col("_r")
    for k, name in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(name))
    found = table.join(per, same).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before"))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], "place", "n_keyed")


#: A block is one large value, so files are cut at few rows.
BLOCK_FILES = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Rows of a block at most, so that two bytes number them.
BLOCK_ROWS = 65_000


def blocks_of(batches, block_bytes: int, block_rows: int = BLOCK_ROWS):
    """(block id, record batch) cut at about so many bytes of the column text. The
    id tells the blocks of one pass apart; another pass may cut elsewhere."""
    from pyspark import TaskContext

    part, serial = TaskContext.get().partitionId(), 0
    for b in batches:
        start = size = 0
        for i, n in enumerate(len(t or b"") for t in as_bytes(b.column("text"))):
            size += n
            if size >= block_bytes or i + 1 - start >= block_rows:
                yield part << 32 | serial, b.slice(start, i + 1 - start)
                start, size, serial = i + 1, 0, serial + 1
        if start < b.num_rows:
            yield part << 32 | serial, b.slice(start)
            serial += 1


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of input after which a worker's freed memory goes back to the system.
LEAN_BYTES = 32 << 20


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and, under glibc, the heap.

    Workers outlive their tasks; what allocators keep of one stage would be missing
    in the next, two hundred MB a worker in a long pipeline."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """The function for mapInArrow that does what ``run`` does and gives freed memory
    back after every LEAN_BYTES of input and at the end of the task."""

    def spare(batches):
        seen = 0
        for b in batches:
            seen += b.nbytes
            yield b
            del b
            if seen >= LEAN_BYTES:
                give_back()
                seen = 0

    def lean_run(batches):
        try:
            yield from run(spare(batches))
        finally:
            give_back()

    return lean_run


def as_bytes(column) -> list:
    """Python bytes (None for null) of an Arrow string column, without decoding."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def binaries(values, cuts):
    """Arrow binary array whose i-th value is values[cuts[i]:cuts[i + 1]] of a numpy
    array; no loop over the values."""
    import numpy as np
    import pyarrow as pa

    values = np.ascontiguousarray(values)
    offsets = (np.asarray(cuts, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def buckets_of(hashes, n_buckets: int):
    """(buckets that get any of the sorted 64-bit hashes, cuts between them). The
    work grows with the hashes, however many buckets there are."""
    import numpy as np

    width, n = np.uint64(min((1 << 64) // n_buckets, (1 << 64) - 1)), len(hashes)
    bucket = np.minimum(hashes // width, np.uint64(n_buckets - 1)).astype(np.int64)
    head = np.flatnonzero(np.concatenate((np.ones(min(1, n), bool), bucket[1:] != bucket[:-1])))
    return bucket[head], np.append(head, n)


def flat(column, kind):
    """(values, cuts) of a binary column without nulls: what binaries() was made of."""
    import numpy as np
    import pyarrow as pa

    out, cuts = [], [np.zeros(1, np.int64)]
    size = np.dtype(kind).itemsize
    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(x):
            wide = np.int64 if pa.types.is_large_binary(x.type) else np.int32
            at = np.frombuffer(x.buffers()[1], wide)[x.offset : x.offset + len(x) + 1].astype(np.int64)
            if at[-1] > at[0]:
                out.append(np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind))
            cuts.append((at[1:] - at[0]) // size + cuts[-1][-1])
    return np.concatenate(out) if out else np.zeros(0, kind), np.concatenate(cuts)


def text_bytes(docs: DataFrame, text_col: str = "text"):
    """Sum of UTF-8 bytes and number of rows; one scan, partial aggregates."""
    row = docs.agg(
        F.sum(F.octet_length(F.col(text_col))).alias("b"), F.count(F.lit(1)).alias("n")
    ).first()
    return int(row["b"] or 0), int(row["n"])
