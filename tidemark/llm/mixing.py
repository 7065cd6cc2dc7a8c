"""Mix sources to target weights by weighted fair queueing.

Every document of a source is shuffled (by a seeded digest of its id) and gets
a virtual finish time: the source's words up to and including it, divided by
the source's target. Sorting all documents by that time and cutting at the
total budget gives each source its share. A source that is asked for more than
it holds is read again, in another order, up to ``max_repeats`` times.

Both running sums (within a source, and over the mix) are taken in levels: sums of
buckets, running sums over the buckets (which are cut again where they are many),
then a window inside a bucket. A source with a third of all rows is therefore
spread over many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, lean, materialise, running_before

#: Rows that one bucket of a running sum should hold, about.
BUCKET_ROWS = 2000


def sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", also: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size (words between ASCII white space; 0 for null text) and
    the columns named in ``also``. A text is split whole, at some hundred bytes of
    memory a word."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *also, F.col(text_col).alias("text"))
    names = ["doc_id", "source", *also]
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names]

    def count(batches):
        import pyarrow as pa

        for b in batches:
            n = [len(t.split()) if t else 0 for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64())], [*names, "size"])

    return rows.mapInArrow(lean(count), ", ".join([*kinds, "size long"]))


def source_targets(
    sized: DataFrame, weights: Sequence[float], budget_ratio: float, max_repeats: int
) -> DataFrame:
    """source, source_rank, source_size, target: one row per source.

    Targets fill up by weight to a common level; the level is found in closed
    form from running sums over the sources ordered by cap per weight. The
    windows without a partition key see one row per source, never documents."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everyone = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_rank") % len(weights)).cast("int") + 1)
    per = (
        per.withColumn("source_rank", F.row_number().over(by_name) - 1)
        .withColumn("w", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("budget", F.sum("source_size").over(everyone) * F.lit(float(budget_ratio)))
    )
    fill = Window.orderBy(F.col("cap") / F.col("w"), "source_rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    # The first level that its own source does not cap holds for all after it.
    ratio = F.col("cap") / F.col("w")
    free = F.when(F.col("level") <= ratio, F.struct(ratio.alias("ratio"), "source_rank", "level"))
    per = per.withColumn("water", F.min(free).over(everyone)["level"])
    per = per.withColumn(
        "target", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("w")))
    )
    return per.select("source", "source_rank", "source_size", "target", "budget")


def take(
    sized: DataFrame,
    *,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    budget_ratio: float = 1.5,
    max_repeats: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """sized's columns with source_size, target and times (how often it is taken)."""
    rows = materialise(sized.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    n = max(1, rows.count())
    per = materialise(source_targets(rows, weights, budget_ratio, max_repeats), "mix-targets")
    digits = 1
    while 16**digits * BUCKET_ROWS < n and digits < 8:
        digits += 1
    goal = per.select(F.col("source").alias("t_source"), "source_rank", "source_size", "target", "budget")
    # One row per source: the planner broadcasts it only below its own size limit.
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("pass").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    place = F.col("pass") * F.lit(16**digits) + F.conv(F.substring("key", 1, digits), 16, 10).cast("long")
    items = (
        rows.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(max_repeats)])))
        .withColumn("key", key)
        .withColumn("bucket", place)
    )
    # Level 1: words before a bucket of a source and pass.
    sums = items.groupBy("source_rank", "bucket").agg(F.sum("size").alias("in_bucket"))
    offsets = running_before(sums, ["source_rank"], "bucket", "in_bucket", max_repeats * 16**digits).drop("in_bucket")
    inside = Window.partitionBy("source_rank", "bucket").orderBy("key", "size", "_row")
    tagged = items.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(offsets, ["source_rank", "bucket"])
    finish = F.when(F.col("target") > 0, (F.col("before") + F.col("within")) / F.col("target")).otherwise(F.lit(0.0))
    ranges = max(64, n // BUCKET_ROWS)
    # The budget runs out about time 1; what ends long after it is one range.
    tagged = materialise(
        tagged.withColumn("finish", finish)
        .withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(4 * ranges)).cast("long"))
        .drop("before", "within", "bucket"),
        "mix-tags",
    )
    # Level 2: words before a range of finish times; only the range in which the
    # budget runs out needs its own order.
    ends = running_before(tagged.groupBy("range").agg(F.sum("size").alias("words")), [], "range", "words", 4 * ranges + 1)
    budget = (per.agg(F.max("budget")).first()[0]) or 0.0
    cut = ends.where(F.col("before") + F.col("words") > budget).orderBy("range").limit(1).select("range", "before").first()
    if cut is None:
        taken = tagged.withColumn("in", F.lit(True))
    else:
        order = Window.partitionBy("range").orderBy("finish", "source_rank", "pass", "key", "size", "_row")
        last = tagged.where(F.col("range") == cut["range"]).withColumn(
            "in", (F.lit(cut["before"]) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))) <= budget
        )
        rest = tagged.where(F.col("range") != cut["range"]).withColumn("in", F.col("range") < cut["range"])
        taken = rest.unionByName(last)
    return taken.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in (*sized.columns, "source_size", "target")],
        F.sum(F.col("in").cast("long")).alias("times"),
    ).drop("_row")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes it, with docs' own
    columns, whatever their names are.

    Null texts and texts without words have size 0: they take no budget and stay,
    once each, wherever the cut falls; repeated rows are documents each; an empty table stays empty. Rows are numbered in a copy of
    docs, and found again by number."""
    row = f"_{uuid.uuid4().hex}"
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    often = F.when(F.col("size") == 0, F.lit(1).cast("long")).otherwise(F.col("times"))
    times = take(sizes(numbered, also=[row]), **options).select(F.col(row).alias(f"{row}r"), often.alias(f"{row}t")).where(F.col(f"{row}t") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{row}t")))
    return numbered.join(times, F.col(row) == F.col(f"{row}r")).withColumn(f"{row}c", copies).drop(row, f"{row}r", f"{row}t", f"{row}c")
