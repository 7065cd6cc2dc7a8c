"""As-of and interval joins.

Few keys carry all history here, so a window per key would put everything into
one task. Rows are therefore joined inside time slices; what was in force when
a slice began comes from a small table with the last row of every slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def slice_bounds(rows: DataFrame, ts: str, n: int) -> list[int]:
    """Times (microseconds) that cut rows into n parts of about equal size, from a
    quantile sketch: one pass, and n - 1 numbers at most, fewer where times repeat."""
    if n < 2:
        return []
    at = F.array(*[F.lit(i / n) for i in range(1, n)])
    return sorted(set(rows.agg(F.percentile_approx(F.unix_micros(ts), at, F.lit(10 * n)).alias("x")).first()["x"] or []))


def _slot_by(bounds: list[int]):
    """Slice of a time column: how many bounds are at or before it, by halving."""
    table = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]

    def of(c: str):
        us = F.unix_micros(F.col(c))
        forward = lambda at, step: at + F.when(F.coalesce(F.get(table, at + step - 1) <= us, F.lit(False)), step).otherwise(0)
        return F.when(F.col(c).isNotNull(), F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), forward).cast("long"))

    return of


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: list[str],
    left_ts: str = "ts",
    right_ts: str = "ts",
    values: list[str],
    tie: list[str] | None = None,
    tolerance_seconds: float | None = None,
    slice_seconds: int = 3600,
    bounds: list[int] | None = None,
    prefix: str = "",
) -> DataFrame:
    """left with ``values`` (and the time, as ``prefix``asof_ts) of the last row
    of right at or before it, per ``by``.

    A NULL value counts as a value. Ties in right go to the last by ``tie``.
    Rows without a time or key keep NULLs; a match older than the tolerance
    counts as none (its limit included). Slices have one length; where times crowd,
    give the ``bounds`` of slices (slice_bounds() of the larger side)."""
    packed = F.struct(F.col(right_ts).alias("_at"), *[F.col(v).alias(f"_v_{v}") for v in values])
    slot = _slot_by(bounds) if bounds else lambda c: F.floor(F.unix_micros(F.col(c)) / (slice_seconds * 1_000_000))
    tie = tie or []
    events = right.where(F.col(right_ts).isNotNull()).select(
        *[F.col(k).alias(f"_k_{k}") for k in by], slot(right_ts).alias("_slot"), F.col(right_ts).alias("_ts"),
        F.lit(0).alias("_side"), F.struct(*[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)] or [F.lit(0).alias("_t0")]).alias("_tie"),
        packed.alias("_row"), F.lit(None).cast(left_row_type(left)).alias("_left"),
    )
    asks = left.select(
        *[F.col(k).alias(f"_k_{k}") for k in by], slot(left_ts).alias("_slot"), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"),
        F.lit(None).cast(events.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(events.schema["_row"].dataType).alias("_row"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    keys = [f"_k_{k}" for k in by]
    # Level 1: the last row of every slice, carried to slices that ask.
    ends = events.groupBy(*keys, "_slot").agg(F.max_by("_row", F.struct("_ts", "_tie")).alias("_end"))
    slots = ends.unionByName(asks.where("_slot is not null").select(*keys, "_slot").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    slots = slots.groupBy(*keys, "_slot").agg(F.max("_end").alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(*[F.col(k).alias(f"c{k}") for k in keys], F.col("_slot").alias("c_slot"), F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    # Level 2: inside the slice.
    order = Window.partitionBy(*keys, "_slot").orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.unionByName(asks).withColumn("_seen", F.last("_row", ignorenulls=True).over(order)).where("_side = 1")
    same = F.col("_slot") == F.col("c_slot")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"c{k}"))
    found = seen.join(carried, same, "left").withColumn("_found", F.when(F.col("_ts").isNotNull(), F.coalesce("_seen", "_carried")))
    if tolerance_seconds is not None:
        age = (F.unix_micros("_ts") - F.unix_micros(F.col("_found._at"))) / 1e6
        found = found.withColumn("_found", F.when(age <= tolerance_seconds, F.col("_found")))
    return found.select(
        "_left.*", F.col("_found._at").alias(f"{prefix}asof_ts"), *[F.col(f"_found._v_{v}").alias(f"{prefix}{v}") for v in values]
    )


def left_row_type(left: DataFrame) -> str:
    return left.schema.simpleString()


def interval_join(
    instants: DataFrame,
    intervals: DataFrame,
    *,
    by: list[str],
    ts: str,
    start: str,
    end: str,
    lead_seconds: int,
    wide_seconds: int = 86_400,
) -> DataFrame:
    """Pairs of instants and intervals with start - lead <= ts < end.

    Intervals are laid out over buckets as wide as the lead, so that the join is
    an equi-join with a residual; the few that span more than ``wide_seconds``
    go by day instead. Columns of both sides must not clash apart from ``by``."""
    instants = instants.where(F.col(ts).isNotNull())
    intervals = intervals.where(F.col(start).isNotNull() & (F.col(start) < F.col(end)))
    width = F.unix_seconds(end) - F.unix_seconds(start)

    def part(rows: DataFrame, step: int) -> DataFrame:
        low = F.floor((F.unix_seconds(start) - lead_seconds) / step)
        high = F.floor(F.unix_seconds(end) / step)
        laid = rows.withColumn("_b", F.explode(F.sequence(low, high)))
        asked = instants.withColumn("_b", F.floor(F.unix_seconds(ts) / step))
        inside = (F.unix_micros(ts) >= F.unix_micros(start) - lead_seconds * 1_000_000) & (F.col(ts) < F.col(end))
        return asked.join(laid, [*by, "_b"]).where(inside).drop("_b")

    step = max(lead_seconds, 1)
    return part(intervals.where(width <= wide_seconds), step).unionByName(part(intervals.where(width > wide_seconds), 86_400))
