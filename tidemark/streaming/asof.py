"""As-of join of two streams.

A key's rows wait in its state in the order of their time. Once the watermark has
passed a left row, no right row at or before it can come any more, and it gets its
answer; right rows that no later answer needs leave the state, but for the last."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Timestamps as JSON text, to the microsecond.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Left rows are answered second by second, right rows leave minute by minute.
STEP, SWEEP = 1_000_000, 60_000_000


def asof_handler(keys: list[str]):
    from bisect import bisect_right

    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class AsOf(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.asks = handle.getMapState("asks", "at long, nth long", "row string")
            self.events = handle.getMapState("events", "at long, tie string, nth long", "row string")
            self.seen = handle.getValueState("seen", "n long, watermark long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            n, done = self.seen.get() if self.seen.exists() else (0, -1)
            due = set()
            for part in rows:
                for at, side, tie, row in zip(part["us"].tolist(), part["side"], part["tie"], part["row"]):
                    n += 1
                    if side:
                        self.asks.updateValue((at, n), (row,))
                    else:
                        self.events.updateValue((at, tie if isinstance(tie, str) else "", n), (row,))
                    step = STEP if side else SWEEP
                    due.add(-(-at // step) * step // 1000)
            for at in due:
                self.handle.registerTimer(at)
            self.seen.update((n, done))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            n, done = self.seen.get()
            if done == now:  # one look at the state per watermark
                return
            self.seen.update((n, now))
            passed = now * 1000 // STEP * STEP
            asks = sorted((k[0], k[1], v[0]) for k, v in self.asks.iterator() if k[0] <= passed)
            events = sorted((k[0], k[1], k[2], v[0]) for k, v in self.events.iterator() if k[0] <= passed)
            times = [e[0] for e in events]
            out = []
            for at, nth, row in asks:
                i = bisect_right(times, at) - 1
                out.append((*key, row, events[i][3] if i >= 0 else None, times[i] if i >= 0 else None))
                self.asks.removeKey((at, nth))
            for at, tie, nth, _ in events[:-1]:
                self.events.removeKey((at, tie, nth))
            if out:
                yield pd.DataFrame(out, columns=[*keys, "l", "r", "asof_us"]).astype({"asof_us": "Int64"})

        def close(self) -> None:
            pass

    return AsOf()


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_ts: str = "ts", right_ts: str = "ts", values: list[str], tie: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """operators.asof.asof_join() of streams: left with asof_ts and ``values`` of the
    last row of right at or before it; ties in right go to the last by ``tie`` (compared
    as text). A left row is told once the watermark has passed its second. Rows behind
    the watermark, and rows without a time, are dropped. Needs the RocksDB store."""
    lefts = left.select(*by, F.col(left_ts).alias("at"), F.lit(1).alias("side"), F.lit("").alias("tie"), F.to_json(F.struct(*[F.col(c) for c in left.columns]), JSON_TIMES).alias("row"))
    order = F.coalesce(F.col(tie).cast("string"), F.lit("")) if tie else F.lit("")
    rights = right.select(*by, F.col(right_ts).alias("at"), F.lit(0).alias("side"), order.alias("tie"), F.to_json(F.struct(*values), JSON_TIMES).alias("row"))
    both = lefts.unionByName(rights).where("at is not null").withColumn("us", F.unix_micros("at")).withWatermark("at", lateness)
    kinds = ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in by)
    told = both.groupBy(*by).transformWithStateInPandas(asof_handler(by), f"{kinds}, l string, r string, asof_us long", "append", "eventTime")
    of = right.select(*values).schema
    return told.select(F.from_json("l", left.schema, JSON_TIMES).alias("l"), F.from_json("r", of, JSON_TIMES).alias("r"), "asof_us").select("l.*", F.timestamp_micros("asof_us").alias("asof_ts"), "r.*")
