"""Manifests of hourly segments as they close.

The state of an asset holds the rows per family of its open hours. An hour ends where
the next one with rows starts, and is told once the watermark has passed that start:
from then on no row can come to it, nor to an hour between the two."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLOSED = "asset string, start timestamp, end timestamp, told string"
_TOLD = "asset string, start long, end long, told string"
HOUR_MS = 3_600_000


def segment_handler():
    import json

    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Segments(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.counts = handle.getMapState("counts", "hour long, family string", "n long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            hours = set()
            for part in rows:
                for (hour, family), n in part.groupby(["hour", "family"]).size().items():
                    slot = (int(hour), family)
                    held = self.counts.getValue(slot)[0] if self.counts.containsKey(slot) else 0
                    self.counts.updateValue(slot, (held + int(n),))
                    hours.add(int(hour))
            for hour in hours:
                self.handle.registerTimer(hour * HOUR_MS)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs()
            told: dict = {}
            for (hour, family), (n,) in self.counts.iterator():
                told.setdefault(hour, {})[family] = n
            opened = sorted(told)
            out = []
            for hour, following in zip(opened, opened[1:]):
                if following * HOUR_MS <= now:
                    out.append((key[0], hour * HOUR_MS, following * HOUR_MS, json.dumps(told[hour])))
                    for family in told[hour]:
                        self.counts.removeKey((hour, family))
            if out:
                yield pd.DataFrame(out, columns=["asset", "start", "end", "told"])

        def close(self) -> None:
            pass

    return Segments()


def closed_segments(rows: DataFrame, *, lateness: str = "10 minutes") -> DataFrame:
    """A stream of recorded rows (asset, at, family) as its closed segments, once each
    (segments.manifests_told() makes manifests of them). The last open segment stays
    open. Needs the RocksDB state store."""
    hour = F.floor(F.unix_seconds("at") / 3600).alias("hour")
    marked = rows.where("at is not null and family is not null").withWatermark("at", lateness).select("asset", "at", hour, "family")
    told = marked.groupBy("asset").transformWithStateInPandas(segment_handler(), _TOLD, "append", "eventTime")
    return told.select("asset", F.timestamp_millis("start").alias("start"), F.timestamp_millis("end").alias("end"), "told")
