"""Heartbeats on a stream: event-time timers over the last value of every signal.

An asset's state is what its signals said last. Rows come in no order within the
watermark, so a beat can be told only when the watermark has passed it: until then
the last value of every signal within each beat's span waits under (beat, signal).
A timer per asset fires at its next beat, moves what waited for it into the state,
and sets the next timer. All of it is in the checkpoint, so a restart between two
beats changes nothing. NULL is a value like others: it replaces the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SETTINGS

BEATS = "asset string, at timestamp, told string"
_TOLD = "asset string, us long, told string"
#: Beats that leave a timer's call together.
PAGE = 1_000
#: Rows that a task holds back while it reduces them.
HELD = 200_000


def beat_handler(every_seconds: int):
    import json

    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    step = every_seconds * 1_000_000

    def keep_last(rows: dict, row: tuple) -> None:
        """The last row of a beat and signal, by time and seq; the later one of equals."""
        held = rows.get(row[:2])
        if held is None or held[2:4] <= row[2:4]:
            rows[row[:2]] = row

    class Beats(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.next = handle.getValueState("next", "beat long")
            self.told = handle.getMapState("told", "signal string", "value string")
            # A list is read and written as a whole; a map would be asked entry by entry.
            self.waiting = handle.getListState("waiting", "beat long, signal string, at long, seq string, value string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            came: dict = {}
            for part in rows:
                part = part.assign(beat=-(-part["us"] // step), seq=part["seq"].fillna(""))
                last = part.sort_values(["us", "seq"], kind="stable").drop_duplicates(["beat", "signal"], keep="last")
                for beat, signal, at, seq, value in zip(last["beat"], last["signal"], last["us"], last["seq"], last["value"]):
                    keep_last(came, (int(beat), signal, int(at), seq, None if pd.isna(value) else value))
            if came:
                self.waiting.appendList(list(came.values()))
            first = min((beat for beat, _ in came), default=None)
            due = self.next.get()[0] if self.next.exists() else None
            if first is not None and (due is None or first < due):
                if due is not None:
                    self.handle.deleteTimer(due * step // 1000)
                self.next.update((first,))
                self.handle.registerTimer(first * step // 1000)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            beat, until = self.next.get()[0], timerValues.getCurrentWatermarkInMs() * 1000 // step
            # What waits for the beats up to the watermark, beat by beat.
            moved: dict = {}
            waits: dict = {}
            for row in self.waiting.get():
                keep_last(waits, tuple(row))
            for (at, signal), row in waits.items():
                if at <= until:
                    moved.setdefault(at, {})[signal] = row[4]
            rest = [row for (at, _), row in waits.items() if at > until]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            told = {signal[0]: value[0] for signal, value in self.told.iterator()}
            page: list = []
            while beat <= until:
                told |= moved.get(beat, {})
                page.append((key[0], beat * step, json.dumps(told)))
                beat += 1
                if len(page) == PAGE or beat > until:
                    yield pd.DataFrame(page, columns=["asset", "us", "told"])
                    page = []
            for signal in {s for m in moved.values() for s in m}:
                self.told.updateValue((signal,), (told[signal],))
            self.next.update((beat,))
            self.handle.registerTimer(beat * step // 1000)

        def close(self) -> None:
            pass

    return Beats()


def latest_of_parts(every_seconds: int):
    """Of a task's rows the last per asset, beat and signal: a function for mapInPandas.
    Up to HELD rows are held back, so that rows in no order are reduced as well."""
    step = every_seconds * 1_000_000

    def reduce(parts):
        import pandas as pd

        def last(rows):
            rows = rows.sort_values(["us", "seq"], kind="stable")
            return rows[~rows.assign(beat=-(-rows["us"] // step))[["asset", "beat", "signal"]].duplicated(keep="last")]

        held: list = []
        for part in parts:
            held.append(part.assign(seq=part["seq"].fillna("")))
            if sum(map(len, held)) >= HELD:
                held = [last(pd.concat(held))]
                if len(held[0]) >= HELD // 2:
                    yield held.pop()
        if held:
            yield last(pd.concat(held))

    return reduce


def beats(signals: DataFrame, *, every_seconds: int = SETTINGS.heartbeat_seconds, lateness: str = "10 minutes") -> DataFrame:
    """Streaming beats (asset, at, told) of signals (health.SIGNAL_ROWS): one row per
    asset and multiple of ``every_seconds``, from the first at or after the asset's
    first signal to the watermark. Signals later than the watermark are dropped. A
    batch of an asset is read in parts; the state holds one value per signal, and one
    per signal and beat that the watermark has not passed. Needs the RocksDB store."""
    # Times go in and out as numbers, whatever the session's time zone is.
    rows = signals.where("at is not null").select("asset", "signal", "seq", "value", F.unix_micros("at").alias("us"))
    # Every task sends one row per beat and signal on, so an asset's state is asked for those alone.
    rows = rows.mapInPandas(latest_of_parts(every_seconds), "asset string, signal string, seq string, value string, us long")
    rows = rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", lateness)
    told = rows.groupBy("asset").transformWithStateInPandas(beat_handler(every_seconds), _TOLD, "append", "eventTime")
    return told.select("asset", F.timestamp_micros("us").alias("at"), "told")
