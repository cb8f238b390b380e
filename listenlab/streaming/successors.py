"""SM2, SM5: successive plays of a listener's session as a stream, with state and timers of their own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that states with timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "event_id long, track_id long, at_us long"
PAIR = "user_id long, event_id long, a long, b long"


class Successors(StatefulProcessor):
    """Holds a listener's plays until the watermark has passed them, then pairs them in order; the last one waits for one gap."""

    def __init__(self, gap_s: int):
        self.gap_s = gap_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)
        self.last = handle.getValueState("last", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: tuple(r) for r in self.waiting.get()} if self.waiting.exists() else {}
        first = min((r[2] for r in held.values()), default=None)
        for part in rows:
            for event, track, at in zip(part["event_id"], part["track_id"], part["at_us"], strict=True):
                if int(event) not in held:  # repeated events come once
                    held[int(event)] = (int(event), None if pd.isna(track) else int(track), int(at))
        self.waiting.put(list(held.values()))
        # one timer at a time: for the play that passes first
        now = min((r[2] for r in held.values()), default=None)
        if now is not None and (first is None or now < first):
            self.handle.registerTimer(now // 1000 + 1)
        yield pd.DataFrame(columns=["user_id", "event_id", "a", "b"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((tuple(r) for r in held if r[2] // 1000 < passed), key=lambda r: (r[2], r[0]))
        last = tuple(self.last.get()) if self.last.exists() else None
        pairs = []
        for event in due:
            if last and event[0] == last[0]:
                continue
            if last and event[2] // 1_000_000 - last[2] // 1_000_000 <= self.gap_s and None not in (event[1], last[1]) and event[1] != last[1]:
                pairs.append((key[0], event[0], last[1], event[1]))
            last = event
        left = [tuple(r) for r in held if r[2] // 1000 >= passed]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(r[2] for r in left) // 1000 + 1)
        else:
            self.waiting.clear()
        if last and not left and last[2] // 1000 + self.gap_s * 1000 + 1000 < passed:
            self.last.clear()  # whoever comes now comes too late to follow it
        elif last:
            self.last.update(last)
            if due and not left:
                self.handle.registerTimer(last[2] // 1000 + self.gap_s * 1000 + 1001)
        yield pd.DataFrame(pairs, columns=["user_id", "event_id", "a", "b"])

    def close(self) -> None:
        pass


def successors(plays: DataFrame, gap_s: int = 1800, late: str = "1 day") -> DataFrame:
    """(user_id, event_id, a, b) of streamed plays (user_id, event_id, track_id, played_at): successive different tracks at most ``gap_s`` seconds apart, the bound included.

    As `evaluate.session_pairs` by user, for plays that come in any order, repeatedly too, but no later than ``late``. A
    play's pair comes once the watermark has passed it. State ends one gap after a listener's last play.
    """
    from pyspark.sql import functions as F

    plays.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = plays.withWatermark("played_at", late).withColumn("at_us", F.unix_micros(F.col("played_at").cast("timestamp")))
    return rows.groupBy("user_id").transformWithStateInPandas(Successors(gap_s), outputStructType=PAIR, outputMode="append", timeMode="EventTime")
