"""Low-storage alerts as a state machine, in batch and on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RANK = {"ok": 0, "low": 1, "critical": 2}
REPEAT_US = 24 * 3600 * 1_000_000
STATE = "level string, notified_us long"


def decide(level: str, now_us: int, held: tuple[str, int | None]) -> tuple[str, tuple[str, int | None]]:
    """Action (notify, clear or none) and what is remembered: level and time of the last notice."""
    before, notified = held
    if level == "ok":
        return ("clear" if before != "ok" else "none"), ("ok", None)
    if RANK[level] > RANK[before] or (level == before and (notified is None or now_us < notified or now_us - notified >= REPEAT_US)):
        return "notify", (level, now_us)
    return "none", (level, notified)


def replay(readings: DataFrame) -> DataFrame:
    """readings: device, t_us, level, seq -> with action; each device in order of arrival (seq)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held, out = ("ok", None), []
        rows = rows.sort_values("seq")
        for level, t in zip(rows.level, rows.t_us, strict=True):
            action, held = decide(level, int(t), held)
            out.append(action)
        return rows.assign(action=out)[["device", "seq", "t_us", "level", "action"]]

    return readings.groupBy("device").applyInPandas(run, "device long, seq long, t_us long, level string, action string")


class AlertMachine(StatefulProcessor):
    """The same machine for `transformWithStateInPandas`, keyed by device."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("memory", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() or ("ok", None)
        frames = list(rows)  # a device's readings of one micro-batch, which may come in any order
        if frames:
            frame = pd.concat(frames).sort_values("seq")
            out = []
            for level, t in zip(frame.level, frame.t_us, strict=True):
                action, held = decide(level, int(t), (held[0], held[1]))
                out.append(action)
            yield frame.assign(action=out)[["device", "seq", "t_us", "level", "action"]]
        self.state.update((held[0], held[1]))

    def close(self) -> None:
        pass


def alert_stream(readings: DataFrame) -> DataFrame:
    """Actions on a stream of readings; needs the RocksDB state store."""
    return readings.groupBy("device").transformWithStateInPandas(statefulProcessor=AlertMachine(), outputStructType="device long, seq long, t_us long, level string, action string", outputMode="Append", timeMode="None")


def readings_of(events: DataFrame) -> DataFrame:
    """events as readings: of 100 GiB, value percent (cut to 0-100, a tenth of it) is free."""
    from siltsieve.functions.files import storage_level

    gib = 1024.0**3
    free = F.greatest(F.lit(0.0), F.least(F.col("value"), F.lit(100.0))) / 10 * gib
    return events.select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), storage_level(free, F.lit(100 * gib)).alias("level"))
