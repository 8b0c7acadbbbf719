"""Streams that remember: persons' labels that stay the same over a conversation, and duplicates within a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.fold import redact_with_labels


class Pseudonyms(StatefulProcessor):
    """Redacts a key's texts in order of time and place, with one label for a person in all of them.

    Labels are kept until no text of the key has come for ``keep_seconds`` of event time; a timer then clears them.
    """

    def __init__(self, types: tuple[str, ...] | None, keep_seconds: float):
        self.types, self.keep_ms = types, int(keep_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.labels = handle.getMapState("labels", "person string", "label string")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: v[0] for k, v in self.labels.iterator()}
        before, last = set(known), self.last.get()[0] if self.last.exists() else None
        frame = pd.concat(list(rows)).sort_values(["at", "place"], kind="stable")
        out = []
        for at, place, text in zip(frame["at"].astype("int64"), frame["place"], frame["text"]):
            if last is not None and at - last > self.keep_ms:  # the pause lies within what has come together
                known = {}
            out.append(redact_with_labels(text, known, self.types)[0])
            last = at if last is None else max(at, last)
        for gone in before - set(known):
            self.labels.removeKey((gone,))
        for person, label in known.items():
            self.labels.updateValue((person,), (label,))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.last.update((last,))
        self.handle.registerTimer(last + self.keep_ms)
        yield pd.DataFrame({"key": [key[0]] * len(out), "at": frame["at"].astype("int64").to_numpy(), "place": frame["place"].to_numpy(), "redacted": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.labels.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def pseudonymised(stream: DataFrame, key: str, ts_col: str, place_col: str, text_col: str = "text", late: str = "10 minutes", keep_seconds: float = 3600, types: list[str] | None = None) -> DataFrame:
    """Rows (key, at, place, redacted): at is the time in milliseconds, place orders texts of one time.

    The session needs the RocksDB state store (``files.STORE``, ``files.ROCKS``). Rows later than ``late`` are left out.
    """
    rows = stream.withWatermark(ts_col, late).select(F.col(key).alias("key"), F.col(ts_col).alias("ts"), F.unix_millis(F.col(ts_col).cast("timestamp")).alias("at"), F.col(place_col).cast("long").alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(Pseudonyms(None if types is None else tuple(types), keep_seconds), f"key {kind}, at long, place long, redacted string", "Append", "EventTime")


def first_seen(stream: DataFrame, ts_col: str, columns: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows without those that repeat one of at most ``late`` before, by their columns; state is dropped with the watermark."""
    return stream.withWatermark(ts_col, late).dropDuplicatesWithinWatermark(columns)
