"""Redaction and counts over streams.

Redaction keeps no state, so a stream is redacted by the same plan as a table. Counts of findings are kept per window
of event time and closed by a watermark, which rows with findings move on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.redact import redact


def redact_stream(stream: DataFrame, text_col: str = "text", **options) -> DataFrame:
    return redact(stream, text_col, **options)


def windowed_findings(stream: DataFrame, ts_col: str = "ts", text_col: str = "text", window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", **options) -> DataFrame:
    """Findings by window and type. Rows later than ``late`` are left out."""
    found = redact(stream.withWatermark(ts_col, late), text_col, **options)
    at = F.window(ts_col, window, slide) if slide else F.window(ts_col, window)
    return found.select(at.alias("window"), F.explode("found").alias("f")).groupBy("window", F.col("f.type").alias("type")).agg(F.sum("f.count").alias("total"))


def sessions(stream: DataFrame, key: str | list[str], ts_col: str = "ts", gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of a key, which may be of several columns, by session."""
    return stream.withWatermark(ts_col, late).groupBy(F.session_window(ts_col, gap).alias("session"), *([key] if isinstance(key, str) else key)).agg(F.count("*").alias("events"))
