"""Reports over a table of events: windows in time, trends, breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def between(events: DataFrame, since: str, until: str, ts: str = "ts") -> DataFrame:
    return events.where((F.col(ts) >= F.lit(since).cast("timestamp")) & (F.col(ts) < F.lit(until).cast("timestamp")))


def only(events: DataFrame, dimension: str, *values: str) -> DataFrame:
    """Events of some values of a dimension, as of one host."""
    return events.where(F.col(dimension).isin(*values))


def summary(events: DataFrame, value: str = "value") -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.sum(value).alias("total"))


def trend(events: DataFrame, unit: str = "day", most: int = 200, ts: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums by day or hour, oldest first."""
    return events.groupBy(F.date_trunc(unit, ts).alias("period")).agg(F.count("*").alias("events"), F.sum(value).alias("total")).orderBy("period").limit(most)


def breakdown(events: DataFrame, dimension: str, most: int = 100, value: str = "value") -> DataFrame:
    """The largest groups of a dimension; nothing if the table lacks it."""
    if dimension not in events.columns:
        return events.sparkSession.createDataFrame([], "dimension string, events long, total double")
    grouped = events.groupBy(F.col(dimension).cast("string").alias("dimension")).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return grouped.orderBy(F.desc("events"), "dimension").limit(most)
