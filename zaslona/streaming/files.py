"""Streams to files: append-only Parquet with a checkpoint, from which a stopped stream goes on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; an own folder where it is unset and all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="zaslona-streams-")).rstrip("/")


def to_files(out: DataFrame, path: str) -> None:
    """Runs a stream over what has arrived, from where its checkpoint (``path``/checkpoint) stands, into ``path``/out."""
    writer = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def replayed(arrivals: list[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream has written after tables arrived one after another; between them it is stopped and started again."""
    spark, schema = arrivals[0].sparkSession, arrivals[0].schema
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for i, rows in enumerate(arrivals):
        rows.write.parquet(f"{path}/in/{i}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        to_files(build(source), path)
    return spark.read.schema(build(arrivals[0]).schema).parquet(f"{path}/out")
