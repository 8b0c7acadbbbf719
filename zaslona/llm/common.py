"""Shared plumbing of the corpus operators: shared storage, batch sizes, graph components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a step takes at once. Documents average a few kB but may be megabytes, so both stay small.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where it is unset and all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        named = _fallback.setdefault("dir", tempfile.mkdtemp(prefix="zaslona-"))
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


class Stash:
    """Tables written once to the shared folder, so that lost executors cost a reread and not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/zaslona-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(_remove, spark, self.root)

    def path(self) -> str:
        """A folder of its own for a table that the caller writes."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def __call__(self, df: DataFrame, partition_by: str | None = None, batch_rows: int = BATCH_ROWS, group_bytes: int | None = None) -> DataFrame:
        """The table as written. Python steps on the way get small batches, for the time of the write only.

        ``group_bytes`` bounds what a file's reader holds at once, for tables of long rows.
        """
        path = self.path()
        conf, key = self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = conf.get(key)
        conf.set(key, str(batch_rows))
        try:
            writer = df.write.option("compression", "zstd")
            if group_bytes:
                writer = writer.option("parquet.block.size", str(group_bytes))
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        finally:
            conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._zaslona_path = path
        return out

    def free(self) -> None:
        """Let Spark delete the shuffle files of jobs that are over."""
        for _ in range(2):  # the first finds what is unused, the second what only that held
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, df: DataFrame) -> None:
        """Forget a table that no later plan reads."""
        if path := getattr(df, "_zaslona_path", None):
            _remove(self.spark, path)


def sliced(run: Callable, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Callable:
    """A map over Arrow batches that gets them in slices of at most so many rows, and of about so many bytes where rows are long.

    Spark's own batches follow the session's settings, which stay as the caller has them.
    """

    def slices(batches):
        for b in batches:
            step = max(1, min(rows, size * b.num_rows // max(b.nbytes, 1)))
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)

    return lambda batches: run(slices(batches))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, stash: Stash, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u, v): rows (u, root), root being the smallest node; isolated nodes have no row.

    Alternates large-star and small-star steps. A node's smallest neighbour comes from a partially aggregated
    group and is joined back, so a hub never gathers in one task; each round is a written table.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stash(e)
    mark = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        big = stash(big)
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        nxt = stash(small.select("p.u", "p.v").where("u <> v").distinct())
        stash.drop(big)
        now = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        stash.drop(e)
        e = nxt
        if tuple(now) == mark or not now[0]:
            return e.select("u", F.col("v").alias("root"))
        mark = tuple(now)
    raise RuntimeError("components did not settle")
