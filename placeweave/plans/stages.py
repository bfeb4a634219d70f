"""Stage boundaries: a frame written to the folder that all executors share and read again.

What follows starts from the written table: no stage is computed twice, the optimizer sees a short plan, and a lost
executor loses nothing.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on one machine (tests), a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` if it has fewer partitions than there are cores: for work that is heavy for its bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


#: A side up to so many rows may be broadcast.
SMALL = 500_000


def small(df: DataFrame, bound: int = SMALL, of: DataFrame | None = None) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have ``bound`` rows at most (or ``of``: the rows that its lists are made of); as
    it is otherwise, so that joins with it shuffle."""
    return F.broadcast(df) if (df if of is None else of).limit(bound + 1).count() <= bound else df


@atexit.register
def _remove() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
