"""Helpers shared by the corpus operators: shared-folder tables, Arrow slices, words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
#: Bytes of an Arrow batch on its way to a Python worker, for ``lean``.
BATCH, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH = ("67108864b", "67108864", "64m", None)


def lean(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, where it leaves Spark's default: rows of texts differ a thousandfold in length, and a batch
    stands in the executor's native memory (with room for as much again while it grows) and in its worker."""
    if spark.conf.get(BATCH_KEY, None) in DEFAULT_BATCH:
        spark.conf.set(BATCH_KEY, str(BATCH))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where that is unset on one machine (tests), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def tables() -> frozenset[str]:
    """The tables there are now, for ``settled``."""
    return frozenset(path for _, path in _made)


def settled(df: DataFrame, tag: str, before: frozenset[str]) -> DataFrame:
    """``saved``, after which the other tables that were saved since ``before`` are deleted: for the end of a step whose tables
    no later step reads."""
    old = [at for at in _made if at[1] not in before]
    out = saved(df, tag)
    _delete(old)
    return out


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove((spark, path))


@atexit.register
def _clean() -> None:
    _delete(list(_made))


def aside(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` with columns of these names renamed, in place, to others: so that they outlast a step that makes such columns."""
    names = set(names)
    return df.toDF(*(f"aside_{i}__" if c in names else c for i, c in enumerate(df.columns)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of about ``limit`` bytes, so that a worker's memory does not follow the batch size.

    Workers are used again for other tasks: what earlier ones freed goes back to the system first, and again at the end."""
    _trim()
    for batch in batches:
        step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    _trim()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc keep or return it by themselves
        ctypes.CDLL(None).malloc_trim(0)


def joined_small(df: DataFrame, small: DataFrame, on, how: str = "left", bound: int = 500_000) -> DataFrame:
    """``df`` joined with ``small``, which is broadcast only if it was counted to have ``bound`` rows at most; beyond that, both sides shuffle."""
    return df.join(F.broadcast(small) if small.limit(bound + 1).count() <= bound else small, on, how)
