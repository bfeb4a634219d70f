"""Sharding by Karmarkar-Karp differencing: near equal bytes for groups that must stay together.

A group is all rows of equal text (null counts as empty), so copies land in one shard. The groups' bytes are first summed
up (copies meet in the partial aggregation). Every task then differences its own groups: of the partial partitions into
k subsets, the two with the largest spread are combined again and again, one's largest subset with the other's smallest,
until one is left. What remains of a task, k sums, is itself a partial partition; those of all tasks are differenced the
same way, in a tree of bounded fan-in, down to the k shards.

Slots number each shard's rows from 0 without gaps. Null ids and repeated rows are rows like others. An empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.llm.common import joined_small, saved

#: Groups that one differencing holds in memory, and partial partitions that one merge takes.
CHUNK = 1 << 16
FAN_IN = 4096
ROW_BYTES = 8


def differencing(parts: np.ndarray) -> np.ndarray:
    """Karmarkar-Karp over n partial partitions (n x k sums): the subset, 0 to k - 1, that each row's each entry joins."""
    n, k = parts.shape
    labels = np.zeros((2 * n - 1, k), np.int16)
    order = np.argsort(-parts, axis=1, kind="stable").astype(np.int16)
    sums = np.take_along_axis(parts, order, 1)
    live = {i: sums[i] for i in range(n)}
    heap = [(int(sums[i, -1] - sums[i, 0]), i) for i in range(n)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = live.pop(a) + live.pop(b)[::-1]
        by = np.argsort(-both, kind="stable")
        both = both[by]
        node = n + len(merges)
        merges.append((a, b, by.astype(np.int16)))
        live[node] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), node))
    labels[n + len(merges) - 1] = np.arange(k)
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, by = merges[node - n]
        place = np.empty(k, np.int16)
        place[by] = labels[node]
        labels[a], labels[b] = place, place[::-1]
    out = np.empty((n, k), np.int16)
    np.put_along_axis(out, order.astype(np.int64), labels[:n], 1)
    return out


def _local(k: int):
    """Differences a task's groups, chunk by chunk: (key, size) to (key, size, node, subset)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, rest = TaskContext.get().partitionId() << 32, []

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal node
            parts = np.zeros((table.num_rows, k), np.int64)
            parts[:, 0] = table["size"].to_numpy()
            subset = pa.array(differencing(parts)[:, 0].astype(np.int32))
            node += 1
            yield from table.append_column("node", pa.array(np.full(table.num_rows, node))).append_column("subset", subset).to_batches()

        for batch in batches:
            rest.append(batch)
            while sum(b.num_rows for b in rest) >= CHUNK:
                table = pa.Table.from_batches(rest)
                yield from emit(table.slice(0, CHUNK))
                rest = table.slice(CHUNK).to_batches()
        if sum(b.num_rows for b in rest):
            yield from emit(pa.Table.from_batches(rest))

    return run


def _merge(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
        parts = np.zeros((len(nodes), k), np.int64)
        parts[at, rows["subset"].to_numpy()] = rows["size"].to_numpy()
        to = differencing(parts)
        return pd.DataFrame({"node": np.repeat(nodes, k), "subset": np.tile(np.arange(k, dtype=np.int32), len(nodes)), "parent": rows["parent"].iloc[0], "shard": to.reshape(-1).astype(np.int32)})

    return run


def shard_groups(groups: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """(key, size) rows, one per group, to (key, shard)."""
    local = saved(groups.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).mapInArrow(_local(shards), "key binary, size long, node long, subset int"), "groups")
    level = local.groupBy("node", "subset").agg(F.sum("size").alias("size"))
    nodes = local.agg(F.countDistinct("node")).first()[0]
    where = None
    while True:
        parents = max(1, -(-nodes // FAN_IN))
        level = level.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(parents)))
        step = saved(level.groupBy("parent").applyInPandas(_merge(shards), "node long, subset int, parent long, shard int"), "merge")
        if where is None:
            where = step
        else:
            up = step.select(F.col("node").alias("parent"), F.col("subset").alias("shard"), F.col("parent").alias("up"), F.col("shard").alias("to"))
            where = where.join(up, ["parent", "shard"]).select("node", "subset", F.col("up").alias("parent"), F.col("to").alias("shard"))
        if parents == 1:
            break
        level = level.join(step.drop("parent"), ["node", "subset"]).groupBy(F.col("parent").alias("node"), F.col("shard").alias("subset")).agg(F.sum("size").alias("size"))
        nodes = parents
    return joined_small(local.select("key", "node", "subset"), where, ["node", "subset"], "inner").select("key", "shard")


def numbered(df: DataFrame, by: str, slot: str = "slot") -> DataFrame:
    """Adds gapless numbers from 0 within each value of the int column ``by``, without sorting: tasks count their own rows, then add up."""
    names = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["task long, nth long"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, so_far = TaskContext.get().partitionId(), {}
        for batch in batches:
            values = batch.column(names.index(by)).to_numpy(zero_copy_only=False)
            nth = np.empty(len(values), np.int64)
            for v in np.unique(values):
                at = np.flatnonzero(values == v)
                first = so_far.get(v, 0)
                nth[at] = first + np.arange(len(at))
                so_far[v] = first + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(values), task)), pa.array(nth)], names=[*names, "task", "nth"])

    rows = saved(df.mapInArrow(count, schema), "numbered")
    counts = rows.groupBy(by, "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(by).orderBy("task")) - F.col("n")).drop("n")
    return joined_small(rows, before, [by, "task"], "inner").withColumn(slot, F.col("before") + F.col("nth")).select(*names, slot)


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))
    rows = saved(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    placed = rows.join(shard_groups(groups, "key", "size", shards), "key").drop("key")
    return numbered(placed, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
