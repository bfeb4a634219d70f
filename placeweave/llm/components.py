"""Connected components of a link table by alternating large and small stars, each round first contracted within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import saved

#: Links that one contraction holds in memory.
CHUNK = 1 << 17


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's links: each node but the smallest of its group, linked to that."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def flush() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["v", "root"])
        parent.clear()

    for batch in batches:
        for v, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(v), root(u)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= CHUNK:
            yield from flush()
    yield from flush()


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every node of ``links`` (two long columns) that is not the smallest of its component."""
    a, b = links.columns

    def contracted(df: DataFrame) -> DataFrame:
        return saved(df.mapInArrow(_contract, "v long, root long").distinct(), "links")

    now = contracted(links.select(F.col(a).alias("v"), F.col(b).alias("root")))
    while True:
        nodes, rows = now.agg(F.countDistinct("v"), F.count("*")).first()
        if nodes == rows and now.select(F.col("root").alias("v")).distinct().join(now, "v", "left_semi").limit(1).count() == 0:
            return now
        both = now.select("v", F.col("root").alias("u")).union(now.select(F.col("root").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("root")).where("v <> root").distinct()
        small = large.groupBy("v").agg(F.min("root").alias("m"))
        met = large.join(small, "v")
        now = contracted(met.select(F.col("root").alias("v"), F.col("m").alias("root")).where("v <> root").union(small.select("v", F.col("m").alias("root"))))


def union_find(pairs: np.ndarray) -> dict[int, int]:
    """The same in memory, for tests and small tables: node to smallest node of its component."""
    batch = pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["v", "root"])
    return {v: r for out in _contract(iter([batch])) for v, r in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
