"""MinHash near-dedup by an LSH forest.

Each document's set of five-word shingles gets TREES signatures of DEPTH MinHash values. Documents of equal sets are one
class from here on, so copies cost one aggregation. Each tree sorts the classes by their signature; candidates are
neighbours in that order whose signatures share a prefix of MIN_DEPTH values at least. Where many classes share a short
prefix, neighbours are those that agree furthest. The order is dealt out by ranges that may cut anywhere, also within a
group of equal signatures; the rows at the cuts are compared once more.

Candidates are confirmed on the full sets, first those of two trees; of the others, only those whose ends these do not
already connect. The depth that a region of a tree needs is measured: a prefix of MIN_DEPTH that no more than REACH + 1 classes
share is done, as its neighbours are all its pairs; one that more share and that these links leave in several groups (a
template's documents, the many variants of one original) is compared whole, in blocks, each with each, by counting common
shingles. So every link whose ends share MIN_DEPTH values in one of the trees is found: all but 3e-7 of the links at a
similarity of 0.85 and 1e-5 at 0.8, fewer above. The components of the confirmed links are the groups. Shingles are compared by 64-bit
hashes.

Null and empty texts have no shingles and are linked with nothing; a text shorter than five words is one shingle. Null
ids are linked with nothing and kept. Rows that share an id are one document: what either is linked with, both are.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import joined_small, lean, saved, slices
from placeweave.llm.components import components
from placeweave.llm.shingles import mixed_bits, overlap, shingle_sets

WIDTH, TREES, DEPTH, MIN_DEPTH, REACH, FIRST_TREES = 5, 16, 6, 3, 4, 2
KEYS = mixed_bits(np.arange(1, 2 * TREES * DEPTH + 1, dtype=np.uint64))
#: A block of classes with one prefix holds about so many shingles, where a class counts as LEAST at least; shingles of more than COMMON classes are counted by a matrix product.
BLOCK, LEAST, COMMON = 1 << 18, 256, 32
MULTIPLY, ADD = KEYS[::2] | np.uint64(1), KEYS[1::2]


def signature(shingles: np.ndarray) -> bytes:
    """The smallest high halves of multiply-add hashes, big-endian, so that bytes sort like numbers."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * MULTIPLY + ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2 << 20):
        sets = shingle_sets(batch.column(1))
        keys = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
        own: dict[bytes, bytes] = {}
        for key, s in zip(keys, sets, strict=True):
            if key and key not in own:
                own[key] = signature(s)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([own.get(k) for k in keys], pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])


class _Rows:
    """Rows (tree, sig, id, n) in order, as arrays."""

    def __init__(self, tree: np.ndarray, sig: np.ndarray, own: np.ndarray, n: np.ndarray):
        self.columns = (tree, sig, own, n)

    @classmethod
    def of(cls, tree: pa.Array, sig: pa.Array, own: pa.Array, n: pa.Array) -> _Rows:
        data = np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(len(sig), 4 * DEPTH)
        return cls(tree.to_numpy(zero_copy_only=False), data, own.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False))

    def __len__(self) -> int:
        return len(self.columns[0])

    def __getitem__(self, at: slice) -> _Rows:
        return _Rows(*(x[at] for x in self.columns))

    def __add__(self, other: _Rows) -> _Rows:
        return _Rows(*map(np.concatenate, zip(self.columns, other.columns, strict=True)))

    def pairs(self, fresh: int, percent: int) -> list[np.ndarray]:
        """(l, r, tree) of the rows from ``fresh`` on, each with the REACH before it."""
        tree, sig, own, n = self.columns
        prefix = np.ascontiguousarray(sig[:, : 4 * MIN_DEPTH]).view(f"S{4 * MIN_DEPTH}").ravel() if len(self) else sig[:, 0]
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(3)]
        for step in range(1, REACH + 1):
            later = np.arange(max(fresh, step), len(self))
            before = later - step
            fits = (tree[later] == tree[before]) & (prefix[later] == prefix[before]) & (own[later] != own[before])
            fits &= 100 * np.minimum(n[later], n[before]) >= percent * np.maximum(n[later], n[before])
            a, b = own[later[fits]], own[before[fits]]
            for to, x in zip(out, (np.minimum(a, b), np.maximum(a, b), tree[later[fits]]), strict=True):
                to.append(x)
        return [np.concatenate(x) for x in out]


def _neighbours(percent: int):
    """Streams a range of the order; its first and last REACH rows come again as edges, each once, to be met with those of other ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, head, seen = TaskContext.get().partitionId(), None, None, 0
        names = ["l", "r", "tree", "sig", "task", "at"]

        def edges(rows: _Rows, first: int) -> pa.RecordBatch:
            tree, sig, own, n = rows.columns
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n, pa.int64()), pa.array(tree, pa.int32()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([task] * len(rows), pa.int32()), pa.array(np.arange(first, first + len(rows)), pa.int64())], names=names)

        for batch in batches:
            rows = _Rows.of(*(batch.column(i) for i in range(4)))
            both = rows if last is None else last + rows
            l, r, tree = both.pairs(len(both) - len(rows), percent)
            if head is None or len(head) < REACH:
                head = rows[:REACH] if head is None else (head + rows)[:REACH]
            last = both[-REACH:]
            seen += len(rows)
            none = (pa.nulls(len(l), kind) for kind in (pa.binary(), pa.int32(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(l, pa.int64()), pa.array(r, pa.int64()), pa.array(tree, pa.int32()), *none], names=names)
        if head is not None:
            yield edges(head, 0)
            tail = max(len(head), seen - len(last))  # a short range's last rows are among its first
            yield edges(last[len(last) - (seen - tail) :] if tail < seen else last[:0], tail)

    return run


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(l, r, tree): neighbours in the trees' orders, for ``classes`` (cid, n, sig); tree is the first that has the pair."""
    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring("sig", t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)).alias("sig"))))
    rows = classes.select("cid", "n", trees.alias("t")).select("t.tree", "t.sig", "cid", "n", F.xxhash64("cid", "t.tree").alias("h"))
    order = ["tree", "sig", "h"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "sig", "cid", "n")
    found = saved(ranges.mapInArrow(_neighbours(percent), "l long, r long, tree int, sig binary, task int, at long"), "order")

    def stitch(edges: pd.DataFrame) -> pd.DataFrame:
        edges = pa.Table.from_pandas(edges.sort_values(["task", "at"]), preserve_index=False).combine_chunks()
        met = _Rows.of(*(edges[c].chunk(0) for c in ("tree", "sig", "l", "r"))).pairs(0, percent)
        return pd.DataFrame(dict(zip(("l", "r", "tree"), met, strict=True))).astype({"l": "int64", "r": "int64", "tree": "int32"})

    edges = found.where("task is not null").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(stitch, "l long, r long, tree int")  # at most 2 REACH rows a range
    return found.where("task is null").select("l", "r", "tree").union(edges).groupBy("l", "r").agg(F.min("tree").alias("tree"))


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The (l, r) whose documents' full sets have 100 * intersection >= percent * union."""
    pairs = saved(pairs.select("l", "r"), "pairs")
    ids = pairs.select(F.col("l").alias("id")).union(pairs.select(F.col("r").alias("id"))).distinct()
    texts = saved(joined_small(docs.select(F.col("doc_id").alias("id"), "text"), saved(ids, "ids"), "id", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("id").alias("l"), F.col("text").alias("a")), "l").join(texts.select(F.col("id").alias("r"), F.col("text").alias("b")), "r")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_sets(batch.column(i)) for i in (2, 3)]
            same = [overlap(a, b) for a, b in zip(*sets, strict=True)]
            keep = pa.array([100 * s >= percent * (len(a) + len(b) - s) and s > 0 for s, a, b in zip(same, *sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["l", "r"]).filter(keep)

    return both.select("l", "r", "a", "b").mapInArrow(check, "l long, r long").distinct()


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles each set of ``left`` (numbers of sets) shares with each of ``right``; these are the same numbers or have none in common."""
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    row, column = np.full(len(sets), -1), np.full(len(sets), -1)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    counts = np.zeros((len(left), len(right)), np.float32)
    rare = (df[inverse] > 1) & (df[inverse] <= COMMON)
    order = np.argsort(inverse[rare], kind="stable")
    key, own = inverse[rare][order], owner[rare][order]
    for step in range(1, COMMON):
        same = key[step:] == key[:-step]
        if not same.any():
            break
        a, b = own[:-step][same], own[step:][same]
        for x, y in ((a, b), (b, a)):
            inside = (row[x] >= 0) & (column[y] >= 0)
            np.add.at(counts, (row[x[inside]], column[y[inside]]), 1)
    common = np.flatnonzero(df > COMMON)
    place = np.full(len(values), -1)
    place[common] = np.arange(len(common))
    held = place[inverse] >= 0
    at, own = place[inverse][held], owner[held]
    for first in range(0, len(common), 1024):
        now = (at >= first) & (at < first + 1024)
        has = np.zeros((len(sets), min(1024, len(common) - first)), np.float32)
        has[own[now], at[now] - first] = 1
        counts += has[left] @ has[right].T
    return counts


def _blocks_met(percent: int):
    """Links between two blocks of a prefix's classes (or within one, where all have side 0), as far as they join groups."""

    def run(table: pa.Table) -> pa.Table:
        cid, root, side = (table[c].to_numpy() for c in ("cid", "root", "side"))
        found: list[tuple[int, int]] = []
        left, right = (np.flatnonzero(side == x) for x in (0, int(side.max())))
        if len(left) and (root != root[0]).any():
            sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
            size = np.array([len(x) for x in sets])
            counts = common_counts(sets, left, right)
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            for i, row in zip(left, counts.astype(np.int64), strict=True):
                for j in right[(row > 0) & (100 * row >= percent * (size[i] + size[right] - row)) & (root[right] != root[i])]:
                    a, b = top(int(root[i])), top(int(root[j]))
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        found.append((int(cid[i]), int(cid[j])))
        return pa.table({"l": pa.array([x for x, _ in found], pa.int64()), "r": pa.array([x for _, x in found], pa.int64())})

    return run


def crowded(classes: DataFrame, root: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(l, r): links that the orders' neighbours leave out, for ``classes`` (cid, n, sig) in the groups ``root`` (v, root) so far."""
    buckets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(t, F.substring("sig", t * (4 * DEPTH) + 1, F.lit(4 * MIN_DEPTH))))).alias("bucket")
    named = joined_small(classes, root.select(F.col("v").alias("cid"), "root"), "cid")
    members = saved(named.select("cid", "n", F.coalesce("root", "cid").alias("root"), buckets), "members")
    full = members.groupBy("bucket").agg(F.count("*").alias("rows"), F.sum(F.greatest("n", F.lit(LEAST))).alias("weight"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    full = full.where((F.col("rows") > REACH + 1) & (F.col("lo") != F.col("hi"))).select("bucket", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks"))
    members = saved(joined_small(members, saved(full, "full"), "bucket", "inner").select("bucket", "cid", "root", "blocks", F.pmod(F.xxhash64("cid", "bucket"), "blocks").cast("int").alias("block")), "crowded")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2 << 20):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.md5(s).digest() for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["cid", "set_key", "shingles"])

    texts = joined_small(docs.select(F.col("doc_id").alias("cid"), "text"), saved(members.select("cid").distinct(), "ids"), "cid", "left_semi")
    sets = saved(texts.mapInArrow(shingles, "cid long, set_key binary, shingles binary").where(F.length("shingles") > 0).dropDuplicates(["cid", "set_key"]).select("cid", "shingles"), "sets")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = members.select("bucket", "cid", "root", "block", other).select("bucket", "cid", "root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    return paired.join(sets, "cid").groupBy("bucket", "lo", "hi").applyInArrow(_blocks_met(percent), "l long, r long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, sig binary"), "sketches")
    linked = rows.where("set_key is not null and doc_id is not null")
    classes = saved(linked.groupBy("set_key").agg(F.min("doc_id").alias("cid"), F.max("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes")
    pairs = saved(candidates(classes.select("cid", "n", "sig"), percent), "candidates")
    first = saved(confirmed(pairs.where(F.col("tree") < FIRST_TREES), docs, percent), "first")
    root = components(first)
    other = pairs.where(F.col("tree") >= FIRST_TREES)
    for end in ("l", "r"):
        other = joined_small(other, root.select(F.col("v").alias(end), F.col("root").alias(f"{end}_root")), end)
    other = other.where(F.coalesce("l_root", "l") != F.coalesce("r_root", "r"))
    more = confirmed(other, docs, percent)
    # Rows that share an id join the classes of their texts.
    twice = linked.groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("a"), F.max(F.xxhash64("set_key")).alias("b")).where("a <> b").select("doc_id")
    shared = joined_small(linked, saved(twice, "twice"), "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes.select("set_key", "cid"), "set_key")
    shared = shared.join(shared.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").where("a <> cid").select("cid", "a")
    root = components(root.select("v", "root").union(more))
    hubs = crowded(classes.select("cid", "n", "sig"), root, docs, percent)
    root = components(root.select("v", "root").union(hubs).union(shared))
    named = rows.select("doc_id", "n_shingles", "set_key").join(classes.select("set_key", "cid"), "set_key", "left")
    named = joined_small(named, root.withColumnRenamed("v", "cid"), "cid")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "cid", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest id, with its columns."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone__")).distinct()
    return joined_small(docs, saved(gone, "gone"), docs["doc_id"].cast("long") == F.col("gone__"), "left_anti")


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, array_to_string(ws[i + 1 : i + 5], ' ') as k from w, lateral (select unnest(range(0, greatest(len(ws) - 4, 1))) as i) where len(ws) > 0
), n as (select doc_id, count(*) as n from s group by 1),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, link.b from reach join link on reach.b = link.a),
root as (select a as doc_id, min(b) as component_id from reach group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from documents left join n using (doc_id) join root using (doc_id)
"""
