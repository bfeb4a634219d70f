"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the nearest-neighbour graph is cut into balanced parts; a small network (one hidden layer, numpy)
learns which parts a vector's neighbours lie in. It then indexes every vector in its likeliest part and routes each query
to its several likeliest parts, as many as the sample's brute force says are needed for the wanted recall and at least so
many as hold enough vectors. There, all vectors are ranked by the exact inner product.

The number of parts grows with the table: a part of more than SPLIT * PER_PART vectors is cut again, by a graph and a
classifier of its own, learnt from a sample of it in a task, and so on down; the queries that come to it are routed on by
that classifier. So a part stays of bounded size, and what is shuffled for a query does not depend on the table, but for
the parts it has to see. With at least MIN_SAMPLE distinct vectors there are FEW_PARTS parts at least, however small the
table; below that, there is nothing to learn from: the table is one part, and the search is exact.

Parts are split into blocks of bounded size by a hash of the id, as are the queries sent to a part, so no part, however
common, meets in one task. Vectors travel in their stored type and are widened where they are used. Equal vectors are one
candidate that carries its smallest k + 1 ids (ties go to smaller ids, so no other can be in a result): a vector that a
third of all rows share costs as much as any other.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids or vectors of
another length than the most common (of equally common lengths, the longest). Rows repeated with id and vector count once.
A row whose id another vector has too is searched and found as either. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.llm.common import joined_small, saved

SAMPLE, PER_PART, MAX_PARTS = 16384, 1500, 256
#: Of a part that is cut again: how many times PER_PART it has to hold, how many vectors are learnt from, how often at most.
SPLIT, PART_SAMPLE, LEVELS = 4, 4096, 6
FEW_PARTS, MIN_SAMPLE = 8, 128
GRAPH_K, HIDDEN, EPOCHS, RATE = 16, 128, 30, 2e-3
RECALL = 0.96
BLOCK, QUERY_BLOCK = 4096, 4096


def _top(a: np.ndarray, b: np.ndarray, k: int, skip_own: bool) -> np.ndarray:
    """Indices of the k largest inner products with rows of b, for each row of a, in blocks; own: row i of a is row i of b."""
    out = np.empty((len(a), k), np.int64)
    for at in range(0, len(a), 256):
        s = a[at : at + 256] @ b.T
        if skip_own:
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        part = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + 256] = np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1), 1)
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Cuts the graph (n x k neighbours) into parts of at most 1.1 n / parts nodes, with few edges between them.

    Halving by principal directions starts it; then, in sweeps, nodes move to the part that most of their neighbours are
    in, those that gain most first, as far as the parts have room.
    """
    n = len(x)
    label, todo = np.zeros(n, np.int64), [(np.arange(n), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1:
            label[rows] = first
            continue
        own = x[rows] - x[rows].mean(0)
        axis = rng.standard_normal(x.shape[1])
        for _ in range(8):
            axis = own.T @ (own @ axis)
            axis /= np.linalg.norm(axis) or 1
        order, left = rows[np.argsort(own @ axis, kind="stable")], count // 2
        cut = len(rows) * left // count
        todo += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    room = int(np.ceil(1.1 * n / parts))
    ends, starts = np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)
    for _ in range(20):
        near = np.zeros((n, parts), np.int32)
        np.add.at(near, (ends, label[starts]), 1)
        np.add.at(near, (starts, label[ends]), 1)
        best = near.argmax(1)
        gain = near[np.arange(n), best] - near[np.arange(n), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room and rng.random() < 0.7:  # not all at once: neighbours may move as well
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < n // 500:
            break
    return label


class Router:
    """The classifier: vectors to log probabilities of parts."""

    def __init__(self, dim: int, parts: int, rng: np.random.Generator):
        self.w = [rng.standard_normal((dim, HIDDEN)) / np.sqrt(dim), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        self.mean, self.scale, self.probes = np.zeros(dim), 1.0, 1

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w[0] + self.w[1], 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._hidden(x) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the cross entropy with the distributions in ``target``."""
        self.mean, self.scale = x.mean(0), float(x.std()) or 1.0
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                h, t = self._hidden(x[rows]), t + 1
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
                dh = (d @ self.w[2].T) * (h > 0)
                grads = [((x[rows] - self.mean) / self.scale).T @ dh, dh.sum(0), h.T @ d, d.sum(0)]
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)


def learn(x: np.ndarray, parts: int, k: int, recall: float = RECALL, seed: int = 11) -> Router:
    """Graph, balanced parts, classifier and the number of probes, from the sample ``x`` (distinct vectors)."""
    rng = np.random.default_rng(seed)
    router = Router(x.shape[1], parts, rng)
    if parts == 1:
        return router
    graph = _top(x, x, min(GRAPH_K, len(x) - 1), True)
    label = balanced_parts(x, graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].reshape(-1)), 1.0)
    target[np.arange(len(x)), label] += 2.0
    router.fit(x, target / target.sum(1, keepdims=True), rng)
    asked = rng.permutation(len(x))[:500]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    want = np.argpartition(-s, min(k, len(x) - 2), axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-router.logits(x[asked]), axis=1, kind="stable"), axis=1)
    home = router.logits(x).argmax(1)
    at = np.sort(np.take_along_axis(place, home[want], 1).reshape(-1))  # the probe that finds each true neighbour
    router.probes = int(at[min(int(np.ceil(recall * len(at))), len(at) - 1)]) + 1
    return router


def _usable(vector: Column) -> Column:
    each = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(each & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


#: A part's children are numbered from its own number times this, plus 1; the parts of the first level are those of 0.
CHILDREN = 512


def _probes(router: Router, v: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which parts each vector is sent to (as a table), and the same as pairs: its likeliest, and more until they hold k + 1 vectors."""
    order = np.argsort(-router.logits(v), axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1) - sizes[order]  # in the parts before
    at, nth = np.nonzero((np.arange(order.shape[1]) < router.probes) | (held < k + 1))
    to = order[at, nth]
    probed = np.zeros(order.shape, bool)
    probed[at, to] = True
    return probed, at, to


def _learn_part(dim: int, k: int, recall: float) -> Callable[[pa.Table], pa.Table]:
    """From a part's sample (cell, n, v) its classifier."""

    def run(table: pa.Table) -> pa.Table:
        x, n = _matrix(table["v"].combine_chunks(), dim)[: 2 * PART_SAMPLE], table["n"][0].as_py()
        parts = max(2, min(MAX_PARTS, n // PER_PART, len(x) // 64))
        return pa.table({"cell": table["cell"][:1], "n": table["n"][:1], "router": pa.array([pickle.dumps(learn(x, parts, k, recall))], pa.binary())})

    return run


def _descended(rows: DataFrame, routers: DataFrame, ddl: str, dim: int, pick: Callable) -> DataFrame:
    """``rows`` (with first, v, cell) in the children of their cells that ``pick`` names, where ``routers`` has the cell; as they are elsewhere.

    A cell's rows are dealt to blocks, each of which meets a copy of the cell's classifier."""
    counted = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = saved(joined_small(counted, routers.select("cell"), "cell", "inner"), "blocks")
    dealt = joined_small(rows, blocks, "cell", "inner").withColumn("salt", F.pmod(F.xxhash64("first"), "blocks").cast("int")).drop("blocks")
    copies = joined_small(routers, blocks, "cell", "inner").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    names = rows.columns

    def run(have: pa.Table, model: pa.Table) -> pa.Table:
        have = have.select(names)
        if not have.num_rows or not model.num_rows:
            return have.slice(0, 0)
        router, held = pickle.loads(model["router"][0].as_py()), np.zeros(CHILDREN, np.int64)
        for h in model["held"][0].as_py() if "held" in model.column_names else ():
            held[h["child"]] = h["n"]
        at, child = pick(router, _matrix(have["v"].combine_chunks(), dim), held[: len(router.w[3])])
        out = have.take(pa.array(at))
        cell = have["cell"][0].as_py() * CHILDREN + 1 + child.astype(np.int64)
        return out.set_column(names.index("cell"), "cell", pa.array(cell))

    moved = dealt.groupBy("cell", "salt").cogroup(copies.groupBy("cell", "salt")).applyInArrow(run, ddl)
    return moved.unionByName(joined_small(rows, blocks.select("cell"), "cell", "left_anti"))


def search(df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row among all other rows."""
    rows = df.where(F.col(vec_id).isNotNull() & _usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return empty
    dim, kind = lengths["dim"], rows.schema["v"].dataType.simpleString()
    rows = rows.where(F.size("v") == dim)
    # Group limits run before the shuffle: of a common vector, each task sends its k + 1 smallest ids.
    few = rows.withColumn("nth", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    vectors = saved(few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("first"), "ids", "v"), "vectors")
    asked = rows.where("q").select("id", "v").distinct().join(vectors.select("v", "first"), "v").select(F.col("id").alias("query_id"), "first")
    asked = saved(asked, "asked")
    total = vectors.count()
    picked = vectors.orderBy(F.xxhash64("first", "v"), "first").limit(sample).select("v").toArrow()["v"].combine_chunks()
    x = _matrix(picked, dim)
    parts = max(FEW_PARTS, min(MAX_PARTS, total // PER_PART, len(x) // 64)) if len(x) >= MIN_SAMPLE else 1
    deeper = total > parts * SPLIT * PER_PART  # some part will be cut again, which loses neighbours as well
    recall = recall**0.5 if deeper else recall
    router = learn(x, parts, k, recall)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = router.logits(_matrix(batch.column(2), dim)).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int64) + 1)], names=["first", "ids", "v", "cell"])

    index_ddl, routed_ddl = f"first long, ids array<long>, v {kind}, cell long", f"first long, v {kind}, cell long, least double"
    index = saved(vectors.mapInArrow(place, index_ddl), "index")
    sizes = np.zeros(parts, np.int64)
    for r in index.groupBy("cell").count().collect():  # MAX_PARTS rows at most
        sizes[r["cell"] - 1] = r["count"]
    deeper = bool((sizes > SPLIT * PER_PART).any())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            probe, at, to = _probes(router, _matrix(batch.column(1), dim), sizes, k)
            least = np.full(len(probe), -np.inf) if deeper else floor(_matrix(batch.column(1), dim), probe)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(to + 1), pa.array(least[at])], names=["first", "v", "cell", "least"])

    near, near_home = np.ascontiguousarray(x.T), router.logits(x).argmax(1)

    def floor(q: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """A score that the k + 1 best in a query's parts reach, as those of the sample there do: what is below need not be sent on."""
        out = np.full(len(q), -np.inf)
        cut = near.shape[1] - k - 1
        for at in range(0, len(q) if cut >= 0 else 0, 256):
            s = np.where(probed[at : at + 256][:, near_home], q[at : at + 256] @ near, -np.inf)
            out[at : at + 256] = np.partition(s, cut, axis=1)[:, cut]
        return np.where(np.isfinite(out), out - 1e-9 * (1 + np.abs(out)), out)

    queries = vectors.join(asked.select("first").distinct(), "first", "left_semi").select("first", "v")
    routed = saved(queries.mapInArrow(route, routed_ddl), "routed")
    for level in range(LEVELS if deeper else 0):
        large = saved(index.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT * PER_PART), "large")
        if not large.limit(1).count():
            break
        share = F.pmod(F.xxhash64("first", F.lit(level)), F.lit(1 << 30)) * F.col("n") < F.lit(PART_SAMPLE << 30)
        learnt = joined_small(index, large, "cell", "inner").where(share).select("cell", "n", "v").groupBy("cell").applyInArrow(_learn_part(dim, k, recall), "cell long, n long, router binary")
        routers = saved(learnt, "routers")
        index = saved(_descended(index, routers, index_ddl, dim, lambda own, v, _: (np.arange(len(v)), own.logits(v).argmax(1))), "index")
        child = index.where(F.col("cell") >= CHILDREN**(level + 1)).select(F.floor((F.col("cell") - 1) / CHILDREN).alias("parent"), F.pmod(F.col("cell") - 1, F.lit(CHILDREN)).alias("child"))
        held = child.groupBy("parent", "child").agg(F.count("*").alias("n")).groupBy(F.col("parent").alias("cell")).agg(F.collect_list(F.struct("child", "n")).alias("held"))  # CHILDREN at most
        routers = saved(joined_small(routers, saved(held, "held"), "cell", "inner"), "routers")
        routed = saved(_descended(routed, routers, routed_ddl, dim, lambda own, v, held: _probes(own, v, held, k)[1:]), "routed")
    info = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(routed.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks")), "cell")
    info = saved(info, "info")
    cells = joined_small(index, info, "cell", "inner").withColumns({"b": F.pmod(F.xxhash64("first"), "blocks").cast("int"), "qb": F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))}).drop("blocks", "query_blocks")
    calls = joined_small(routed, info, "cell", "inner").withColumns({"qb": F.pmod(F.xxhash64("first"), "query_blocks").cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))}).drop("blocks", "query_blocks")

    def rank(have: pa.Table, want: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        kept: list[pa.Array] = []
        if have.num_rows and want.num_rows:
            c, q = _matrix(have["v"].combine_chunks(), dim), _matrix(want["v"].combine_chunks(), dim)
            firsts, asks = have["first"].to_numpy(), want["first"].to_numpy()
            lowest = want["least"].to_numpy()
            lists, few = have["ids"].combine_chunks(), min(k + 1, len(c))
            for at in range(0, len(q), 512):
                s = q[at : at + 512] @ c.T
                cut = np.partition(s, len(c) - few, axis=1)[:, len(c) - few]
                r, col = np.nonzero(s >= np.maximum(cut - 1e-9 * (1 + np.abs(cut)), lowest[at : at + 512])[:, None])
                exact = (q[at + r] * c[col]).sum(axis=1)
                order = np.lexsort((firsts[col], -exact, r))
                r, col, exact = r[order], col[order], exact[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                r, col, exact = r[nth < few], col[nth < few], exact[nth < few]
                for to, x in zip(out, (asks[at + r], firsts[col], exact), strict=True):
                    to.append(x)
                kept.append(lists.take(pa.array(col)))
        flat = [np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        ids = pa.chunked_array(kept, pa.list_(pa.int64()))
        return pa.table([pa.array(flat[0]), pa.array(flat[1]), pa.array(flat[2]), ids], names=["asked", "first", "score", "ids"])

    found = cells.groupBy("cell", "b", "qb").cogroup(calls.groupBy("cell", "b", "qb")).applyInArrow(rank, "asked long, first long, score double, ids array<long>")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "first"))).where(F.col("nth") <= k + 1)
    best = best.groupBy("asked").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))  # k + 1 at most
    pairs = F.flatten(F.transform("hits", lambda h: F.transform(h["ids"], lambda i: F.struct((-h["score"]).alias("far"), i.alias("vec_id")))))
    answered = asked.join(best, F.expr("first = asked"))
    own = F.filter(F.array_sort(pairs), lambda p: p["vec_id"] != F.col("query_id"))
    hits = answered.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "hit"))
    return hits.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
