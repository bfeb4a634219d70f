import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from placeweave.llm import language_model as L
from placeweave.llm import queries
from placeweave.llm.packed import pack, pack_sorted, unpack, unpack_sorted

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        self.single, self.pair = Counter(), Counter()
        for t in texts:
            w = [*words(lower(t)), None]
            self.single.update(w)
            self.pair.update(zip(["<s>", *w[:-1]], w, strict=True))
        self.context, self.led = Counter(), Counter()
        self.classes = defaultdict(lambda: [0, 0, 0])
        for (v, w), c in self.pair.items():
            self.context[v] += c
            self.led[w] += 1
            self.classes[v][min(c, 3) - 1] += 1
        self.n, self.v = sum(self.single.values()), len(self.single)
        self.d2 = L.discounts([sum(c == k for c in self.pair.values()) for k in (1, 2, 3, 4)])
        self.d1 = L.discounts([sum(c == k for c in self.led.values()) for k in (1, 2, 3, 4)])
        self.free = sum(self.d1[min(c, 3)] for c in self.led.values())

    def alone(self, w):
        types = len(self.pair)
        return (self.led[w] - self.d1[min(self.led[w], 3)] + self.free / (self.v + 1)) / types if types else 1 / (self.v + 1)

    def p(self, v, w):
        if not self.context[v]:
            return self.alone(w)
        c = self.pair[v, w]
        spare = sum(n * d for n, d in zip(self.classes[v], self.d2[1:], strict=True))
        return (c - self.d2[min(c, 3)] + spare * self.alone(w)) / self.context[v]

    def score(self, text):
        w = [*words(lower(text)), None]
        base = sum(math.log10((self.single[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        return len(w), sum(self.single[x] > 0 for x in w), self.n, base, sum(math.log10(self.p(v, x)) for v, x in zip(["<s>", *w[:-1]], w, strict=True))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def compare(rows, got):
    model = Plain([t for i, t in rows if not held(i)])
    want = sorted((str(i), held(i), *model.score(t)) for i, t in rows)
    got = sorted((str(r.doc_id), not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    return want


def train():
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 1


@pytest.mark.parametrize("chunk,shard", [(1 << 21, 1 << 20), (1500, 700)])
def test_equals_plain_model(spark, chunk, shard):
    """In one chunk a task and shard, and in many."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = compare(rows, L.score(docs, train(), chunk=chunk, shard=shard).collect())
    unseen = [r for r in want if r[1]]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)  # better than single words on texts it has not seen


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a A b"), (3, " \t"), (3, "a b"), (3, "a b"), (4, "x " * 3000), (5, "Ä ä \x1c q"), (8, "b a\n\x0bc"), (11, "new words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.lit("clash")).withColumn("words", F.lit(1))
    compare(rows, L.score(docs, train(), chunk=5).collect())
    assert L.score(docs.where("false"), train()).collect() == []
    nothing = L.score(docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in nothing} == {(0, 0, 0.0, 0.0)}


def test_probabilities_sum_to_one():
    model = Plain(["a b a c", "a b b", "c a b a b", ""])
    for v in ("<s>", "a", "b", "c", "unseen"):
        assert sum(model.p(v, w) for w in [*model.single, "other"]) == pytest.approx(1)


def test_stored_arrays_are_sorted(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    L.score(docs, F.lit(True), model=f"file://{tmp_path}/model", shard=500).collect()
    shards = spark.read.parquet(f"file://{tmp_path}/model").collect()
    assert len(shards) > 1
    keys = np.concatenate([unpack_sorted(r["keys"]) for r in sorted(shards, key=lambda r: r.shard)])
    assert (keys[1:] > keys[:-1]).all()
    model = Plain([r.text for r in docs.collect()])
    assert sorted(np.concatenate([unpack(r["counts"]) for r in shards]).tolist()) == sorted(model.pair.values())


def test_packing_and_mixing():
    x = np.array([0, 3, 3, 1 << 40, (1 << 64) - 1], np.uint64)
    for part in (x, x[:0], x[:2]):
        assert (unpack(pack(part)) == part).all() and (unpack_sorted(pack_sorted(part)) == part).all()
    for bits in (2, 10, 46, 64):
        keys = np.arange(min(1 << bits, 1 << 12), dtype=np.uint64) * np.uint64(max(1, (1 << bits) // (1 << 12)))
        mixed = L.mixed(keys, bits)
        assert len(np.unique(mixed)) == len(keys) and int(mixed.max()) < 1 << bits and (L.unmixed(mixed, bits) == keys).all()


def test_query(spark):
    got = queries.QUERIES["op11_language_model"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert got.where("held_out").count() == sum(held(r.doc_id) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
