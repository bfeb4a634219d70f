import zlib

import numpy as np

from placeweave.llm import sharding


def test_differencing_keeps_everything_and_balances():
    rng = np.random.default_rng(2)
    for n, k in ((1, 3), (2, 2), (500, 24), (40, 7)):
        parts = rng.integers(0, 1000, (n, k))
        to = sharding.differencing(parts)
        assert all(sorted(row) == list(range(k)) for row in to)
        sums = np.zeros(k, np.int64)
        np.add.at(sums, to.reshape(-1), parts.reshape(-1))
        assert sums.sum() == parts.sum() and (n < 30 or sums.max() - sums.min() <= 20)


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 40)
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    rng = np.random.default_rng(4)
    texts = ["t%d " % i * int(n) for i, n in enumerate(rng.integers(0, 60, 600))] + [None, "", "copy", "copy", "copy é"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "copy", 1), (5, texts[5], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    got = sharding.shard_documents(df, 6).collect()
    assert len(got) == len(rows)
    where, count, load = {}, {}, {}
    by_id = {i: t for i, t, _ in rows}
    for r in got:
        data = (by_id[r.doc_id] or "").encode()
        assert r.size == len(data) + 8 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None
        assert where.setdefault(data, r.shard) == r.shard
        count.setdefault(r.shard, []).append(r.slot)
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert all(sorted(x) == list(range(len(x))) for x in count.values()) and len(load) == 6
    assert max(load.values()) - min(load.values()) <= 0.02 * max(load.values())
    assert sharding.shard_documents(df.limit(0), 6).count() == 0


def plain_differencing(sizes, k):
    """Karmarkar-Karp with lists of items: the two partial partitions of largest spread, oppositely ordered, until one is left."""
    parts = [(i, sorted([[s, [i]]] + [[0, []] for _ in range(k - 1)], key=lambda x: -x[0])) for i, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0][0] - p[1][-1][0]), p[0]))
        (_, a), (_, b), *parts = parts
        both = [[x + y, own + other] for (x, own), (y, other) in zip(a, b[::-1], strict=True)]
        parts.append((made, sorted(both, key=lambda x: -x[0])))
        made += 1
    return parts[0][1]


def test_equals_plain_differencing():
    rng = np.random.default_rng(6)
    for n, k in ((5, 2), (30, 4), (200, 24), (64, 3), (10, 24)):
        sizes = rng.integers(1, 5000, n)
        parts = np.zeros((n, k), np.int64)
        parts[:, 0] = sizes
        to = sharding.differencing(parts)[:, 0]
        got = np.bincount(to, weights=sizes, minlength=k).astype(int)
        want = plain_differencing(sizes.tolist(), k)
        assert sorted(got) == sorted(x for x, _ in want)
        assert sorted(sorted(np.flatnonzero(to == s).tolist()) for s in range(k)) == sorted(sorted(own) for _, own in want)
