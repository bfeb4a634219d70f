import numpy as np
from pyspark.sql import functions as F

from placeweave.llm import neighbours


def brute(rows, queries, k):
    out = {}
    for q in queries:
        v = dict(rows)[q]
        hits = sorted((-float((np.float64(v) * np.float64(w)).sum()), i) for i, w in rows if i != q)
        out[q] = [(i, -s) for s, i in hits[:k]]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(60)] + [(100 + i, [1.0] * 8) for i in range(40)]
    odd = [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [1.0, None] * 4), (280, []), (300, [1.0] * 3), (None, [1.0] * 8), (320, [float("inf")] * 8), rows[3]]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(want)
    for q, hits in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in hits]
        assert np.allclose([s for _, s in found[q]], [s for _, s in hits], atol=1e-12)
    few = neighbours.search(df.where("vec_id < 10"), F.col("vec_id") == 0, k=20).collect()
    assert len(few) == 9
    assert neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_recall_with_parts_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PER_PART", 120)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16)) * 2
    x = (centres[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 16))).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=10, sample=800).toPandas()
    want = brute(list(enumerate(x)), range(0, 1500, 20), 10)
    own = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    hits = sum(len({i for i, _ in h} & own[q]) for q, h in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9 and len(got) == 75 * 10
    hot = got[got.query_id == 60].sort_values("rank")
    assert len(hot) == 10


def test_balanced_parts():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 8))
    graph = neighbours._top(x, x, 8, True)
    label = neighbours.balanced_parts(x, graph, 9, rng)
    assert np.bincount(label, minlength=9).max() <= np.ceil(1.1 * 100) and (label[graph] == label[:, None]).mean() > 0.2


def recall_of(spark, x, k=10, **options):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=k, **options).toPandas()
    asked = range(0, len(x), 20)
    wide = x.astype(np.float64)
    s = wide[::20] @ wide.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -np.inf
    want = np.argsort(-s, axis=1, kind="stable")[:, :k]
    own = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    assert len(got) == k * len(asked)
    return sum(len(set(w.tolist()) & own[q]) for q, w in zip(asked, want, strict=True)) / want.size


def clustered(n, seed, dim=16, centres=40):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim)) * 2
    return (c[rng.integers(0, centres, n)] + rng.standard_normal((n, dim)) * 0.7).astype(np.float32)


def test_small_tables_have_parts_too(spark, monkeypatch):
    used = []
    learn = neighbours.learn
    monkeypatch.setattr(neighbours, "learn", lambda x, parts, *rest: used.append(parts) or learn(x, parts, *rest))
    assert recall_of(spark, clustered(500, 3)) >= 0.9 and used == [neighbours.FEW_PARTS]


def test_parts_are_cut_again_where_the_table_grows(spark, monkeypatch):
    """Three levels: parts stay small, recall stays high, and every query still gets its k."""
    for name, value in (("PER_PART", 20), ("MAX_PARTS", 8), ("FEW_PARTS", 4), ("PART_SAMPLE", 400), ("SPLIT", 3), ("BLOCK", 100), ("QUERY_BLOCK", 50)):
        monkeypatch.setattr(neighbours, name, value)
    cut = []
    descended = neighbours._descended
    monkeypatch.setattr(neighbours, "_descended", lambda rows, *rest: cut.append(1) or descended(rows, *rest))
    assert recall_of(spark, clustered(3000, 4), sample=600) >= 0.9
    assert len(cut) >= 4  # two levels below the first, index and queries


def test_probes_hold_enough_vectors():
    rng = np.random.default_rng(0)
    router = neighbours.Router(4, 6, rng)
    sizes = np.array([0, 1, 2, 0, 30, 5])
    probed, at, to = neighbours._probes(router, rng.standard_normal((50, 4)), sizes, 4)
    assert all(sizes[row].sum() >= 5 for row in probed) and probed.sum() == len(at) == len(to)
