import random

import numpy as np
from brute import near_components

from placeweave.llm import components, near_dedup, shingles

import pyarrow as pa


def near_texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 6)))
    bases = [[word() for _ in range(rng.choice([1, 3, 5, 8, 40, 90]))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        out.append((i, rng.choice([" ", "\n", "\t "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return out


def test_shingle_sets_equal_plain_ones():
    from brute import shingles as plain

    texts = [None, "", " ", "a", " A b\x0bc d ", "a b c d e", "a b c d e f a b c d e", "é É x y z w", "x " * 5000]
    got = shingles.shingle_sets(pa.array(texts))
    assert [len(x) for x in got] == [len(plain(t)) for t in texts]
    assert [len(x) for x in shingles.shingle_sets(pa.array(texts).slice(2, 4))] == [len(plain(t)) for t in texts[2:6]]
    assert shingles.overlap(got[5], got[6]) == 1


def test_near_duplicates_equal_brute_force(spark):
    rows = near_texts(400, 3) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "w " * 30000), (1004, "w " * 30000)]
    for percent in (85, 80):
        want = near_components(rows, percent)
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_null_and_repeated_ids(spark):
    t = "one two three four five six seven"
    rows = [(None, t), (None, t), (7, t), (7, "other words that stand here alone now"), (9, "other words that stand here alone now"), (3, "zz"), (3, "zz")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cid string")
    got = sorted(near_dedup.near_duplicates(df).collect(), key=lambda r: (r.doc_id or -1, r.n_shingles))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(None, None, True)] * 2 + [(3, 3, True)] * 2 + [(7, 7, True)] * 2 + [(9, 7, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.deduplicated(df).columns == df.columns


def test_components(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", 8)
    rng = np.random.default_rng(1)
    pairs = np.concatenate([rng.integers(0, 300, (200, 2)), np.stack([np.arange(1000, 1100), np.arange(1001, 1101)], 1)])
    want = components.union_find(pairs)
    got = components.components(spark.createDataFrame(pairs.tolist(), "a long, b long").repartition(7))
    assert {r.v: r.root for r in got.collect()} == want


def test_common_counts_equal_intersections(monkeypatch):
    monkeypatch.setattr(near_dedup, "COMMON", 4)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in rng.integers(1, 40, 30)]
    for left, right in ((np.arange(30), np.arange(30)), (np.arange(0, 30, 2), np.arange(1, 30, 2))):
        got = near_dedup.common_counts(sets, left, right)
        want = np.array([[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left])
        off = left[:, None] != right[None]
        assert (got == want)[off].all()


def test_variants_of_one_original_are_one_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 1 << 16)  # several blocks
    rng = random.Random(7)
    original = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(original))]
    for i in range(1, 2001):
        w = list(original)
        for j, at in enumerate(sorted(rng.sample(range(10, 190, 10), 3))):
            w[at] = f"v{i}x{j}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(got) == 2001 and {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]


def edge_pairs(spark, rows, ranges, monkeypatch):
    classes = spark.createDataFrame(rows, "cid long, n long, sig binary")
    with monkeypatch.context() as m:
        m.setattr(near_dedup, "TREES", 1)
        kept = type(classes).repartitionByRange
        m.setattr(type(classes), "repartitionByRange", lambda df, *cols: kept(df, ranges, *cols))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            return {(r.l, r.r) for r in near_dedup.candidates(classes, 85).collect()}
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_short_ranges_lose_no_neighbours(spark, monkeypatch):
    rows = [(i, 100, b"same" * 5 + i.to_bytes(4, "big")) for i in range(24)]
    whole = edge_pairs(spark, rows, 1, monkeypatch)
    assert whole >= {(j, i) for i in range(24) for j in range(max(0, i - near_dedup.REACH), i)}
    for ranges in (3, 8, 12, 24):
        assert {(j, i) for j, i in whole if i - j <= near_dedup.REACH} <= edge_pairs(spark, rows, ranges, monkeypatch)


def test_template_documents(spark):
    """Documents of one template, each some edits from it, and a partner for every other one: no link is lost."""
    rng = random.Random(11)
    template, rows = [f"t{i}" for i in range(400)], []

    def edited(words, n, tag):
        words = list(words)
        for j, at in enumerate(rng.sample(range(len(words)), n)):
            words[at] = f"{tag}x{j}"
        return words

    for i in range(120):
        own = edited(template, 9, f"d{i}")
        rows.append((2 * i, " ".join(own)))
        if i % 2:
            rows.append((2 * i + 1, " ".join(edited(own, rng.choice([3, 5, 6]), f"p{i}"))))
    want = near_components(rows, 85)
    assert 50 < sum(root != i for i, (_, root) in want.items()) < len(rows)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(24)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
