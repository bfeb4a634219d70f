import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from brute import repeated_windows

from placeweave.llm import fm_index, repeats


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "of", "the", "é"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefgh") for _ in range(5))
    pool = [[word() for _ in range(rng.randrange(15, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(1, 6)):
            part = list(rng.choice(pool)) if rng.random() < 0.5 else [word() for _ in range(rng.randrange(1, 40))]
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = word()
            w += part
        rows.append((i * 7 % n, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows + [(900, None), (901, ""), (902, "x " * 50), (903, "x " * 50), (904, rows[0][1]), (905, rows[0][1])]


def check(spark, rows):
    got = repeats.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = repeated_windows(rows)
    assert len(got) == len(rows)
    for r in got:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()), r.doc_id


@pytest.mark.parametrize("hot", [20_000, 1])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD", 30)
    check(spark, corpus(hot))


def test_null_and_repeated_ids(spark):
    t = " ".join(map(str, range(30)))
    rows = [(None, t), (5, t), (5, t), (5, "new " + t), (6, "short"), (6, "short")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, h int")
    got = sorted(((r.doc_id or -1, r.n_words, r.n_removed) for r in repeats.dedup_substrings(df).collect()))
    assert got == [(-1, 30, 0), (5, 30, 30), (5, 30, 30), (5, 31, 30), (6, 1, 0), (6, 1, 0)]
    assert repeats.dedup_substrings(df.limit(0)).count() == 0


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for depth in (2, 3, 5, 8, 20):
        docs = [rng.integers(1, 4, rng.integers(depth, 40)) for _ in range(20)]
        text = np.concatenate([np.append(d, 0) for d in docs])
        index = fm_index.FMIndex(text, depth)
        for d, (low, high, length) in zip(docs + (more := [rng.integers(1, 6, 50) for _ in range(4)]), fm_index.matching_statistics(index, docs + more), strict=True):
            for p in range(len(d) - depth + 1):
                want = [i for i in range(len(text) - depth + 1) if (text[i : i + depth] == d[p : p + depth]).all()]
                assert (length[p] == depth) == bool(want)
                assert not want or sorted(index.suffixes[low[p] : high[p]]) == want


def test_nothing_is_removed_without_an_interval(monkeypatch):
    """The index judges: where it reports no match, no word goes, copies included."""
    real = fm_index.matching_statistics

    def none(index, docs):
        return [(low, high, 0 * length) for low, high, length in real(index, docs)]

    monkeypatch.setattr(repeats, "matching_statistics", none)
    got = repeats.repeated_windows(shard_of(["a b c d e f g h i j k l m n o p q r s t u", "x a b c d e f g h i j k l m n o p q r s t"]))
    assert got["mask"].tolist() == [0, 0] and got["found"].tolist() == [0, 0]
    monkeypatch.setattr(repeats, "matching_statistics", real)
    got = repeats.repeated_windows(shard_of(["a b c d e f g h i j k l m n o p q r s t u", "x a b c d e f g h i j k l m n o p q r s t"]))
    assert got["mask"].tolist() == [0, 2] and got["found"].tolist() == [3, 3]


def shard_of(contents):
    return pd.DataFrame([(1, i, i, 0, len(c.split()) - 19, c) for i, c in enumerate(contents)], columns=["h", "ch", "doc", "start", "n", "content"])
