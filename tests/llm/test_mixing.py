import duckdb
import pytest
from pyspark.sql import functions as F

from placeweave.llm import mixing


def targets(sizes, cap=3, weights=(1, 2, 3)):
    """Fill by weight again and again, as the contract says it."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        now = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if now[s] > cap * sizes[s]]
        if not over:
            return fixed | now
        fixed |= {s: float(cap * sizes[s]) for s in over}


@pytest.mark.parametrize("buckets", [16384, 3])
def test_mix(spark, monkeypatch, buckets):
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rows = [(i, "w " * (i % 9) + "!!" * (i % 2), [None, "a", "b", "c", "é", "B"][i % 6 if i % 5 else 1]) for i in range(300)]
    rows += [(None, None, "a"), (7, "x y", "a"), (7, "x y", "a"), (900, "only words " * 4000, "huge"), (901, "", "empty"), (902, "a b", "small")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, target int")
    got = mixing.mix(mixing.with_keys(df).drop("text")).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.epochs * r.size <= r.taken <= (r.epochs + 1) * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(mixing.with_keys(df.repartition(7)).drop("text")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(mixing.with_keys(df.limit(0))).count() == 0


def test_oracle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    documents = docs.toPandas()  # noqa: F841  (read by DuckDB)
    want = sorted(duckdb.sql(mixing.ORACLE).fetchall())
    got = mixing.mix(mixing.with_keys(docs)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == want


def test_mixed_rows(spark):
    df = spark.createDataFrame([(1, "a  b c d", "x", 8), (2, "e f", "y", 3), (3, None, "y", 0)], "doc_id long, text string, source string, n_chars long")
    got = mixing.mixed(df).collect()
    assert sorted(map(tuple, got)) == [(1, "a  b c d", "x", 8), (2, "e f", "y", 3), (2, "e f", "y", 3)]  # half of the first is whole
    longer = spark.createDataFrame([(1, "a b c d e f g", "x", 13), (2, "e f", "y", 3)], "doc_id long, text string, source string, n_chars long")
    assert {r.doc_id for r in mixing.mixed(longer).collect()} == {2}  # less than half of it


def test_clashing_names(spark):
    names = ["size", "rest", "edge", "before", "tie", "bucket", "row", "s", "words", "sample_key", "extra", "copy", "doc", "taken", "target"]
    rows = [(i, "w " * (i % 7), "ab"[i % 2], *[99] * len(names)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in names))
    out = mixing.mixed(df)
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {(99,) * len(names)}
    plain = mixing.mixed(df.select("doc_id", "text", "source")).collect()
    assert sorted((r.doc_id, r.text) for r in plain) == sorted((r.doc_id, r.text) for r in out.collect())
    kept = mixing.mix(mixing.with_keys(df)).collect()
    assert all((r.rest, r.edge, r.before, r.bucket, r.row, r.s, r.words) == (99,) * 7 for r in kept)


def test_no_bucket_is_large(spark):
    """Whatever the weights are, what one task sorts is a small share of a source."""
    n = 200_000
    for weight in (F.lit(1.0), F.lit(0.14), F.lit(0.05), F.lit(None).cast("double"), F.lit(float("inf")), F.lit(-1.0), F.lit(1e-30), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.05)):
        most = spark.range(n).select(mixing.bucket_of(mixing.sample_key(F.col("id"), weight)).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
        assert most < n / 2000


def test_weights_order_the_useless_last(spark):
    rows = [(i, float(w) if w is not None else None) for i, w in enumerate([None, 0, -1, float("inf"), float("nan"), 1e-9, 0.5, 1])]
    got = spark.createDataFrame(rows, "doc_id long, w double").select("doc_id", mixing.sample_key(F.col("doc_id"), F.col("w")).alias("k")).orderBy("k").collect()
    assert {r.doc_id for r in got[:3]} == {5, 6, 7}
