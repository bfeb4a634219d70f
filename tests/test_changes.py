import time

import pytest
from pyspark.sql import functions as F

from placeweave.operators import changes, context, enrich, phrases, quarantine
from placeweave.operators import gazetteer as G
from placeweave.plans import pipelines

ROWS = [(1, "a", 1.0), (2, None, 2.0), (3, "c", None), (4, "", 4.0)]
DDL = "id int, k string, v double"


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_update_delete_merge(spark, tmp_path):
    base = spark.createDataFrame(ROWS, DDL)
    updated = changes.update(base, F.col("v") > 1, {"v": F.col("v") + F.col("id"), "id": F.lit(9)})
    assert table(changes.result(updated)) == table(spark.createDataFrame([(1, "a", 1.0), (9, None, 4.0), (3, "c", None), (9, "", 8.0)], DDL))
    assert changes.counts(updated).first().asDict() == {"updated": 2, "inserted": 0, "deleted": 0}
    gone = changes.delete(base, F.col("v") > 1)
    assert [r.id for r in changes.result(gone).orderBy("id").collect()] == [1, 3]
    merged = changes.merge(base, spark.createDataFrame([(7, None, 7.0), (8, "z", 8.0), (9, "a", 9.0)], DDL), ["k"])
    assert table(changes.result(merged)) == table(spark.createDataFrame([(3, "c", None), (7, None, 7.0), (8, "z", 8.0), (9, "a", 9.0)], DDL))
    path = f"file://{tmp_path}/after"
    assert changes.write(merged, path) == {"updated": 2, "inserted": 1, "deleted": 0}
    assert table(spark.read.parquet(path)) == table(changes.result(merged))
    assert changes.write(gone, f"file://{tmp_path}/less") == {"updated": 0, "inserted": 0, "deleted": 2}
    with pytest.raises(Exception, match="already exists"):  # nothing is replaced
        changes.write(gone, path)
    none = base.limit(0)
    assert changes.counts(changes.merge(none, none, ["k"])).first().asDict() == {"updated": 0, "inserted": 0, "deleted": 0}


def test_quarantine_of_lines(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,v,d\n1,2.5,2024-01-02\nx,2,2024-01-03\n3\n4,1,2024-01-04\n4,1,2024-01-05\n,3,2024-01-06\n")
    rows = quarantine.lines_csv(spark, str(tmp_path / "x.csv"), "id int, v double, d date")
    rows = quarantine.unique(quarantine.checked(rows, {"v is 2 or more": F.col("v") >= 2}), "id")
    good, bad = quarantine.split(rows)
    assert [(r.id, r.v) for r in good.collect()] == [(1, 2.5)] and quarantine.ERRORS not in good.columns
    found = {r.raw_line or (r.id, str(r.d)): r.errors for r in bad.collect()}
    assert found["x,2,2024-01-03"][0] == "malformed line" and "id is null" in found["x,2,2024-01-03"]
    assert found["3"][0] == "malformed line" and "v is 2 or more" in found["3"]
    assert found[4, "2024-01-04"] == ["v is 2 or more", "id is there 2 times"] and found[None, "2024-01-06"] == ["id is null"]


def test_batch_with_bad_rows(spark):
    dim = spark.createDataFrame([(0, "ha noi", "ba dinh", "dien bien", "HA NOI", "BA DINH", "DIEN BIEN", "01", "001")], G.DIVISIONS)
    job = pipelines.AddressPipeline(G.Gazetteer.of(dim))
    rows = [("1", "ba dinh, ha noi", "ok"), ("2", None, "ok"), ("2", "ha noi", "ok"), ("no", "ha noi", "ok"), (None, "ha noi", "ok"), ("7", "dien bien, ba dinh, ha noi", "late")]
    raw = spark.createDataFrame(rows, "row_id string, address string, state string")
    marked = quarantine.checked(quarantine.typed(raw, {"row_id": "bigint"}), {"state is ok": F.col("state") == "ok"})
    out = job.process_batch(marked).collect()
    assert len(out) == len(rows)
    assert {(r.row_id, r.status, r.error) for r in out} == {(1, "success", None), (2, "error", "row_id is there 2 times"), (None, "error", "row_id: no bigint: no; row_id is null"), (None, "error", "row_id is null"), (7, "error", "state is ok")}
    assert {r.quality_flag for r in out if r.status == "error"} == {"failed"} and [r.raw_input for r in out if r.row_id == 7] == [rows[5][1]]
    assert job.process_batch(raw.selectExpr("cast(row_id as long) as row_id", "address").limit(0)).count() == 0


def test_phrases(spark):
    known = spark.createDataFrame([(None, "a b", "AB"), (None, "a b c", "ABC"), ("x", "a b", "XAB"), (None, "c d", "CD"), (None, "b c d", "BCD"), (None, "é f", "EF"), (None, None, "n"), (None, "q r", None), (None, "g.h", "GH"), (None, "?", "mark"), (None, "a b", "later")], "context string, key string, word string")
    texts = {"a b c": "ABC", "A B, a b": "AB, AB", "a b c d": "ABC d", "xa b": "xa b", "a  b": "a  b", "(a b)c d": "(AB)CD", "É F g.h g h": "EF GH g h", "": "", "...": "...", None: None, "b c d": "BCD", "q r ?": "q r ?"}
    rows = spark.createDataFrame([(i, t, c) for i, t in enumerate(texts) for c in (None, "x", "y")], "row int, text string, context string")
    got = {(r.text, r.context): r.replaced for r in phrases.replaced(rows, known, "text", "context").collect()}
    assert len(got) == 3 * len(texts)
    assert got == {(t, c): "XAB, XAB" if c == "x" and t == "A B, a b" else "(XAB)CD" if c == "x" and t == "(a b)c d" else want for t, want in texts.items() for c in (None, "x", "y")}
    assert phrases.replaced(rows, known.limit(0), "text").where("replaced <=> text").count() == rows.count()
    assert phrases.replaced(rows.limit(0), known, "text").count() == 0


def test_many_phrases(spark):
    """The work does not follow the number of phrases."""
    known = spark.range(100_000).selectExpr("cast(null as string) as context", "concat('word', id, ' of ', id) as key", "concat('<', id, '>') as word")
    rows = spark.range(300).selectExpr("id", "concat('x word', id * 333, ' of ', id * 333, ' y') as text")
    assert [r.replaced for r in phrases.replaced(rows, known, "text").orderBy("id").collect()] == [f"x <{i * 333}> y" for i in range(300)]


def test_hints(spark):
    short = spark.createDataFrame([("hn", "ha noi", None, None), ("bd", "ba dinh", "ha noi", None), ("bd", "binh duong", None, None), ("dn", "da nang", None, None), ("dn", "dong nai", None, None)], G.ABBREVIATIONS)
    rows = spark.createDataFrame([(1, "HN", "Q. BD", "keep"), (2, "x", "bd", "keep"), (3, None, "bd", "keep"), (4, "dn", None, "keep"), (5, "/", "", "keep")], "id int, p string, d string, text string")
    got = {r.id: (r.p, r.d, r.text) for r in context.hints(rows, short, "p", "d").collect()}
    assert got == {1: ("ha noi", "q. ba dinh", "keep"), 2: ("x", "binh duong", "keep"), 3: (None, "binh duong", "keep"), 4: ("dn", None, "keep"), 5: ("/", "", "keep")}


def test_lookups_are_counted(spark, tmp_path):
    calls = tmp_path / "calls"

    def lookup(q):
        with open(calls, "a") as f:
            f.write(f"{q} {time.monotonic()}\n")
        if q == "bad":
            raise ValueError("no")
        return None if q == "none" else q.upper()

    df = spark.createDataFrame([(i, q) for i, q in enumerate(["a", "b", "a", "none", None, "bad", "a"])], "i int, q string").repartition(4)
    cache = f"file://{tmp_path}/cache"
    first = {r.i: (r.answer, r.answer_error) for r in enrich.enrich(df, "q", lookup, 20, cache, tasks=2, with_errors=True).collect()}
    assert first == {0: ("A", None), 1: ("B", None), 2: ("A", None), 3: (None, None), 4: (None, None), 5: (None, "ValueError: no"), 6: ("A", None)}
    at = [line.split() for line in calls.read_text().splitlines()]
    assert sorted(q for q, _ in at) == ["a", "b", "bad", "bad", "bad", "none"]
    again = enrich.enrich(df, "q", lookup, 1000, cache, attempts=1)
    assert {r.i: r.answer for r in again.collect()} == {i: a for i, (a, _) in first.items()}
    assert len(calls.read_text().splitlines()) == 7  # only what failed is asked again
    began = time.monotonic()
    slow = enrich.enrich(spark.range(20).selectExpr("cast(id as string) as q").repartition(10), "q", lookup, 10, tasks=5)
    assert slow.count() == 20 and time.monotonic() - began > 1.2  # 20 calls by 5 tasks, each 2 a second
