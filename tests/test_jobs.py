"""Jobs, files and lookups beside the resolver's main path."""

import json

from placeweave.operators import context, enrich, review
from placeweave.operators import gazetteer as G
from placeweave.plans import pipelines
from placeweave.sources import readers, writers
from tests.test_io import gazetteer


def results(spark, flags):
    rows = [("addr, " + f, *[""] * 8, 1, 0.5, f, [("a", "b", "c"), ("d", None, "e")] if f == "full_address" else []) for f in flags]
    names = writers.RESULT_COLUMNS[:9]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names) + ", at_rule int, confidence double, quality_flag string, new_addresses array<struct<new_province:string,new_ward:string,note:string>>")


def test_result_files_by_quality(spark, tmp_path):
    writers.write_result_files(results(spark, ["full_address", "failed", "odd"]), str(tmp_path / "out"))
    texts = {folder: [p.read_bytes() for p in sorted((tmp_path / "out" / folder).glob("*.csv"))] for _, folder in writers.FOLDERS}
    assert all(t.startswith(b"\xef\xbb\xbf" + ",".join(writers.RESULT_COLUMNS).encode()) for part in texts.values() for t in part)
    lines = {folder: sum(len(t.splitlines()) - 1 for t in part) for folder, part in texts.items()}
    assert lines == {"full": 2, "partial": 0, "province": 0, "failed": 2} and len(writers.RESULT_COLUMNS) == 16


def test_statistics_and_errors(spark):
    job = pipelines.AddressPipeline(gazetteer(spark))
    assert job.process("dien bien, ba dinh, ha noi")["quality_flag"] == "full_address"
    broken = pipelines.AddressPipeline(G.Gazetteer.of(gazetteer(spark).divisions.drop("state_code")))
    out = broken.process("ba dinh, ha noi")
    assert out["status"] == "error" and out["quality_flag"] == "failed" and out["error"] and broken.get_stats()["failed"] == 1
    job.count(spark.createDataFrame([("success",), ("failed",)], "status string"))
    assert job.get_stats() == {"total_processed": 3, "successful": 2, "failed": 1, "success_rate": 2 / 3}
    job.reset_stats()
    assert job.get_stats()["success_rate"] == 0.0


def test_two_passes(spark):
    abbreviations = spark.createDataFrame([("tx", "thanh xuan", "ha noi", None), ("a b", "alpha", None, None), ("a b c", "beta", None, None), ("hn", "ha noi", None, None)], G.ABBREVIATIONS)
    texts = ["TX, HN", "a b c a b", None, "", "hn quan 7", "tx"]
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], "row_id long, address string, iterations string")
    got = {r.row_id: (r.normalized, r.province_context, r.district_context, r.iterations) for r in context.iterative(df, abbreviations).collect()}
    assert got == {0: ("thanh xuan ha noi", "ha noi", None, 2), 1: ("beta alpha", None, None, 1), 2: ("", None, None, 1), 3: ("", None, None, 1), 4: ("ha noi quan 7", "ha noi", "quan 7", 2), 5: ("tx", None, None, 1)}
    assert context.iterative(df.limit(0), abbreviations.limit(0)).count() == 0
    assert context.iterative(df, abbreviations.limit(0)).where("normalized = 'tx hn'").count() == 1


def test_lookup_without_enough_names(spark):
    dim = gazetteer(spark).divisions
    df = spark.createDataFrame([(1, "ha noi", None, None), (2, "ha noi", " ", "dien bien"), (3, None, None, None), (4, "ha noi", "ba dinh", "x")], "row_id long, p string, d string, w string")
    got = {r.row_id: r.found and (r.found.id, r.found.d_full, r.found.w_full) for r in G.lookup(df, dim).collect()}
    assert got == {1: None, 2: (0, None, "DIEN BIEN"), 3: None, 4: None}
    assert {(r.row_id, r.division.id) for r in G.scoped(df, dim).collect()} == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3), (4, 0)}


def test_places_and_readers(spark, tmp_path):
    answer = {"status": "OK", "predictions": [{"place_id": "1", "compound": {"province": "Hà Nội"}}, {"place_id": "2"}]}
    df = spark.createDataFrame([("19 X", None, "Hà Nội"), ("y", "d", "p")], "address string, district string, province string")
    found = enrich.enhanced(df, lambda q: json.dumps(answer) if q == "19 X, Hà Nội" else None, per_second=1000).collect()
    assert [(r.place_id, r.p) for r in found] == [("1", "ha noi")]
    odd = spark.createDataFrame([("{",), (None,), ('{"status": "OK"}',), ('{"status": "OK", "result": {"name": "n"}}',)], "answer string")
    assert [(r.place_name, r.lat, r.area_1) for r in enrich.place_details(odd).collect()] == [("n", None, None)]
    assert readers.first_row(spark, "select id from range(5) where id > :least order by id", least=2) == {"id": 3} and readers.first_row(spark, "select 1 where false") is None
    for name, head in (("a", "x,y\n1,2\n"), ("b", "y,z\n3,4\n")):
        (tmp_path / f"{name}.csv").write_text(head)
    both = readers.snapshots_of(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert {tuple(r) for r in both.select("x", "y", "z").collect()} == {("1", "2", None), (None, "3", "4")}
    rated = review.rated(spark.createDataFrame([(i, i % 4) for i in range(40)], "id int, user_rating int"), [1, 3], 12, 7)
    assert rated.count() == 12 and {r.user_rating for r in rated.collect()} <= {1, 3}
