import json

from placeweave.operators import enrich, review, snapshots, structural
from placeweave.operators import gazetteer as G
from placeweave.plans import pipelines
from placeweave.sources import readers, writers
from placeweave.streaming import live

ROWS = [(0, "ha noi", "ba dinh", "dien bien"), (1, "ha noi", "hoang mai", "thanh tri"), (2, "ha noi", "thanh tri", "tu hiep"), (3, "ha noi", "tay ho", None)]


def gazetteer(spark):
    df = spark.createDataFrame([(i, p, d, w, p.upper(), d.upper(), w and w.upper(), "S", "C") for i, p, d, w in ROWS], G.DIVISIONS)
    streets = spark.createDataFrame([(1, "ha noi", "ba dinh", "doi can")], G.STREETS)
    return G.Gazetteer.of(df, streets=streets)


def test_csv_in_and_out(spark, tmp_path):
    (tmp_path / "in.csv").write_text("﻿COT1,COT2,COT3\n12 doi can,dien bien,ba dinh ha noi\n,,\n", encoding="utf-8")
    got = {r.address for r in readers.addresses_csv(spark, str(tmp_path / "in.csv")).collect()}
    assert got == {"12 doi can dien bien ba dinh ha noi", ""}
    results = pipelines.run_csv(spark, gazetteer(spark), str(tmp_path / "in.csv"), str(tmp_path / "out"))
    assert {r.quality_flag: r.n for r in pipelines.quality_counts(results).collect()} == {"full_address": 1, "failed": 1}
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert set(back.columns) == set(writers.RESULT_COLUMNS) and back.count() == 2


def test_parquet_etl(spark, tmp_path):
    spark.createDataFrame([("doi can", "dien bien", "ba dinh", "ha noi"), (None, " ", None, None)], "a string, b string, c string, d string").write.parquet(str(tmp_path / "in"))
    pipelines.run_parquet(spark, gazetteer(spark), str(tmp_path / "in"), str(tmp_path / "out"), ["a", "b", "c", "d"])
    rows = {r.raw_address: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    r = rows["doi can, dien bien, ba dinh, ha noi"]
    assert (r.parsed_province, r.parsed_district, r.parsed_ward, r.parsed_street) == ("ha noi", "ba dinh", "dien bien", "doi can") and len(rows) == 2


def test_tree_and_snapshots(spark, tmp_path):
    tree = {"province": "p", "districts": [{"district": "d", "ward": ["a", "b"], "street": ["s"]}, {"district": "e", "ward": [], "street": None}]}
    (tmp_path / "t.json").write_text(json.dumps(tree))
    df = readers.tree_json(spark, str(tmp_path / "t.json"))
    assert tuple(snapshots.tree_counts(df).first()) == (1, 2, 2, 1)
    wards, streets = snapshots.flatten_tree(df)
    assert wards.count() == 2 and streets.count() == 1
    for month, name in (("2024-01", "x"), ("2024-02", "y")):
        (tmp_path / f"s_{month}.csv").write_text(f"effective_date,column_0,column_1\n{month},{name},k\n")
    merged = snapshots.merge_latest(readers.snapshots_csv(spark, str(tmp_path / "s_*.csv")), ["column_1"])
    assert merged.first().column_0 == "y"
    assert writers.snapshot(merged.drop("effective_date"), "2024-03").columns == ["effective_date", "column_0", "column_1"]


def test_structural_and_disambiguation(spark):
    df = spark.createDataFrame([(1, "xa yen ho, duc tho, tinh ha tinh"), (2, "cong ty abc, p. x"), (3, "khong co dau phay")], "row_id long, text string")
    segs = structural.segments(df)
    assert [(r.level, r.name) for r in segs.orderBy("position").collect()] == [("ward", "yen ho"), ("unknown", "duc tho"), ("province", "ha tinh")]
    r = structural.hierarchy(segs, spark.createDataFrame([("ha tinh",)], "p string")).first()
    assert (r.ward, r.district, r.province) == ("yen ho", "duc tho", "ha tinh") and abs(r.confidence - 0.85) < 1e-9
    names = spark.createDataFrame([(1, "ha noi", "thanh tri"), (1, "ha noi", "ba dinh")], "row_id long, p string, name string")
    got = {tuple(r) for r in structural.disambiguate(names, gazetteer(spark).divisions).collect()}
    assert got == {(1, "ha noi", "thanh tri", None, "as_district"), (1, "ha noi", "hoang mai", "thanh tri", "as_ward")}


def test_enrichment(spark):
    df = spark.createDataFrame([("a",), ("b",)], "q string")
    got = enrich.enrich(df, "q", {"a": "1"}.__getitem__, 1000).collect()
    assert [tuple(r) for r in got] == [("a", "1"), ("b", None)]
    answer = json.dumps({"status": "OK", "predictions": [{"description": "x", "place_id": "1", "compound": {"province": "Hà Nội", "district": "Quận Ba Đình", "commune": "Điện Biên"}}, {"place_id": "2", "compound": {"province": "Hà Nội"}}]})
    rows = enrich.place_candidates(spark.createDataFrame([(answer,)], "answer string")).orderBy("place_rank").collect()
    assert [(r.p, r.d, r.w, r.at_rule, r.confidence) for r in rows] == [("ha noi", "ba dinh", "dien bien", 3, 0.95), ("ha noi", None, None, 1, 0.9)]


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a", None, 3), (2, "b", "x", 1)], "id int, address string, province string, user_rating int")
    change = spark.createDataFrame([(3, "a", "", 2), (4, "c", None, 0)], base.schema)
    got = {(r.address, r.user_rating) for r in review.upsert(base, change, ["address", "province"]).collect()}
    assert got == {("a", 2), ("b", 1), ("c", 0)}
    assert [r.user_rating for r in review.update_rating(base, 2, 0).orderBy("id").collect()] == [3, 0]
    assert review.distribution(base.limit(0)).first().total == 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ha noi"), (2, "ba dinh ha noi")], "row_id long, address string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.resolve_stream(stream, gazetteer(spark), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert {r.row_id: r.at_rule for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 1, 2: 2}
    log = spark.createDataFrame([("k", 1), ("k", 2), ("j", 1)], "k string, ts int")
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    live.upsert_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), str(tmp_path / "up"), str(tmp_path / "c2"), ["k"]).awaitTermination(120)
    assert {tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "up/version=0")).collect()} == {("k", 2), ("j", 1)}
