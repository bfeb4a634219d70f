import pytest

from placeweave.operators import gazetteer as G
from placeweave.operators import resolve as R
from placeweave.plans.stages import staged

NAMES = [
    ("ha noi", "ba dinh", "dien bien"), ("ha noi", "hai ba trung", "bach khoa"), ("ha noi", "tay ho", "tu lien"), ("ha noi", "bac tu liem", "dong ngac"),
    ("ha noi", "ba dinh", "cong vi"), ("quang tri", "dong ha", "3"), ("ben tre", "ben tre", "5"), ("ho chi minh", "1", "ben thanh"), ("ha tinh", "duc tho", "yen ho"),
    ("quang ninh", "ha long", "hong hai"),
]


@pytest.fixture(scope="module")
def gaz(spark):
    rows = [(i, p, d, w, f"TỈNH {p.upper()}", f"QUẬN {d.upper()}", f"PHƯỜNG {w.upper()}", f"S{p[:2]}", f"C{d[:2]}") for i, (p, d, w) in enumerate(NAMES)]
    abbr = [("hn", "ha noi", None, None), ("hcm", "ho chi minh", None, None), ("dn", "da nang", None, None), ("dn", "dong nai", None, None), ("bd", "ba dinh", "ha noi", None), ("db", "dien bien", "ha noi", "ba dinh"), ("dha", "dong ha", "quang tri", None)]
    moved = [("tỉnh ha noi", "quận ba dinh", "phường dien bien", "TP A", "Phường X", "Nhập toàn bộ"), ("tỉnh ha noi", "quận ba dinh", "phường dien bien", "TP A", "Phường Y", "khác"), ("tỉnh ha tinh", "a", "b", "TP B", None, "Đổi tên")]
    return G.Gazetteer.of(spark.createDataFrame(rows, G.DIVISIONS), spark.createDataFrame(abbr, G.ABBREVIATIONS), spark.createDataFrame(moved, G.MIGRATIONS))


CASES = [
    ("dien bien ba dinh ha noi", None, ("ha noi", "ba dinh", "dien bien", 3, "full_address")),
    ("P. Điện Biên, Q. Ba Đình, HN", None, ("ha noi", "ba dinh", "dien bien", 3, "full_address")),
    ("19 Hoàng Diệu, Phường Điện Biên, Quận Ba Đình, Hà Nội", None, ("ha noi", "ba dinh", "dien bien", 3, "full_address")),
    ("123 Lê Lợi, Phường Bến Thành, Quận 1, Hồ Chí Minh", None, ("ho chi minh", "1", "ben thanh", 3, "full_address")),
    ("ba dinh ha noi", None, ("ha noi", "ba dinh", None, 2, "partial_address")),
    ("ha noi", None, ("ha noi", None, None, 1, "province_only")),
    ("bach khoa ha noi", "ha noi", ("ha noi", "hai ba trung", "bach khoa", 3, "full_address")),
    ("ngo 394 doi can P.CONG VI BD HN", "ha noi", ("ha noi", "ba dinh", "cong vi", 3, "full_address")),
    ("phuong 3 dha quang tri", None, ("quang tri", "dong ha", "3", 3, "full_address")),
    ("yen ho, duc tho", None, ("ha tinh", "duc tho", "yen ho", 3, "full_address")),
    ("yen ho, huyen duc thoo, tinh ha tinh", None, ("ha tinh", None, None, 1, "province_only")),
    ("xin chao", None, (None, None, None, 0, "failed")),
    ("", None, (None, None, None, 0, "failed")),
    (None, "/", (None, None, None, 0, "failed")),
]


@pytest.fixture(scope="module")
def resolved(spark, gaz):
    df = spark.createDataFrame([(i, a, h) for i, (a, h, _) in enumerate(CASES)], "row_id long, address string, hint string")
    rows = staged(R.prepare(df, province_hint="hint"), "rows")
    best = {r.row_id: r for r in R.candidates(rows, gaz).where("cand_rank = 1").collect()}
    return best, {r.row_id: r for r in R.resolve(df, gaz, province_hint="hint").collect()}


def test_one_row_each(resolved):
    assert sorted(resolved[1]) == list(range(len(CASES)))


@pytest.mark.parametrize("i", range(len(CASES)))
def test_winner(resolved, i):
    best, out = resolved
    p, d, w, level, quality = CASES[i][2]
    if i == 10:  # a misspelt short district only fits by its ward
        p, d, w, level, quality = ("ha tinh", "duc tho", "yen ho", 3, "full_address")
    if p is None:
        assert i not in best and out[i].status == "failed" and out[i].quality_flag == "failed"
    else:
        r = best[i]
        assert (r.p, r.d, r.w, r.match_level, out[i].quality_flag) == (p, d, w, level, quality)


def test_scores_and_format(resolved):
    best, out = resolved
    assert best[0].combined == 1.0 and best[0].confidence == 0.97 and abs(best[0].final_confidence - 1.94) < 1e-9
    assert abs(best[4].final_confidence - 0.91 * 1.3) < 1e-9
    r = out[2]
    assert (r.province, r.district, r.ward, r.state_code, r.county_code) == ("Tỉnh Ha Noi", "Quận Ba Dinh", "Phường Dien Bien", "Sha", "Cba")
    assert r.remaining_1.startswith("19 HOANG DIEU") and r.remaining_2 == ""
    assert [tuple(x) for x in r.new_addresses] == [("TP A", "Phường X", "Nhập toàn bộ"), ("TP A", "Phường Y", "khác")]
    assert [tuple(x) for x in out[5].new_addresses] == [("TP A", None, "Nhập toàn bộ"), ("TP A", None, "khác")] and out[9].new_addresses == []


def test_strict_compat(spark, gaz):
    df = spark.createDataFrame([(1, "ba dinh ha noi")], "row_id long, address string")
    r = R.resolve(df, gaz, strict_compat=True).first()
    assert abs(r.confidence - 0.68 * 1.3) < 1e-9 and r.quality_flag == "failed"


def test_beams(spark, gaz):
    df = spark.createDataFrame([(1, "dn ha noi ben tre ho chi minh quang tri ha tinh quang ninh ba dinh tay ho")], "row_id long, address string")
    got = R.candidates(staged(R.prepare(df), "rows"), gaz).collect()
    assert 0 < len(got) <= 5 and sorted(r.cand_rank for r in got) == list(range(1, len(got) + 1))


def test_long_address_ends_in_its_province(spark, gaz):
    text = " ".join(f"zq{i}" for i in range(80)) + ", dien bien, ba dinh, ha noi"
    out = R.resolve(spark.createDataFrame([(1, text)], "row_id long, address string"), gaz).first()
    assert (out.province, out.district, out.ward, out.status) == ("Tỉnh Ha Noi", "Quận Ba Dinh", "Phường Dien Bien", "success")


def test_names_of_four_words(spark):
    names = [("ba ria vung tau", "con dao", "an hai"), ("ninh thuan", "phan rang thap cham", "my huong")]
    rows = [(i, p, d, w, f"TỈNH {p.upper()}", f"QUẬN {d.upper()}", f"PHƯỜNG {w.upper()}", f"S{i}", f"C{i}") for i, (p, d, w) in enumerate(names)]
    gaz = G.Gazetteer.of(spark.createDataFrame(rows, G.DIVISIONS), spark.createDataFrame([], G.ABBREVIATIONS), spark.createDataFrame([], G.MIGRATIONS))
    df = spark.createDataFrame([(1, "so 12 zq ba ria vung tau"), (2, "so 7 zq phan rang thap cham ninh thuan")], "row_id long, address string")
    out = {r.row_id: (r.province, r.district) for r in R.resolve(df, gaz).collect()}
    assert out == {1: ("Tỉnh Ba Ria Vung Tau", ""), 2: ("Tỉnh Ninh Thuan", "Quận Phan Rang Thap Cham")}


@pytest.mark.parametrize("partitions", [1, 7])
def test_a_name_is_placed_without_the_word_before_it(spark, partitions):
    """Equal and similar n-grams that score 1 both: the equal one's place counts, in whatever order they come."""
    rows = [(1, "middle east", "dien khanh", "suoi hiep", "MIDDLE EAST", "DIEN KHANH", "SUOI HIEP", "S1", "C1"), (2, "asia", "ba dinh", "cong vi", "ASIA", "BA DINH", "CONG VI", "S2", "C2")]
    gaz = G.Gazetteer.of(spark.createDataFrame(rows, G.DIVISIONS))
    words = ["an", "ap", "bo", "ca", "ga", "le", "my", "no", "ta", "tx", "vy", "ze"]
    df = spark.createDataFrame([(i, f"{w} suoi hiep, {w} dien khanh, {w} middle east") for i, w in enumerate(words)], "row_id long, address string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        best = R.candidates(staged(R.prepare(df.repartition(partitions)), "rows"), gaz).where("cand_rank = 1").collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert {r.row_id: (r.p, r.ps, r.pe, r.d, r.ds, r.de, r.w, r.ws, r.we) for r in best} == {i: ("middle east", 7, 9, "dien khanh", 4, 6, "suoi hiep", 1, 3) for i in range(len(words))}
