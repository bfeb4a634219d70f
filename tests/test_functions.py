import pytest
from pyspark.sql import functions as F

from placeweave import constants as K
from placeweave.functions import scoring as C
from placeweave.functions import similarity as S
from placeweave.functions import text as T
from placeweave.functions import tokens as N

L = F.lit


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def words(text):
    return F.array(*map(L, text.split()))


TEXTS = [
    (lambda: T.fold_accents(L("Điện Biên, ñçü Ở")), "Dien Bien, ñçü O"),
    (lambda: T.normalize_address(L("P. Điện Biên, Q. Ba Đình, HN"), True), "p dien bien q ba dinh hn"),
    (lambda: T.finalize(L("55 BE VAN DAN,P14,Q TAN BINH"), True), "55 be van dan p14 q tan binh"),
    (lambda: T.finalize(L("P.CONG VI")), "p cong vi"),
    (lambda: T.finalize(L("P.CONG VI"), True), "pcong vi"),
    (lambda: T.expand_structural(L("F.3 P 4, Q5 TP. HCM t.p. X")), "phuong 3 phuong 4, quan 5 thanh pho hcm thanh pho x"),
    (lambda: T.strip_admin(L("thanh pho ha noi")), "ha noi"),
    (lambda: T.strip_admin(L("phuong dien bien")), "dien bien"),
    (lambda: T.strip_first_prefix(L(" Quan Ba Dinh ")), "ba dinh"),
    (lambda: T.admin_number(L("06")), "6"),
    (lambda: T.admin_number(L("123")), "123"),
    (lambda: T.admin_number(L("dien bien")), "dien bien"),
    (lambda: T.title_case(L("  dien   BIEN ")), "Dien Bien"),
    (lambda: T.name_of_full(L("THÀNH PHỐ HÀ NỘI")), "Hà Nội"),
    (lambda: T.strip_marks_upper(L("Điện Biên")), "ĐIEN BIEN"),
    (lambda: T.clean_token(L(".,ab;c!?")), "ab;c"),
    (lambda: T.normalize_hint(L("/")), None),
    (lambda: T.normalize_hint(L("Quận Ba Đình")), "ba dinh"),
    (lambda: T.nfc(L("áx")), "áx"),
    (lambda: T.expand_phrases(L("x hbt y hbt2"), {"hbt": "hai ba trung"}), "x hai ba trung y hbt2"),
    (lambda: F.array_join(T.expand_words(words("q. hn x"), F.create_map(L("hn"), L("ha noi"))), " "), "q. ha noi x"),
    (lambda: T.is_noise(L("CONG  TY abc")), True),
    (lambda: T.is_noise(L(None).cast("string")), False),
]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_text(spark, i):
    assert value(spark, TEXTS[i][0]()) == TEXTS[i][1]


NUMBERS = [
    (lambda: S.similarity(L("ba dinh"), L("ba din")), 1 - 1 / 7),
    (lambda: S.ensemble(L("tmo cay"), L("mo cay")), 1.0),
    (lambda: S.ensemble(L("co nhue1"), L("co nhue 1")), 1 - 1 / 9),
    (lambda: S.ensemble(L("an vinh ngaiksnd"), L("an vinh ngai")), 1.0),
    (lambda: S.ensemble(L(""), L("x")), 0.0),
    (lambda: S.jaccard(L("phuong dien bien"), L("phuong dien bien quan")), 0.75),
    (lambda: S.token_sort_ratio(L("ba dinh quan"), L("quan ba dinh")), 1.0),
    (lambda: S.token_sort_ratio(L("abcd"), L("abxd")), 0.75),
    (lambda: C.continuity(F.array(L(0), L(1), L(4), L(5))), 0.5),
    (lambda: C.proximity((L(2), L(4)), (L(4), L(7)), (L(7), L(9))), 1.0),
    (lambda: C.proximity((L(-1), L(-1)), (L(-1), L(-1)), (L(7), L(9))), 0.5),
    (lambda: C.order_bonus(L(2), L(4), L(7)), 1.1),
    (lambda: C.order_bonus(L(5), L(4), L(None).cast("int")), 1.0),
    (lambda: 0.95 * C.position_factor(L(1), L(1), L(2)), 0.76),
    (lambda: C.confidence(L(1.0), L(1.0), L(1.0), L(3), L(True), L("db_exact_match")), 0.97),
    (lambda: C.extraction_confidence(L(0.9), L(0.0), L(0.8), L(3), L(True)), 1.0),
    (lambda: C.source_multiplier(L(None).cast("string")), 0.8),
]


@pytest.mark.parametrize("i", range(len(NUMBERS)))
def test_numbers(spark, i):
    assert value(spark, NUMBERS[i][0]()) == pytest.approx(NUMBERS[i][1])


def test_tokens(spark):
    assert not value(spark, S.contains_either(L("hanoi"), L("thanh pho ha noi")))
    assert tuple(value(spark, S.ensemble_place(L("an thap muoi"), L("thap muoi")))) == (3, 9)
    for text, at, n, first, want in (("an thap muoi", 3, 9, 0, (1, 3)), ("dinhha noi", 4, 6, 4, (5, 6)), ("xa an thap muoi", 6, 9, 5, (7, 9)), ("ab", 0, 1, 0, (-1, -1))):
        assert tuple(value(spark, N.char_to_tokens(words(text), L(at), L(n), L(first)))) == want
    found = value(spark, N.explicit_patterns(words("quan 8 phuong 4 tp vung tau phuong thanh xuan xa huyen ban quan")))
    assert [tuple(x) for x in found.districts] == [("8", 1, 2), ("vung tau", 5, 7)] and [tuple(x) for x in found.wards] == [("4", 3, 4)]
    tokens = words("19 hoang dieu p dien bien ba dinh ha noi")
    assert value(spark, N.remaining(tokens, [(L(8), L(10)), (L(6), L(8)), (L(4), L(6))])) == "19 hoang dieu p"
    assert value(spark, N.segment_ids(L("12/3 ngo a, b - c"))) == [0, 0, 0, 0, 1, 2]
    assert value(spark, N.phrase_position(tokens, L("ba dinh"))) == 6
    assert sorted(value(spark, N.covered([(L(1), L(3)), (L(-1), L(-1)), (L(2), L(4))]))) == [1, 2, 3]
    assert value(spark, N.ngrams(N.indexed(F.array().cast("array<string>")))) == []
    assert len(value(spark, N.ngrams(N.indexed(words("a b c d"))))) == 2 + 3 + 4
    assert len(K.ACCENTED) == 134 and len(set(K.ACCENTED)) == 134
