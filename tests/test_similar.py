import random

import pytest
from pyspark.sql import functions as F

from placeweave import constants as K
from placeweave.functions import similarity as S
from placeweave.operators import matching, similar


def pairs(spark, queries, names, threshold, bonus):
    """Of the pairs that the join finds and of all pairs: those that reach the threshold, with their scores."""
    q, n = spark.createDataFrame(queries, "scope string, q string"), spark.createDataFrame(names, "scope string, n string")
    context = bonus == K.SUBSTRING_BONUS_CONTEXT
    score = S.ensemble(F.col("q"), F.col("n"), context).alias("score")
    found = similar.similar(q, n, ("scope",), "q", "n", threshold, bonus)
    assert found.count() == found.distinct().count()
    whole = q.distinct().join(n.distinct(), "scope")
    return [sorted(map(tuple, df.select("scope", "q", "n", score).where(F.col("score") >= threshold).collect())) for df in (found, whole)]


@pytest.mark.parametrize("threshold,bonus", [(0.9, 0.25), (0.9 / 1.1, 0.25), (0.7, 0.25), (0.9, 0.5), (0.55, 0.25)])
def test_finds_all_pairs(spark, threshold, bonus):
    rnd = random.Random(int(threshold * 100))
    word = lambda: "".join(rnd.choice("abc ") for _ in range(rnd.choice([1, 2, 3, 5, 8, 12, 17, 25]))).strip()
    names = [(rnd.choice("xy"), word()) for _ in range(150)] + [("x", None), ("x", ""), (None, "abc"), ("y", "ab ba é")]

    def edited(text):
        text = list(text or "a")
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(text) + 1)
            text[at : at + rnd.randrange(2)] = rnd.choice(["", "a", "bc", "d"])
        return (rnd.choice(["", "b", "cab "]) + "".join(text)).strip()

    queries = [(s, edited(n)) for s, n in names for _ in range(3)] + [("x", None), ("x", ""), (None, "abc")]
    found, whole = pairs(spark, queries, names, threshold, bonus)
    assert found == whole and len(whole) > 50


def test_common_segments(spark, monkeypatch):
    """Names that share long beginnings are cut again, and none is lost."""
    names = [("x", f"supplier {i:09d}") for i in range(0, 900, 3)]
    queries = [("x", f"supplier {i:09d}") for i in range(1, 900, 17)] + [("x", f"supplyer {i:09d}") for i in range(0, 900, 50)]
    monkeypatch.setattr(similar, "COMMON", 20)
    met = []
    near = similar._near
    monkeypatch.setattr(similar, "_near", lambda *a: met.append(near(*a)) or met[-1])
    found, whole = pairs(spark, queries, names, 0.9, 0.25)
    assert found == whole and len(whole) > 50
    assert met[0].distinct().count() < len(queries) * len(names) / 3
    far = [("x", f"the long common beginning of all of these names {i:03d} {i * i % 1000:03d}") for i in range(60)]
    found, whole = pairs(spark, [(s, n[:10] + n[11:]) for s, n in far[:9]], far, 0.9, 0.25)
    assert found == whole and len(whole) > 50


def test_no_name_or_text(spark):
    one, none = [("x", "abcdef")], [("x", None)]
    for q, n in ((one, none), (none, one), ([], one), (one, [])):
        assert pairs(spark, q, n, 0.9, 0.25) == [[], []]
    with pytest.raises(ValueError):
        pairs(spark, one, one, 0.5, 0.25)


def test_best_matches_in_one_scope(spark):
    names = spark.createDataFrame([("ha noi",), ("ha nam",), ("da nang",), ("ho chi minh",)], "name string")
    grams = spark.createDataFrame([("ha noi",), ("tp ho chi minh",), ("ho chi minhh",), ("zzz",)], "ngram string")
    got = {r.ngram: (r.match, round(r.score, 4), r.exact) for r in matching.best_matches(grams, names, ()).collect()}
    assert got == {"ha noi": ("ha noi", 1.0, True), "tp ho chi minh": ("ho chi minh", 1.0, False), "ho chi minhh": ("ho chi minh", 1.0, False)}


def test_street_lookup_null_districts(spark):
    streets = spark.createDataFrame([(1, "ha noi", "ba dinh", "doi can"), (2, "ha noi", "ba dinh", "kim ma thuong"), (3, "ha noi", None, "giang vo"), (4, None, "ba dinh", "no province")], "id int, p string, d string, street string")
    rows = spark.createDataFrame([(1, "ha noi", "ba dinh", "doi can"), (2, "ha noi", None, "kim ma thuongg"), (3, "ha noi", "ba dinh", "giang vo"), (4, "ha noi", None, "giang voo"), (5, None, "ba dinh", "no province"), (6, "ha noi", "ba dinh", None), (7, "ha noi", "ba dinh", " KIM MA THUONG")], "row_id int, p string, d string, text string")
    got = {r.row_id: r.street for r in matching.street_lookup(rows, streets).collect()}
    assert got == {1: "doi can", 2: "kim ma thuong", 3: None, 4: "giang vo", 5: None, 6: None, 7: "kim ma thuong"}
