"""Combinations of candidates against a plain version that loops over all of them."""

import itertools
import random

import pytest

from placeweave import constants as K
from placeweave.operators import combine
from placeweave.operators import gazetteer as G

DIVISIONS = [("ha noi", "ba dinh", "dien bien"), ("ha noi", "tay ho", "dien bien"), ("ha noi", "ba dinh", "cong vi"), ("ha noi", "tay ho", "xuan la"), ("ha tinh", "duc tho", "yen ho"), ("ha nam", "phu ly", "le hong phong")]
WORDS = "so 12 ngo ha noi tinh nam ba dinh tay ho duc tho phu ly dien bien cong vi xuan la yen ho ubnd truong".split()


def cases():
    rng = random.Random(5)
    for i in range(40):
        text = [rng.choice(WORDS) for _ in range(rng.randrange(0, 9))]
        options = []
        for at, level in enumerate("pdw"):
            names = sorted({x[at] for x in DIVISIONS})
            for name in rng.sample(names, rng.randrange(0, min(4, len(names)) + 1)):
                s = rng.randrange(-1, 6)
                options.append((level, name, rng.choice([0.8, 0.85, 0.9, 0.9, 1.0]), s, s + rng.randrange(1, 4) if s >= 0 else -1))
        yield i, " ".join(text), text, options


def lists(options):
    found = {}
    for level, most in combine.MOST.items():
        own = sorted((o for o in options if o[0] == level), key=lambda o: (-o[2], -o[4], o[1]))
        sure = bool(own) and own[0][2] == 1.0
        found[level] = ([o[1:] for o in own[: 1 if sure and level != "w" else most]], sure)
    provinces, wards = found["p"][0], found["w"][0]
    districts, sure = found["d"]
    more = []
    for w, *_ in wards if provinces and not sure else []:
        homes = [d for p, d, x in DIVISIONS if p == provinces[0][0] and x == w]
        if homes and homes[0] not in [d[0] for d in districts + more]:
            more.append((homes[0], 1.0, -1, -1))
    none = (None, 0.0, -1, -1)
    return provinces or [none], (districts or [none]) + more, [*wards, none]


def gap(n):
    return next((score for most, score in K.GAP_SCORES if n <= most), K.FAR_SCORE)


def claim(name, s, e):
    if name is None or s < 0 or e - s == len(name.split()):
        return 1.0
    a, b = e - s, len(name.split())
    return 0.5 + 0.3 * min(a, b) / max(a, b)


def coverage(tokens, ward, rest):
    w, other = (ward or "").split(), rest.split()
    useful = [t for t in tokens if t not in K.COVERAGE_NOISE_WORDS]
    ratio = sum(t in w or t in other for t in useful) / len(useful) if useful else 0.0
    at = [i for i, t in enumerate(tokens) if t in w or t in other]
    runs = sum(i - 1 not in at for i in at)
    weighted = sum(2 if t in w else 1 if t in other else 0 for t in tokens) / (2 * len(tokens))
    score = min(1.0, max(0.0, 0.4 * ratio + 0.3 * (1 / runs if runs else 0.0) + 0.3 * weighted))
    return next((value for least, value in K.COVERAGE_STEPS if score >= least), K.COVERAGE_STEPS[-1][1])


def plain(text, tokens, options):
    out = []
    for (p, ps, p0, p1), (d, ds, d0, d1), (w, ws, w0, w1) in itertools.product(*lists(options)):
        positive = [x for x in (ps, ds, ws) if x > 0]
        base = sum(positive) / len(positive) if positive else 0.0
        exists = any(x[0] == p and (d is None or x[1] == d) and (w is None or x[2] == w) for x in DIVISIONS) and not (w and not d)
        valid = p is None or (d is None and w is None) or exists
        if not (p or d) or (not valid and p and d and w):
            continue
        pairs = ([gap(abs(d0 - w1))] if w0 >= 0 and d0 >= 0 else []) + ([gap(abs(p0 - d1))] if d0 >= 0 and p0 >= 0 else []) + ([gap(abs(p0 - w1))] if w0 >= 0 and p0 >= 0 and d0 < 0 else [])
        near = sum(pairs) / len(pairs) if pairs else 0.5
        places = [x for x in (w0, d0, p0) if x >= 0]
        score = 0.3 * near + 0.5 * base + 0.2 * valid
        score *= (1.1 if len(places) > 1 and places == sorted(places) else 1.0) * (1.15 if w0 >= 0 and d0 >= 0 and w1 == d0 else 1.0) * (1.0 if valid else 0.5) * claim(w, w0, w1) * claim(d, d0, d1) * base**2
        score *= 1.1 if valid and p and d and w and len({x[1] for x in DIVISIONS if x[0] == p and x[2] == w}) > 1 else 1.0
        score *= (1.15 if d and d in text else 1.0) * (1.1 if w and w in text else 1.0)
        spans = [(s, e) for s, e in ((p0, p1), (d0, d1), (w0, w1))]
        score *= coverage(tokens, w, " ".join(t for i, t in enumerate(tokens) if not any(s <= i < e for s, e in spans))) if tokens else 1.0
        out.append((score, 3 if w else 2 if d else 1, p, d, w))
    last = lambda x: (x is None, x or "")
    return sorted(out, key=lambda r: (-round(r[0], 9), -r[1], last(r[2]), last(r[3]), last(r[4])))[: combine.BEST]


@pytest.fixture(scope="module")
def divisions(spark):
    return spark.createDataFrame([(i, p, d, w, p.upper(), d.upper(), w.upper(), "S", "C") for i, (p, d, w) in enumerate(DIVISIONS)], G.DIVISIONS)


def test_equals_plain_combinations(spark, divisions):
    every = list(cases())
    rows = spark.createDataFrame([(i, text, tokens) for i, text, tokens, _ in every], "row_id long, raw string, tokens array<string>")
    options = spark.createDataFrame([(i, *o) for i, _, _, os in every for o in os], "row_id long, level string, name string, score double, s int, e int")
    got = {}
    for r in combine.combinations(rows, options, divisions).orderBy("row_id", "place").collect():
        got.setdefault(r.row_id, []).append((r.score, r.match_level, r.p, r.d, r.w))
    assert sum(map(len, got.values())) > 100
    for i, text, tokens, os in every:
        want, found = plain(text, tokens, os), got.get(i, [])
        assert [x[0] for x in found] == pytest.approx([x[0] for x in want], abs=1e-9), i
        clear = lambda rows, least: {x[1:] for x in rows if x[0] > least + 1e-7}  # noqa: E731  (what ties with the last may differ)
        assert not want or clear(found, want[-1][0]) == clear(want, want[-1][0]), i


def test_empty_and_nulls(spark, divisions):
    rows = spark.createDataFrame([(1, None, []), (2, "x", ["x"])], "row_id long, raw string, tokens array<string>")
    none = spark.createDataFrame([(1, "p", None, 0.9, 0, 1), (2, "d", "ba dinh", None, 0, 1)], "row_id long, level string, name string, score double, s int, e int")
    assert combine.combinations(rows, none, divisions).count() == 0
    assert combine.combinations(rows.limit(0), none.limit(0), divisions).count() == 0


def test_streets(spark):
    rows = spark.createDataFrame([(1, "giai phong tay ho ha noi")], "row_id long, norm string")
    options = spark.createDataFrame([(1, "p", "ha noi", 1.0, 4, 6), (1, "s", "22", 1.0, -1, -1), (1, "s", "giai phong", 0.9, 0, 2), (1, "s", "khong", 0.9, 0, 1)], "row_id long, level string, name string, score double, s int, e int")
    streets = spark.createDataFrame([(1, "ha noi", "tay ho", "giai phong"), (2, "ha noi", "ba dinh", "giai phong"), (3, "ha tinh", "duc tho", "giai phong"), (4, "ha noi", None, "22")], G.STREETS)
    got = {(r.d, r.street): round(r.score, 6) for r in combine.by_street(rows, options, streets).collect()}
    assert got == {("tay ho", "giai phong"): 0.7125, ("ba dinh", "giai phong"): 0.21375}
