import duckdb
import pytest

from placeweave import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(str(int(x)) if isinstance(x, float) and x == int(x) else str(x)[:19] if hasattr(x, "year") else str(x) for x in r) for r in plain.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    if name == "month_sequence":
        want["month"] = want["month"].dt.date
    assert rows(got, columns) == rows(want, columns)
