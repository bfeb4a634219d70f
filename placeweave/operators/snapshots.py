"""Monthly snapshots of the gazetteer: reading, merging, flattening trees, month sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TREE = "province string, districts array<struct<district:string,ward:array<string>,street:array<string>>>"


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The first days of all months from start to end."""
    return spark.sql("select explode(sequence(trunc(to_date(:a), 'MM'), trunc(to_date(:b), 'MM'), interval 1 month)) as month", {"a": start, "b": end})


def merge_latest(df: DataFrame, key: list[str], date: str = "effective_date", tie: list[str] | None = None) -> DataFrame:
    """Of each key, the row of the latest date."""
    order = [F.desc(date), *(F.desc(c) for c in tie or [])]
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rn = 1").drop("rn")


def flatten_tree(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(province, district, ward) and (province, district, street) rows of a nested tree."""
    rows = tree.select("province", F.explode("districts").alias("x")).select("province", "x.*")
    return tuple(rows.select("province", "district", F.explode(c).alias(c)) for c in ("ward", "street"))


def tree_counts(tree: DataFrame) -> DataFrame:
    """Provinces, districts, wards and streets, counted without flattening."""
    each = lambda c: F.aggregate("districts", F.lit(0), lambda n, d: n + F.greatest(F.size(d[c]), F.lit(0)))
    return tree.agg(F.count("*").alias("provinces"), F.sum(F.size("districts")).alias("districts"), F.sum(each("ward")).alias("wards"), F.sum(each("street")).alias("streets"))
