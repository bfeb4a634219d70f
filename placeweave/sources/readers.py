"""Sources: address files, gazetteer snapshots, trees, databases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.operators.snapshots import TREE

PARTS = ("COT1", "COT2", "COT3")


def addresses_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, with or without a byte-order mark: row_id and address, from the three parts or the first column."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    parts = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in PARTS if c in df.columns]
    address = F.concat_ws(" ", *parts) if parts else F.col(f"`{df.columns[0]}`")
    return df.select(F.monotonically_increasing_id().alias("row_id"), address.alias("address"))


def addresses_parquet(spark: SparkSession, path: str, parts: list[str], limit: int | None = None) -> DataFrame:
    """Parquet with an address in parts, joined by commas."""
    df = spark.read.parquet(path)
    df = df if limit is None else df.limit(limit)
    return df.withColumn("raw_address", F.concat_ws(", ", *(F.nullif(F.trim(F.col(c)), F.lit("")) for c in parts)))


def snapshots_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """All snapshot files of a glob; columns by name."""
    return spark.read.option("header", True).option("enforceSchema", False).csv(pattern)


def snapshots_of(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """The snapshot files of several globs whose headers may differ: columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (snapshots_csv(spark, p) for p in patterns))


def tree_json(spark: SparkSession, path: str) -> DataFrame:
    """The gazetteer tree, a JSON object per line or file."""
    return spark.read.schema(TREE).option("multiLine", True).json(path)


def table_jdbc(spark: SparkSession, url: str, query: str, options: dict[str, str] | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **(options or {})).load()


def select(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    """Rows of a parameterised query."""
    return spark.sql(sql, args=args)


def first_row(spark: SparkSession, sql: str, **args: object) -> dict | None:
    """The first row of a parameterised query as a dict; None without one."""
    found = select(spark, sql, **args).limit(1).collect()
    return found[0].asDict(True) if found else None


def links_and_cells(df: DataFrame, html: str = "html") -> DataFrame:
    """Raw pages: title, number of links and of table cells, and the text without tags."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return df.select(*df.columns, F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all(html, F.lit(r"(?i)<a\s"), F.lit(0))).alias("links"), F.size(F.regexp_extract_all(html, F.lit(r"(?i)<td[\s>]"), F.lit(0))).alias("cells"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("plain"))
