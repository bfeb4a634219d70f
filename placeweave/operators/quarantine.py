"""Bad rows beside good ones: what is wrong with a row is said in it, and the batch goes on without it.

``typed`` casts raw columns, ``checked`` applies conditions, ``unique`` looks for keys that are there twice; each adds what it finds to
the column ``errors``. ``split`` parts the rows, and ``guarded`` runs a job over the good ones and gives a row out for each row in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ERRORS = "errors"


def _with(df: DataFrame, *found: Column) -> DataFrame:
    """``errors`` with those of ``found`` that are not null."""
    old = F.col(ERRORS) if ERRORS in df.columns else F.array().cast("array<string>")
    return df.withColumn(ERRORS, F.concat(old, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")))


def lines_csv(spark: SparkSession, path: str, schema: str, **options: object) -> DataFrame:
    """CSV by a schema; a line that does not fit it keeps what could be read, and is in ``raw_line`` with its error."""
    rows = spark.read.options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="raw_line", **options).schema(f"{schema}, raw_line string").csv(path)
    return _with(rows, F.when(F.col("raw_line").isNotNull(), F.lit("malformed line")))


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to these types; where a value is no such thing, it becomes null and the error has it."""
    cast = {c: F.col(c).try_cast(kind) for c, kind in kinds.items()}
    found = [F.when(F.col(c).isNotNull() & cast[c].isNull(), F.concat(F.lit(f"{c}: no {kind}: "), F.col(c).cast("string"))) for c, kind in kinds.items()]
    return _with(df, *found).withColumns(cast)


def checked(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Conditions by name; a row that does not meet one (or where it is null) has its name as an error."""
    return _with(df, *(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))


def unique(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is null, or that share it with others, have an error; all of these, as none is the right one."""
    twice = df.groupBy(F.col(key).alias("twice__")).agg(F.count("*").alias("n__")).where("twice__ is not null and n__ > 1")
    rows = df.join(twice, F.col(key) == F.col("twice__"), "left")
    rows = _with(rows, F.when(F.col(key).isNull(), F.lit(f"{key} is null")), F.when(F.col("n__").isNotNull(), F.concat(F.lit(f"{key} is there "), F.col("n__").cast("string"), F.lit(" times"))))
    return rows.drop("twice__", "n__")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without errors, without that column; and those with errors."""
    return df.where(F.size(ERRORS) == 0).drop(ERRORS), df.where(F.size(ERRORS) > 0)


def guarded(df: DataFrame, run: Callable[[DataFrame], DataFrame], keep: dict[str, Column]) -> DataFrame:
    """The rows that ``run`` makes of the good ones, and one for each bad one: what to ``keep`` of it under the result's names, the status
    ``error`` and what is wrong with it."""
    good, bad = split(df)
    errors = bad.select(*(c.alias(name) for name, c in keep.items()), F.lit("error").alias("status"), F.concat_ws("; ", ERRORS).alias("error"))
    return run(good).unionByName(errors, allowMissingColumns=True)
