"""Sinks: results as CSV by quality, Parquet, snapshots, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.plans.stages import staged

RESULT_COLUMNS = (
    "raw_input", "province", "district", "ward", "state_code", "county_code", "remaining_1", "remaining_2", "remaining_3",
    "at_rule", "confidence", "quality_flag", "total_time_ms", "new_province", "new_ward", "migration_note",
)


#: The folders of ``write_result_files`` by quality; every other flag goes to the last.
FOLDERS = (("full_address", "full"), ("partial_address", "partial"), ("province_only", "province"), ("failed", "failed"))


def exploded(results: DataFrame) -> DataFrame:
    """A row per new address; one with empty strings where there is none. Rows are not timed one by one: total_time_ms is 0
    unless ``results`` has such a column."""
    results = results if "total_time_ms" in results.columns else results.withColumn("total_time_ms", F.lit(0.0))
    rows = results.withColumn("x", F.explode_outer("new_addresses"))
    rows = rows.withColumns({c: F.coalesce(f"x.{f}", F.lit("")) for c, f in (("new_province", "new_province"), ("new_ward", "new_ward"), ("migration_note", "note"))})
    return rows.select(*RESULT_COLUMNS)


def write_results_csv(results: DataFrame, path: str) -> None:
    exploded(results).write.mode("overwrite").partitionBy("quality_flag").option("header", True).option("encoding", "UTF-8").csv(path)


def write_result_files(results: DataFrame, path: str) -> None:
    """CSV files under full, partial, province and failed: all columns with the flag, and a byte-order mark before the header.

    A folder without rows has a header only. ``results`` is computed once, into a stage table."""
    rows = staged(exploded(results), "results")
    flag, known = F.coalesce("quality_flag", F.lit("failed")), [f for f, _ in FOLDERS[:-1]]
    for name, folder in FOLDERS:
        part = rows.where(flag == name if name in known else ~flag.isin(known))
        part = part.withColumnRenamed(RESULT_COLUMNS[0], "\ufeff" + RESULT_COLUMNS[0])
        part.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("emptyValue", "").csv(f"{path}/{folder}")


def write_parquet(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").parquet(path)


def snapshot(df: DataFrame, date: str) -> DataFrame:
    """The date first, then all columns by name."""
    return df.select(F.lit(date).alias("effective_date"), *sorted(c for c in df.columns if c != "effective_date"))


def write_merged_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
