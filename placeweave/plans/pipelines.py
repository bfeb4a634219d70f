"""End-to-end jobs: a CSV of addresses, a Parquet table of addresses in parts, one address; and their statistics."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.operators import quarantine
from placeweave.operators.context import iterative
from placeweave.operators.gazetteer import Gazetteer
from placeweave.operators.matching import street_lookup
from placeweave.operators.resolve import resolve
from placeweave.operators.review import ratio
from placeweave.plans.stages import staged
from placeweave.sources import readers, writers


class AddressPipeline:
    """Resolves addresses against one gazetteer.

    ``process`` counts what it returned; a batch's rows are counted when its caller says so (``count``), as its frame is lazy."""

    def __init__(self, gazetteer: Gazetteer, strict_compat: bool = False):
        self.gazetteer, self.strict_compat = gazetteer, strict_compat
        self.reset_stats()

    def reset_stats(self) -> None:
        self._total = self._success = 0

    def get_stats(self) -> dict[str, float]:
        rate = self._success / self._total if self._total else 0.0
        return {"total_processed": self._total, "successful": self._success, "failed": self._total - self._success, "success_rate": rate}

    def count(self, results: DataFrame) -> DataFrame:
        """Adds the rows of a batch's results to the statistics; returns them."""
        found = status_counts(results).first()
        self._total, self._success = self._total + found["total"], self._success + found["success"]
        return results

    def preprocess(self, df: DataFrame, address: str = "address", province_hint: str | None = None, district_hint: str | None = None) -> DataFrame:
        """Adds the normalised address, made in up to two passes, and its context."""
        return iterative(df, self.gazetteer.abbreviations, address, province_hint, district_hint)

    def process(self, raw: str | None, province_known: str | None = None, district_known: str | None = None) -> dict:
        """One address. What goes wrong becomes the status ``error`` with its message, as in a batch one row must not fail the others."""
        spark = self.gazetteer.divisions.sparkSession
        try:
            df = spark.createDataFrame([(0, raw, province_known, district_known)], "row_id long, address string, hp string, hd string")
            out = resolve(df, self.gazetteer, province_hint="hp", district_hint="hd", strict_compat=self.strict_compat).first().asDict(True)
        except Exception as e:  # noqa: BLE001
            out = {"row_id": 0, "raw_input": raw, "status": "error", "error": f"{type(e).__name__}: {e}", "quality_flag": "failed"}
        self._total, self._success = self._total + 1, self._success + (out["status"] == "success")
        return out

    def process_batch(self, df: DataFrame, **columns: str) -> DataFrame:
        """A row out for each row in. Rows without an id, with one that others have too, or with ``errors`` from an earlier check are not
        resolved: their status is ``error``, as that of one address that fails."""
        key, address = columns.get("row_id", "row_id"), columns.get("address", "address")
        keep = {"row_id": F.col(key), "raw_input": F.col(address), "quality_flag": F.lit("failed")}
        return quarantine.guarded(quarantine.unique(df, key), lambda good: resolve(good, self.gazetteer, strict_compat=self.strict_compat, **columns), keep)


def status_counts(results: DataFrame) -> DataFrame:
    ok = F.count_if(F.col("status") == "success")
    return results.agg(F.count("*").alias("total"), ok.alias("success"), F.count_if(F.col("status") != "success").alias("failed"), ratio(ok, F.count("*")).alias("success_rate"))


def quality_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("quality_flag").agg(F.count("*").alias("n"))


def run_csv(spark: SparkSession, gazetteer: Gazetteer, source: str, target: str) -> DataFrame:
    """CSV in, CSV files by quality out; returns the results."""
    results = resolve(readers.addresses_csv(spark, source), gazetteer)
    writers.write_results_csv(results, target)
    return results


def run_parquet(spark: SparkSession, gazetteer: Gazetteer, source: str, target: str, parts: list[str], limit: int | None = None) -> None:
    """Parquet in, the same rows with the parsed levels and street out."""
    # Written once: numbers that are made again after a lost task could differ.
    rows = staged(readers.addresses_parquet(spark, source, parts, limit).withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    found = resolve(rows, gazetteer, address="raw_address")
    named = found.select("row_id", *(F.nullif(F.lower(c), F.lit("")).alias(k) for c, k in (("province", "p"), ("district", "d"), ("ward", "w"))), F.lower("remaining_1").alias("text"))
    street = street_lookup(named.where("p is not null"), gazetteer.streets).select("row_id", "street")
    parsed = named.join(street, "row_id", "left").select("row_id", *(F.col(c).alias(f"parsed_{n}") for c, n in (("p", "province"), ("d", "district"), ("w", "ward"), ("street", "street"))))
    out = rows.join(parsed, "row_id", "left").select(*parts, "raw_address", "parsed_province", "parsed_district", "parsed_ward", "parsed_street")
    writers.write_parquet(out, target, out.columns)


def main(argv: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(description="Resolve a CSV of addresses, or one address.")
    cli.add_argument("-g", "--gazetteer", required=True, help="Parquet of ward-level divisions")
    cli.add_argument("-a", "--address")
    cli.add_argument("-i", "--input")
    cli.add_argument("-o", "--output")
    cli.add_argument("--json", action="store_true")
    cli.add_argument("--parts", help="columns of an address in a Parquet input, joined by commas")
    cli.add_argument("--limit", type=int, help="rows of a Parquet input")
    cli.add_argument("--workers", type=int, help="shuffle partitions")
    args = cli.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.workers:
        spark.conf.set("spark.sql.shuffle.partitions", args.workers)
    gaz = Gazetteer.of(spark.read.parquet(args.gazetteer))
    if args.parts:
        run_parquet(spark, gaz, args.input, args.output, args.parts.split(","), args.limit)
    elif args.address:
        df = spark.createDataFrame([(0, args.address)], "row_id long, address string")
        out = resolve(df, gaz)
        print(writers.as_json(out).first()[0] if args.json else out.first())
    else:
        quality_counts(run_csv(spark, gaz, args.input, args.output)).show()


if __name__ == "__main__":
    main()
