"""Geocoder answers as candidates; requests go through a pluggable lookup, limited over the whole job, each query once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeweave.functions import text as T
from placeweave.plans.stages import staged

NOMINATIM = "struct<lat:string,lon:string,display_name:string,importance:double,address:map<string,string>>"
DETAIL = "struct<status:string,result:struct<place_id:string,name:string,formatted_address:string,geometry:struct<location:struct<lat:double,lng:double>>,address_components:array<struct<long_name:string,short_name:string,types:array<string>>>>>"
PLACES = "struct<status:string,predictions:array<struct<description:string,place_id:string,compound:struct<province:string,district:string,commune:string>>>>"
# The answer's fields for each level, in order of preference.
FIELDS = {
    "province": ("city", "state", "province", "region"),
    "district": ("city_district", "county", "municipality", "town", "historic"),
    "ward": ("suburb", "neighbourhood", "quarter", "hamlet"),
}


def bounding_box(province: Column, boxes: dict[str, str], country: str) -> Column:
    """The province's box (west,north,east,south), else the country's."""
    table = F.create_map(*(F.lit(x) for pair in boxes.items() for x in pair)) if boxes else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, province), F.lit(country))


def enriched_query(address: Column, district: Column, province: Column) -> Column:
    """The address with district and province names that it does not hold yet."""
    more = [F.when((x != "") & ~F.contains(address, x), x) for x in (district, province)]
    return F.concat_ws(", ", address, *more)


def nominatim_candidates(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds p, d, w, at_rule, confidence, source of each answer; a ward without a district is also read as the district."""
    rows = df.withColumn("a", F.from_json(answer, NOMINATIM)).where("a.address is not null")
    for short, level in (("p", "province"), ("d", "district"), ("w", "ward")):
        found = F.coalesce(*(F.nullif(F.try_element_at(F.col("a.address"), F.lit(k)), F.lit("")) for k in FIELDS[level]))
        rows = rows.withColumn(short, T.normalize_hint(found))
    rows = rows.where("p is not null or d is not null or w is not null")
    rule = F.when(F.col("w").isNotNull(), 3).when(F.col("d").isNotNull(), 2).otherwise(1)
    base = 0.5 + 0.45 * F.coalesce("a.importance", F.lit(0.5))
    main = rows.select(*df.columns, "p", "d", "w", rule.alias("at_rule"), base.alias("confidence"), F.lit("osm_nominatim").alias("source"))
    other = rows.where("w is not null and d is null").select(*df.columns, "p", F.col("w").alias("d"), F.lit(None).cast("string").alias("w"), F.lit(2).alias("at_rule"), (base * 0.9).alias("confidence"), F.lit("osm_nominatim_alt").alias("source"))
    return main.unionByName(other)


def place_candidates(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds a row per prediction of an OK answer: p, d, w, at_rule, confidence by rank, place_id, place_rank."""
    rows = df.withColumn("a", F.from_json(answer, PLACES)).where("a.status = 'OK'").select(*df.columns, F.posexplode("a.predictions").alias("at", "x"))
    rows = rows.select(*df.columns, "at", *(T.normalize_hint(F.col(f"x.compound.{f}")).alias(c) for c, f in (("p", "province"), ("d", "district"), ("w", "commune"))), "x.place_id")
    rule = F.when(F.col("w").isNotNull(), 3).when(F.col("d").isNotNull(), 2).when(F.col("p").isNotNull(), 1).otherwise(0)
    return rows.withColumn("at_rule", rule).withColumn("confidence", F.round(0.95 - 0.05 * F.col("at"), 2)).withColumn("place_rank", F.col("at") + 1).drop("at")


def place_details(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Adds place_id, place_name, formatted_address, lat, lng and the components' long names by type (the first of each type) of
    each OK answer; other answers, and those that are no JSON, give no row."""
    rows = df.withColumn("a", F.from_json(answer, DETAIL)).where("a.status = 'OK' and a.result is not null")
    parts = F.coalesce("a.result.address_components", F.array().cast("array<struct<long_name:string,short_name:string,types:array<string>>>"))
    typed = F.flatten(F.transform(parts, lambda x: F.transform(F.coalesce(x["types"], F.array().cast("array<string>")), lambda t: F.struct(t.alias("type"), x["long_name"].alias("name")))))
    first = lambda kind: F.try_element_at(F.filter(typed, lambda x: x["type"] == kind), F.lit(1))["name"]
    levels = (("area_1", "administrative_area_level_1"), ("area_2", "administrative_area_level_2"), ("area_3", "administrative_area_level_3"))
    fields = [F.col(f"a.result.{c}") for c in ("place_id", "formatted_address")]
    point = [F.col(f"a.result.geometry.location.{c}") for c in ("lat", "lng")]
    return rows.select(*df.columns, *fields, F.col("a.result.name").alias("place_name"), *point, *(first(kind).alias(c) for c, kind in levels))


def enhanced(df: DataFrame, lookup: Callable[[str], str | None], address: str = "address", district: str = "district", province: str = "province", per_second: float = 1.0) -> DataFrame:
    """The best place that ``lookup`` finds for each address with its candidate's district and province; none, no row."""
    asked = df.withColumn("query", enriched_query(F.col(address), F.coalesce(district, F.lit("")), F.coalesce(province, F.lit(""))))
    return place_candidates(enrich(asked, "query", lookup, per_second)).where("place_rank = 1")


def enrich(df: DataFrame, query: str, lookup: Callable[[str], str | None], per_second: float = 1.0, cache: str | None = None, tasks: int = 1, attempts: int = 3, with_errors: bool = False) -> DataFrame:
    """Adds ``answer``: what ``lookup`` returns for each query (null where it has none, or fails); ``with_errors`` adds
    ``answer_error``: why it failed.

    Each distinct query is asked once, by ``tasks`` tasks that share the ``per_second`` calls of the whole job; a failing call is tried
    ``attempts`` times, each time after a pause twice as long. Answers are written before they are joined, so no retry of a later task
    asks again; with ``cache``, a folder, they are kept there, and a query that has an answer there (or is known to have none) is not
    asked in later jobs either. Null queries are not asked.
    """
    asked = df.select(F.col(query).alias("query__")).where("query__ is not null").distinct()
    spark, kept = df.sparkSession, None
    if cache and _exists(spark, cache):
        kept = spark.read.schema(CACHED).parquet(cache).where("error is null").select("query", "answer", "error")
        asked = asked.join(kept.select(F.col("query").alias("query__")), "query__", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pause, last = tasks / per_second, float("-inf")
        for batch in batches:
            rows = []
            for q in batch["query__"]:
                for attempt in range(attempts):
                    wait = pause * (2**attempt if attempt else 1)
                    time.sleep(max(0.0, last + wait - time.monotonic()))
                    last = time.monotonic()
                    try:
                        answer, error = lookup(q), None
                        break
                    except Exception as e:  # noqa: BLE001  (one bad answer fails no batch)
                        answer, error = None, f"{type(e).__name__}: {e}"
                rows.append((q, answer, error, attempt + 1))
            yield pd.DataFrame(rows, columns=["query", "answer", "error", "calls"])

    fresh = staged(asked.repartition(tasks).mapInPandas(run, CACHED), "answers")
    if cache:
        fresh.write.mode("append").parquet(cache)
    fresh = fresh.select("query", "answer", "error")
    every = fresh if kept is None else fresh.union(kept.join(df.select(F.col(query).alias("query")).distinct(), "query", "left_semi"))
    every = every.groupBy("query").agg(F.min(F.struct(F.col("error").isNotNull().alias("bad"), "answer", "error")).alias("found"))
    found = every.select(F.col("query").alias("asked__"), F.col("found.answer").alias("answer"), F.col("found.error").alias("answer_error"))
    return df.join(found, F.col(query) == F.col("asked__"), "left").select(*df.columns, "answer", *(["answer_error"] if with_errors else []))


CACHED = "query string, answer string, error string, calls int"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
