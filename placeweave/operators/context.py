"""Normalisation in two passes: what the first finds of province and district says which abbreviations hold in the second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import text as T
from placeweave.operators.phrases import replaced
from placeweave.plans.stages import small

ADDED = ("normalized", "province_context", "district_context", "iterations")


def _single_words(text: Column, own: str, every: str) -> Column:
    """Abbreviations of one word; those of the context before global ones."""
    entry = lambda side, t: F.try_element_at(F.col(side), T.clean_token(t))
    return F.array_join(F.transform(F.split(T.collapse(text), " "), lambda t: F.coalesce(entry(own, t), entry(every, t), t)), " ")


def expanded(df: DataFrame, abbreviations: DataFrame, text: str, province: str, out: str = "expanded") -> DataFrame:
    """Adds ``text`` (in lower case, level words spelled out) with the abbreviations that hold in the province, or everywhere.

    Those of several words are looked up by a join (``phrases.replaced``), whatever their number, and before those of one word. These
    are maps, one a province, broadcast if all their entries were counted to be few, and joined otherwise.
    """
    several = F.contains("key", F.lit(" "))
    words = _in_force(abbreviations)
    phrases = words.where(several).select("context", "key", "word")
    maps = words.where(~several).groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("key", "word"))).alias("words"))
    own = maps.where("context is not null").select(F.col("context").alias("context__"), F.col("words").alias("own__"))
    every = maps.where("context is null").select(F.col("words").alias("every__"), F.lit(True).alias("all__"))  # one row at most
    rows = replaced(df, phrases, text, province, "phrased__")
    rows = rows.join(small(own, of=words), F.col(province) == F.col("context__"), "left").withColumn("any__", F.lit(True))
    rows = rows.join(small(every, of=words), F.col("any__") == F.col("all__"), "left")
    return rows.select(*df.columns, _single_words(F.col("phrased__"), "own__", "every__").alias(out))


def _in_force(abbreviations: DataFrame) -> DataFrame:
    """(context, key, word) of each province, and of the null context those with one meaning; those of a district are left out."""
    a = abbreviations.where("district_context is null and key is not null and word is not null")
    words = a.groupBy(F.col("province_context").alias("context"), "key").agg(F.min("word").alias("word"), F.countDistinct("word").alias("n"))
    return words.where("context is not null or n = 1").select("context", "key", "word")


def hints(df: DataFrame, abbreviations: DataFrame, province: str | None = None, district: str | None = None) -> DataFrame:
    """The hint columns in lower case with abbreviations spelled out: a province's by those that hold everywhere, a district's by those
    of the province that the first hint names as well. Nulls stay null."""
    rows = df.withColumn("in__", F.lit(None).cast("string"))
    for hint in filter(None, (province, district)):
        rows = rows.withColumn("hint__", F.lower(T.nfc(F.col(hint))))
        rows = expanded(rows, abbreviations, "hint__", "in__", "out__")
        rows = rows.select(*(F.col("out__").alias(c) if c == hint else c for c in df.columns), "in__")
        if hint == province:
            rows = rows.withColumn("in__", T.normalize_hint(F.col(hint)))
    return rows.select(*df.columns)


def iterative(df: DataFrame, abbreviations: DataFrame, address: str = "address", province_hint: str | None = None, district_hint: str | None = None) -> DataFrame:
    """Adds normalized, the province and district context it was made in, and the number of passes (1 or 2).

    The first pass has the hints as its context. If a few patterns find another province, or with one another district, in its result,
    these are the second pass's context. Null and empty texts give empty ones in one pass. Columns named as results are replaced.
    """
    hint = lambda c: T.normalize_hint(F.col(c)) if c else F.lit(None).cast("string")
    kept = [c for c in df.columns if c not in ADDED]
    plain = T.expand_structural(T.nfc(F.coalesce(F.col(address), F.lit(""))))
    rows = df.select(*kept, plain.alias("plain__"), hint(province_hint).alias("p1__"), hint(district_hint).alias("d1__"))
    final = lambda c: T.finalize(T.fold_accents(F.col(c)))
    rows = expanded(rows, abbreviations, "plain__", "p1__", "first__").withColumn("first__", final("first__"))
    province, district = T.quick_context(F.col("first__"))
    rows = rows.withColumns({"p2__": F.coalesce(province, "p1__"), "d2__": F.coalesce(district, "d1__")})
    rows = rows.withColumn("again__", ~F.col("p2__").eqNullSafe(F.col("p1__")) | ~F.col("d2__").eqNullSafe(F.col("d1__")))
    rows = rows.withColumn("in__", F.when(F.col("again__"), F.col("p2__")))
    rows = expanded(rows, abbreviations, "plain__", "in__", "second__")
    last = F.when(F.col("again__"), final("second__")).otherwise(F.col("first__"))
    return rows.select(*kept, last.alias("normalized"), F.col("p2__").alias("province_context"), F.col("d2__").alias("district_context"), F.when(F.col("again__"), 2).otherwise(1).alias("iterations"))
