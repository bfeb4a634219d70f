"""Abbreviations of several words, replaced by a join instead of one pattern for each.

A text's word sequences, as they stand in it, are looked up in the table of phrases; of what is found, the longest phrases come
first, and nothing is replaced that a longer one has taken. The work follows the texts' length and what is found, not the number of
phrases. What a replacement brings in is not searched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"(?U)\w+"


def _pieces(text: Column) -> Column:
    """What is before the first word, then each word and what follows it, as one array."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)
    pairs = F.flatten(F.transform(words, lambda w, i: F.array(w, F.element_at(gaps, i + 2))))
    return F.concat(F.array(F.element_at(gaps, 1)), pairs)


def _apart(found: Column) -> Column:
    """Of (size, key, at, n, word) in order, those that overlap none before them."""
    none = F.slice(found, 1, 0)
    return F.aggregate(found, none, lambda done, x: F.when(F.exists(done, lambda y: (x["at"] < y["at"] + y["n"]) & (y["at"] < x["at"] + x["n"])), done).otherwise(F.array_append(done, x)))


def replaced(df: DataFrame, phrases: DataFrame, text: str, context: str | None = None, out: str = "replaced") -> DataFrame:
    """Adds ``text`` with the ``phrases`` (context, key, word) in it replaced, whatever their case: those of the row's own context,
    before those of the null context, which hold everywhere.

    A phrase stands in a text where its words and what is between them do. Each distinct (context, text) is done once. Null texts stay
    null; phrases with a null or without a letter at either end are none; of several words for one phrase the least holds.
    """
    known = phrases.select("context", F.lower("key").alias("key__"), "word").where(F.col("key__").rlike(r"(?U)^\w.*\w$") & F.col("word").isNotNull())
    known = known.groupBy("context", "key__").agg(F.min("word").alias("word__"))
    longest = known.agg(F.max(F.size(F.regexp_extract_all("key__", F.lit(WORD), F.lit(0))))).first()[0] or 0
    own = F.lit(None).cast("string") if context is None else F.col(context)
    rows = df.select(own.alias("in__"), F.col(text).alias("text__")).where("text__ is not null").distinct()
    rows = rows.withColumn("pieces__", _pieces(F.col("text__")))
    count = (F.size("pieces__") - 1) / 2
    spans = rows.withColumn("n__", F.explode(F.sequence(F.lit(1), F.lit(longest)))) if longest else rows.where("false").withColumn("n__", F.lit(1))
    spans = spans.where(F.col("n__") <= count).withColumn("at__", F.explode(F.sequence(F.lit(0), (count - F.col("n__")).cast("int"))))
    spans = spans.select("in__", "text__", "n__", "at__", F.lower(F.array_join(F.slice("pieces__", F.col("at__") * 2 + 2, F.col("n__") * 2 - 1), "")).alias("key__"))
    every = spans.join(known.where("context is null").drop("context"), "key__").withColumn("rank__", F.lit(0))
    mine = spans.join(known.where("context is not null").withColumnRenamed("context", "in__"), ["in__", "key__"]).withColumn("rank__", F.lit(1))
    met = mine.unionByName(every).groupBy("in__", "text__", "n__", "at__", "key__").agg(F.max_by("word__", "rank__").alias("word__"))
    hit = F.struct((-F.length("key__")).alias("size"), F.col("key__").alias("key"), F.col("at__").alias("at"), F.col("n__").alias("n"), F.col("word__").alias("word"))
    hits = met.groupBy("in__", "text__").agg(F.array_sort(F.collect_list(hit)).alias("hits__")).withColumn("hits__", _apart(F.col("hits__")))
    hits = hits.withColumn("pieces__", _pieces(F.col("text__")))

    def shown(piece: Column, i: Column) -> Column:
        word = F.floor((i - 1) / 2)  # gaps belong to the word before them
        over = F.filter(F.col("hits__"), lambda x: (word >= x["at"]) & (word < x["at"] + x["n"]))
        first, last = F.get(over, F.lit(0))["at"], F.get(over, F.lit(0))["at"] + F.get(over, F.lit(0))["n"] - 1
        is_gap = i % 2 == 0
        return F.when((i == 0) | (F.size(over) == 0) | (is_gap & (word == last)), piece).when(~is_gap & (word == first), F.get(over, F.lit(0))["word"]).otherwise("")

    done = hits.select(F.col("in__").alias("own__"), F.col("text__").alias("old__"), F.array_join(F.transform("pieces__", shown), "").alias("new__"))
    back = df.join(done, own.eqNullSafe(F.col("own__")) & (F.col(text) == F.col("old__")), "left")
    return back.select(*df.columns, F.coalesce("new__", text).alias(out))
