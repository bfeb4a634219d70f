"""Joins of n-grams with names: exact first, then fuzzy within a scope, ties kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave import constants as K
from placeweave.functions import similarity as S
from placeweave.operators.gazetteer import postings
from placeweave.operators.similar import similar
from placeweave.plans.stages import staged


def token_overlap(queries: DataFrame, names: DataFrame, query: str, name: str, least: int = 1, scope: tuple[str, ...] = ()) -> DataFrame:
    """(query row, name row, shared): pairs sharing ``least`` tokens or more; repeated query tokens count each time."""
    q = queries.withColumn("token", F.explode(F.split(query, " "))).where("token <> ''")
    keys = [c for c in queries.columns] + [c for c in names.columns if c not in scope]
    hits = q.join(postings(names, name), ["token", *scope]).groupBy(*dict.fromkeys(keys)).agg(F.count("*").alias("shared"))
    return hits.where(F.col("shared") >= least)


def best_matches(queries: DataFrame, names: DataFrame, scope: tuple[str, ...], ngram: str = "ngram", name: str = "name", threshold: float = 0.9, context: bool = False, extra: Column | None = None) -> DataFrame:
    """The best names for each distinct (scope, ngram): equal ones score 1; where there is none, the most similar at or above the
    threshold, ties kept. ``extra`` multiplies fuzzy scores before the threshold (1 at most after it).

    N-grams without an equal name meet only those of their scope that ``similar`` finds; an empty scope is one for all.
    """
    keys = [*scope, ngram]
    plain = queries.select(*dict.fromkeys([*keys, *([] if extra is None else ["mult"])])).distinct()
    dim = names.select(*scope, F.col(name).alias("match")).distinct()
    exact = plain.join(dim, [*(plain[c] == dim[c] for c in scope), plain[ngram] == dim["match"]]).select(*(plain[c] for c in plain.columns), "match", F.lit(1.0).alias("score"), F.lit(True).alias("exact"))
    rest = plain.join(exact.select(*keys).distinct(), keys, "left_anti")
    lowest = threshold if extra is None else threshold / 1.1
    bonus = K.SUBSTRING_BONUS_CONTEXT if context else K.SUBSTRING_BONUS
    pairs = rest.join(similar(rest, dim, scope, ngram, "match", lowest, bonus), keys)
    score = S.ensemble(F.col(ngram), F.col("match"), context)
    score = score if extra is None else score * extra
    fuzzy = pairs.select(*(F.col(c) for c in plain.columns), "match", score.alias("score"), F.lit(False).alias("exact")).where(F.col("score") >= threshold)
    best = fuzzy.withColumn("r", F.rank().over(Window.partitionBy(*plain.columns).orderBy(F.desc("score")))).where("r = 1").drop("r")
    return exact.unionByName(best.withColumn("score", F.least("score", F.lit(1.0))))


def street_lookup(rows: DataFrame, streets: DataFrame, text: str = "text", threshold: float = 0.9) -> DataFrame:
    """The street of each row (keyed by row_id) within its district, or its province if the district is null: equal, else the most
    similar at or above the threshold, the smallest id first among equals.

    Each distinct (province, district, text) is looked up once; only those without an equal street meet others of their scope, and of
    these only such as ``similar`` finds. Null texts and provinces find nothing.
    """
    named = streets.where("d is not null").groupBy("p", "d", "street").agg(F.min("id").alias("id"))
    whole = streets.groupBy("p", "street").agg(F.min("id").alias("id")).withColumn("d", F.lit(None).cast("string"))
    dim = named.unionByName(whole).withColumnsRenamed({"p": "p__", "d": "d__"})
    asked = rows.select("p", "d", F.col(text).alias("text__")).distinct()
    scope = (F.col("p") == F.col("p__")) & F.col("d").eqNullSafe(F.col("d__"))
    low = lambda c: F.lower(F.trim(c))
    exact = asked.join(dim, scope & (F.col("text__") == F.col("street")), "left").select("p", "d", "text__", "street", F.when(F.col("street").isNotNull(), 1.0).alias("street_score"))
    exact = staged(exact, "streets")
    place = lambda p, d: F.concat_ws("\0", p, F.isnull(d).cast("string"), d)
    missed = exact.where("street is null and p is not null").drop("street").withColumns({"place__": place("p", "d"), "low__": low("text__")})
    known = dim.where("p__ is not null").withColumns({"place__": place("p__", "d__"), "name__": low("street")})
    near = missed.join(similar(missed, known, ("place__",), "low__", "name__", threshold), ["place__", "low__"]).join(known, ["place__", "name__"])
    near = near.withColumn("street_score", S.ensemble(F.col("text__"), F.col("street"))).where(F.col("street_score") >= threshold)
    best = near.groupBy("p", "d", "text__").agg(F.min_by(F.struct("street", "street_score"), F.struct(-F.col("street_score"), F.col("id"))).alias("best"))
    found = exact.where("street is not null").unionByName(best.select("p", "d", "text__", "best.*"))
    found = found.withColumnsRenamed({"p": "p__", "d": "d__"})
    same = F.col("p").eqNullSafe(F.col("p__")) & F.col("d").eqNullSafe(F.col("d__")) & (F.col(text) == F.col("text__"))
    return rows.join(found, same, "left").select(*rows.columns, "street", "street_score")


def longest_first(pairs: DataFrame, by: str, name: str, score: str, place: str = "place") -> DataFrame:
    """Numbers each row's candidate names: those of more words first, then by score, then by name."""
    words = F.size(F.array_distinct(S.tokens_of(F.col(name))))
    return pairs.withColumn(place, F.row_number().over(Window.partitionBy(by).orderBy(words.desc(), F.desc(score), name)).cast("int"))
