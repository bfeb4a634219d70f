"""Combinations of candidates: every province, district and ward that an address may mean, taken together and scored as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.functions import scoring as C
from placeweave.functions import text as T
from placeweave.functions import tokens as N
from placeweave.operators import gazetteer as G
from placeweave.operators.structural import combination_score
from placeweave.plans.stages import small

# How many names of each level are combined, and how many combinations a row keeps.
MOST = {"p": 3, "d": 5, "w": 3}
BEST = 5


def leading(options: DataFrame) -> DataFrame:
    """Of ``options`` (row_id, level, name, score, s, e), each level's best names: a name once, the best province or district alone if
    its score is 1. Equal scores go by the later place, then by name."""
    by = ["row_id", "level"]
    named = options.where("name is not null and score is not null").withColumn("n", F.row_number().over(Window.partitionBy(*by, "name").orderBy(F.desc("score"), F.desc("e"), F.desc("s")))).where("n = 1")
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("e"), "name")
    placed = named.withColumn("n", F.row_number().over(order)).withColumn("top", F.max("score").over(Window.partitionBy(*by)))
    most = F.when((F.col("level") != "w") & (F.col("top") == 1.0), 1)
    for level, n in MOST.items():
        most = most.when(F.col("level") == level, n)
    return placed.where(F.col("n") <= most).select("row_id", "level", "name", F.col("score").cast("double").alias("score"), "s", "e", F.col("n").alias("place"), (F.col("top") == 1.0).alias("sure"))


def combined(rows: DataFrame, options: DataFrame, divisions: DataFrame) -> DataFrame:
    """(row_id, p, d, w and each one's _score, s and e): the product of a row's names, one row of nulls for a level without any.

    Wards are combined with their absence, too, and bring the district they lie in, in the first province, unless it is sure already.
    At most 3 x 8 x 4 combinations a row of ``rows`` (row_id).
    """
    best = leading(options)
    ids = rows.select("row_id").distinct()

    def level(c: str) -> DataFrame:
        return best.where(F.col("level") == c).select("row_id", F.col("name").alias(c), F.col("score").alias(f"{c}_score"), F.col("s").alias(f"{c}s"), F.col("e").alias(f"{c}e"))

    absent = lambda c: [F.lit(None).cast("string").alias(c), F.lit(0.0).alias(f"{c}_score"), F.lit(-1).alias(f"{c}s"), F.lit(-1).alias(f"{c}e")]
    zero = lambda df, c: df.withColumns({f"{c}_score": F.coalesce(f"{c}_score", F.lit(0.0)), f"{c}s": F.coalesce(f"{c}s", F.lit(-1)), f"{c}e": F.coalesce(f"{c}e", F.lit(-1))})
    p = zero(ids.join(level("p"), "row_id", "left"), "p")
    d = zero(ids.join(level("d"), "row_id", "left"), "d")
    w = level("w").union(ids.select("row_id", *absent("w")))
    first = best.where("level = 'p' and place = 1").select("row_id", F.col("name").alias("p"))
    up = G.parents(divisions, ("p", "w"), "d").select("p", "w", "d")
    inferred = level("w").select("row_id", "w").join(first, "row_id").join(small(up), ["p", "w"]).select("row_id", "d").distinct()
    open_ = inferred.join(best.where("level = 'd' and sure").select("row_id").distinct(), "row_id", "left_anti").join(level("d").select("row_id", "d"), ["row_id", "d"], "left_anti")
    d = d.union(open_.select("row_id", "d", F.lit(1.0), F.lit(-1), F.lit(-1)))
    return p.join(d, "row_id").join(w, "row_id")


def _claim(name: Column, s: Column, e: Column) -> Column:
    """0.5 to 0.8 if a span and its name differ in their number of words, else 1."""
    claimed, own = e - s, F.size(N.words(F.coalesce(name, F.lit(""))))
    differ = F.coalesce((s >= 0) & (own > 0) & (claimed != own), F.lit(False))
    return F.when(differ, 0.5 + 0.3 * F.least(claimed, own) / F.greatest(claimed, own, F.lit(1))).otherwise(1.0)


def scored(combos: DataFrame, rows: DataFrame, divisions: DataFrame) -> DataFrame:
    """``combos`` with hierarchy_valid, match_level and score, for ``rows`` (row_id, raw, tokens array<string>).

    Combinations need a province or a district, and all three levels together have to exist. Names that stand in the text as written
    count more, and what the names and the words around them leave unexplained counts less (coverage, by the ward's name).
    """
    checked = G.validity(combos, divisions, out="exists")
    valid = F.col("p").isNull() | (F.col("d").isNull() & F.col("w").isNull()) | F.col("exists")
    homes = divisions.dropna(subset=["p", "d", "w"]).groupBy("p", "w").agg(F.countDistinct("d").alias("homes"))
    checked = checked.withColumn("hierarchy_valid", valid).join(small(homes), ["p", "w"], "left").join(rows.select("row_id", "raw", "tokens"), "row_id")
    span = lambda c: (F.col(f"{c}s"), F.col(f"{c}e"))
    there = F.col("hierarchy_valid") & F.col("p").isNotNull() & F.col("d").isNotNull() & F.col("w").isNotNull()
    base = C.mean_positive(F.col("p_score"), F.col("d_score"), F.col("w_score"))
    adjacent = (F.col("ws") >= 0) & (F.col("ds") >= 0) & (F.col("we") == F.col("ds"))
    similar = _claim(F.col("w"), *span("w")) * _claim(F.col("d"), *span("d"))
    score = combination_score(C.proximity(span("w"), span("d"), span("p")), base, F.col("hierarchy_valid"), C.order_bonus(F.col("ws"), F.col("ds"), F.col("ps")), adjacent, similar)
    score = score * F.when(there & (F.col("homes") > 1), 1.1).otherwise(1.0)
    written = T.fold_accents(F.lower(F.coalesce("raw", F.lit(""))))
    score = score * F.when(F.coalesce(F.contains(written, F.col("d")), F.lit(False)), 1.15).otherwise(1.0) * F.when(F.coalesce(F.contains(written, F.col("w")), F.lit(False)), 1.10).otherwise(1.0)
    rest = N.remaining(F.col("tokens"), [span(c) for c in G.LEVELS])
    score = score * F.when(F.size("tokens") > 0, C.coverage(F.col("tokens"), F.col("w"), rest)["multiplier"]).otherwise(1.0)
    level = F.when(F.col("w").isNotNull(), 3).when(F.col("d").isNotNull(), 2).when(F.col("p").isNotNull(), 1).otherwise(0)
    out = checked.select(*combos.columns, "hierarchy_valid", level.alias("match_level"), score.alias("score"))
    whole = F.col("p").isNotNull() & F.col("d").isNotNull() & F.col("w").isNotNull()
    return out.where((F.col("p").isNotNull() | F.col("d").isNotNull()) & (F.col("hierarchy_valid") | ~whole))


def by_street(rows: DataFrame, options: DataFrame, streets: DataFrame) -> DataFrame:
    """(row_id, p, d, street, score): the districts of a row's first province that have one of its three best streets (level ``s`` of
    ``options``; those of more words first). A district that the text (norm) does not name counts less."""
    w = Window.partitionBy("row_id").orderBy(F.size(N.words(F.col("name"))).desc(), F.desc("score"), "name")
    named = options.where("level = 's'").withColumn("n", F.row_number().over(w)).where("n <= 3").select("row_id", F.col("name").alias("street"), F.col("score").alias("street_score"))
    first = leading(options).where("level = 'p' and place = 1").select("row_id", F.col("name").alias("p"), F.col("score").alias("p_score"))
    dim = streets.where("d is not null").select("p", "d", "street").distinct()
    found = named.join(first, "row_id").join(dim, ["p", "street"]).join(rows.select("row_id", "norm"), "row_id")
    score = (F.col("p_score") + F.col("street_score")) / 2 * 0.75 * F.when(F.contains("norm", F.col("d")), 1.0).otherwise(0.3)
    return found.select("row_id", "p", "d", "street", score.alias("score"))


def combinations(rows: DataFrame, options: DataFrame, divisions: DataFrame, most: int = BEST) -> DataFrame:
    """The best combinations of each row, numbered by ``place``: by score, then by level, then by names."""
    ranked = scored(combined(rows, options, divisions), rows, divisions)
    w = Window.partitionBy("row_id").orderBy(F.desc("score"), F.desc("match_level"), *(F.asc_nulls_last(c) for c in G.LEVELS))
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
