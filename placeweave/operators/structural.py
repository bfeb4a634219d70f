"""Structural parsing of comma-separated addresses, and branches for names of two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave import constants as K
from placeweave.functions import text as T
from placeweave.functions import tokens as N
from placeweave.operators import gazetteer as G
from placeweave.plans.stages import small

# Words that say a piece's level, ward before district before province.
LEVEL_PATTERNS = (
    ("ward", r"(?i)\b(xa|phuong|[pf](?=\.|\s|$))"),
    ("district", r"(?i)\b(quan|huyen|thi\s*xa|tx|[qh](?=\.|\s|$)|thanh\s*pho|t\.?p(?=\.|\s|$))"),
    ("province", r"(?i)\b(tinh)\b"),
)


def segments(df: DataFrame, text: str = "text", row_id: str = "row_id") -> DataFrame:
    """A row for each named piece: row_id, position, level, keyword, name, boost. Noise and texts without a comma give none."""
    usable = df.where(~T.is_noise(F.col(text)) & F.col(text).contains(","))
    pieces = F.filter(F.transform(F.split(text, ","), lambda p: T.collapse(F.lower(p))), lambda p: p != "")
    rows = usable.select(row_id, F.size(pieces).alias("n"), F.posexplode(pieces).alias("position", "piece"))
    level, keyword = F.lit("unknown"), F.lit("")
    for name, pattern in reversed(LEVEL_PATTERNS):
        level = F.when(F.col("piece").rlike(pattern), name).otherwise(level)
        keyword = F.when(F.col("piece").rlike(pattern), F.regexp_extract("piece", pattern, 1)).otherwise(keyword)
    rows = rows.withColumn("level", level).withColumn("keyword", keyword)
    after = N.words(T.finalize(F.expr("substr(piece, locate(keyword, piece) + length(keyword))")))
    stop = F.filter(F.transform(after, lambda t, i: F.when(N.is_keyword(t, K.SCANNER_KEYWORDS), i)), lambda i: i.isNotNull())
    most = F.when(F.length("keyword") <= 2, 2).otherwise(3)
    name = F.array_join(F.slice(after, 1, F.least(most, F.coalesce(F.try_element_at(stop, F.lit(1)), F.size(after)))), " ")
    rows = rows.withColumn("name", F.when(F.col("level") == "unknown", F.col("piece")).otherwise(name))
    boost = F.round(0.1 + F.when(F.col("keyword") != "", 0.3).otherwise(0.0) + 0.1 * F.col("position") / F.greatest(F.col("n") - 1, F.lit(1)), 2)
    return rows.where((F.col("name") != "") & ~F.col("name").rlike(r"^\d+$") | F.col("name").rlike(r"^\d{1,2}$") & (F.col("keyword") != "")).select(row_id, "position", "n", "level", "keyword", "name", boost.alias("boost"))


def hierarchy(segs: DataFrame, provinces: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Per row: ward, district and province of its pieces, unknown ones read by their place, and a confidence."""
    w = Window.partitionBy(row_id).orderBy("position")
    rows = segs.withColumn("before", F.lag("level").over(w)).join(small(provinces.select(F.col("p").alias("name"), F.lit(True).alias("is_p")).distinct()), "name", "left")
    last = (F.col("position") == F.col("n") - 1) & (F.col("n") > 1)
    unknown = F.col("level") == "unknown"
    named = lambda level: F.max_by(F.when(F.col("level") == level, F.col("name")), F.when(F.col("level") == level, F.col("position")))
    out = rows.groupBy(row_id).agg(
        named("ward").alias("ward"),
        F.coalesce(named("district"), F.min_by(F.when(unknown & (F.col("before") == "ward"), F.col("name")), F.when(unknown & (F.col("before") == "ward"), F.col("position")))).alias("district"),
        F.coalesce(named("province"), F.max(F.when(unknown & last & F.col("is_p"), F.col("name")))).alias("province"),
        F.count_if(~unknown).alias("known"),
        F.count_if(unknown).alias("unknown"),
    )
    whole = F.col("ward").isNotNull() & F.col("district").isNotNull() & F.col("province").isNotNull()
    score = 0.5 + 0.15 * F.col("known") + F.when(whole, 0.1).otherwise(0.0) - 0.05 * F.col("unknown")
    return out.select(row_id, "ward", "district", "province", F.least(F.greatest(score, F.lit(0.0)), F.lit(0.95)).alias("confidence"))


def as_candidates(parsed: DataFrame, divisions: DataFrame, method: str = "comma") -> DataFrame:
    """Parsed addresses (row_id, province, district, ward, confidence) as candidates of the resolver's form.

    Only rows whose province, and whose district and ward as far as they have them, the gazetteer knows become candidates; null and
    empty names are names that a row does not have.
    """
    named = parsed.select("row_id", "confidence", *(F.nullif(F.col(c), F.lit("")).alias(k) for k, c in (("p", "province"), ("d", "district"), ("w", "ward"))))
    rows = G.full_names(named, divisions)
    known = lambda c: F.col(c).isNull() | (F.col(f"{c}_full") != "")
    rows = rows.where((F.col("p_full") != "") & known("d") & known("w"))
    level = 1 + F.col("d").isNotNull().cast("int") + F.col("w").isNotNull().cast("int")
    scores = [F.when(F.col(c).isNotNull(), score).otherwise(0.0).alias(f"{c}_score") for c, score in (("p", 1.0), ("d", 0.95), ("w", 0.95))]
    return rows.select(
        "row_id", "p", "d", "w", "p_full", "d_full", "w_full", *scores, level.alias("match_level"), level.alias("at_rule"), F.lit(f"structural_{method}").alias("source"),
        F.lit("exact").alias("match_type"), F.lit(True).alias("valid"), "confidence", F.col("confidence").alias("final_confidence"),
    )


def disambiguate(names: DataFrame, divisions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Each (row, province, name) whose name is a district's and a ward's: read as the district, and as a ward of up to three districts."""
    both = G.ambiguous_names(divisions).select("name")
    rows = names.join(both, "name", "left_semi")
    as_d = rows.join(divisions.select("p", F.col("d").alias("name")).distinct(), ["p", "name"]).select(row_id, "p", F.col("name").alias("d"), F.lit(None).cast("string").alias("w"), F.lit("as_district").alias("interpretation"))
    up = divisions.where("w is not null").groupBy("p", "d", F.col("w").alias("name")).agg(F.min("id").alias("id"))
    as_w = rows.join(up, ["p", "name"]).withColumn("n", F.row_number().over(Window.partitionBy(row_id, "p", "name").orderBy("id"))).where("n <= 3")
    return as_d.union(as_w.select(row_id, "p", "d", F.col("name").alias("w"), F.lit("as_ward").alias("interpretation")))


def combination_score(prox: Column, base: Column, valid: Column, order: Column, adjacent: Column, similar: Column) -> Column:
    """The score of a province, district and ward taken together: closeness, match and validity, squared by match quality."""
    mixed = 0.30 * prox + 0.50 * base + 0.20 * F.when(valid, 1.0).otherwise(0.0)
    return mixed * order * F.when(adjacent, 1.15).otherwise(1.0) * F.when(valid, 1.0).otherwise(0.5) * similar * base * base
