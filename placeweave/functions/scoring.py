"""Scores, bonuses and flags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave import constants as K
from placeweave.functions import tokens as N


def mean_positive(*scores: Column) -> Column:
    """Mean of the scores above 0; 0 if there is none."""
    total = sum((F.when(s > 0, s).otherwise(0.0) for s in scores), F.lit(0.0))
    count = sum((F.when(s > 0, 1).otherwise(0) for s in scores), F.lit(0))
    return F.when(count > 0, total / F.greatest(count, F.lit(1))).otherwise(0.0)


def gap_score(gap: Column) -> Column:
    out = F.lit(K.FAR_SCORE)
    for most, score in reversed(K.GAP_SCORES):
        out = F.when(gap <= most, score).otherwise(out)
    return out


def _present(span: tuple[Column, Column]) -> Column:
    return F.coalesce(span[0] >= 0, F.lit(False))


def proximity(ward: tuple[Column, Column], district: tuple[Column, Column], province: tuple[Column, Column]) -> Column:
    """Closeness of neighbouring levels' spans (start, end): the mean over the pairs there are, 0.5 if none."""
    w, d, p = map(_present, (ward, district, province))
    pairs = ((w & d, F.abs(district[0] - ward[1])), (d & p, F.abs(province[0] - district[1])), (w & p & ~d, F.abs(province[0] - ward[1])))
    return F.coalesce(F.nullif(mean_positive(*(F.when(on, gap_score(gap)).otherwise(0.0) for on, gap in pairs)), F.lit(0.0)), F.lit(0.5))


def order_bonus(ward: Column, district: Column, province: Column) -> Column:
    """1.1 if two levels or more have places and these rise from ward to province; places are null or negative if absent."""
    places = F.filter(F.array(ward, district, province), lambda x: x >= 0)
    return F.when((F.size(places) >= 2) & (F.array_sort(places) == places), 1.1).otherwise(1.0)


def extraction_confidence(p: Column, d: Column, w: Column, level: Column, known: Column) -> Column:
    base = mean_positive(p, d, w)
    raised = base + F.when(level == 3, 0.1).when(level == 2, 0.05).otherwise(0.0) + F.when(known, 0.1).otherwise(0.0)
    return F.when(base > 0, F.least(raised, F.lit(1.0))).otherwise(0.0)


def position_factor(start: Column, least: Column, most: Column) -> Column:
    """0.8 to 1 from the first to the last start; 1 if they are one."""
    return F.when(most > least, (1 - K.POSITION_FACTOR) + K.POSITION_FACTOR * (start - least) / F.greatest(most - least, F.lit(1))).otherwise(1.0)


def continuity(places: Column) -> Column:
    """1 / number of runs of consecutive places; 0 if there are none."""
    ordered = F.array_sort(places)
    runs = F.size(F.filter(ordered, lambda x: ~F.array_contains(places, x - 1)))
    return F.when(F.size(places) > 0, F.lit(1.0) / F.greatest(runs, F.lit(1))).otherwise(0.0)


def coverage(tokens: Column, ward: Column, location: Column) -> Column:
    """struct of ratio, continuity, weighted, score and multiplier: how much of the tokens a ward and a location name explain."""
    w, loc = N.words(F.coalesce(F.lower(ward), F.lit(""))), N.words(F.coalesce(F.lower(location), F.lit("")))
    items = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), F.array_contains(w, F.lower(t)).alias("w"), F.array_contains(loc, F.lower(t)).alias("l"), F.lower(t).isin(*K.COVERAGE_NOISE_WORDS).alias("noise")))
    count = lambda test: F.size(F.filter(items, test))
    meaningful = count(lambda x: ~x["noise"])
    ratio = F.when(meaningful > 0, count(lambda x: ~x["noise"] & (x["w"] | x["l"])) / F.greatest(meaningful, F.lit(1))).otherwise(0.0)
    run = continuity(F.transform(F.filter(items, lambda x: x["w"] | x["l"]), lambda x: x["i"]))
    n = F.size(tokens)
    weighted = F.when(n > 0, (2 * count(lambda x: x["w"]) + count(lambda x: ~x["w"] & x["l"])) / F.greatest(2 * n, F.lit(1))).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio * 0.4 + run * 0.3 + weighted * 0.3))
    return F.struct(ratio.alias("ratio"), run.alias("continuity"), weighted.alias("weighted"), score.alias("score"), coverage_multiplier(score).alias("multiplier"))


def coverage_multiplier(score: Column) -> Column:
    out = F.lit(K.COVERAGE_STEPS[-1][1])
    for least, value in reversed(K.COVERAGE_STEPS):
        out = F.when(score >= least, value).otherwise(out)
    return out


def source_multiplier(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in K.SOURCE_MULTIPLIERS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, source), F.lit(K.DEFAULT_SOURCE))


def confidence(p: Column, d: Column, w: Column, at_rule: Column, valid: Column, source: Column) -> Column:
    """0.5 base + 0.3 by level + 0.2 if valid, by the source's reliability, 1 at most, three places."""
    base = F.coalesce(F.nullif(mean_positive(p, d, w), F.lit(0.0)), F.lit(0.5))
    near = F.when(at_rule == 3, 0.9).when(at_rule == 2, 0.7).otherwise(0.5)
    return F.bround(F.least((0.5 * base + 0.3 * near + 0.2 * F.when(valid, 1.0).otherwise(0.0)) * source_multiplier(source), F.lit(1.0)), 3)


def length_penalty(start: Column, end: Column, name: Column) -> Column:
    """0.7 to 0.9 if a span and its name differ in their number of tokens, else 1."""
    claimed, own = end - start, F.size(N.words(name))
    differ = F.coalesce((start >= 0) & (own > 0) & (claimed > 0) & (claimed != own), F.lit(False))
    return F.when(differ, 0.7 + 0.2 * F.least(claimed, own) / F.greatest(claimed, own, F.lit(1))).otherwise(1.0)


def token_bonus(n: Column) -> Column:
    out = F.lit(1.0)
    for least, bonus in reversed(K.TOKEN_BONUS):
        out = F.when(n >= least, bonus).otherwise(out)
    return out


def quality_flag(at_rule: Column, score: Column) -> Column:
    return F.when((at_rule == 3) & (score >= 0.8), "full_address").when((at_rule == 2) & (score >= 0.6), "partial_address").when((at_rule == 1) & (score >= 0.6), "province_only").otherwise("failed")
