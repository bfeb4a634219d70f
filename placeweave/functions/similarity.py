"""String similarities as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from placeweave import constants as K


def _low(c: Column) -> Column:
    return F.lower(F.trim(c))


def distance(a: Column, b: Column) -> Column:
    return F.levenshtein(_low(a), _low(b))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 if equal, 0 if either is empty or null."""
    a, b = _low(a), _low(b)
    longer = F.greatest(F.length(a), F.length(b))
    value = F.when(a == b, 1.0).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)
    return F.when(F.coalesce((a != "") & (b != ""), F.lit(False)), value).otherwise(0.0)


def ensemble(a: Column, b: Column, context: bool | Column = False) -> Column:
    """Similarity with a bonus if ``a`` contains the candidate ``b`` of five characters or more; 1 at most."""
    bonus = F.when(F.lit(context) if isinstance(context, bool) else context, K.SUBSTRING_BONUS_CONTEXT).otherwise(K.SUBSTRING_BONUS)
    inside = (F.length(_low(b)) >= K.SUBSTRING_MIN_LENGTH) & F.contains(_low(a), _low(b))
    base = similarity(a, b)
    return F.when(base == 0, 0.0).otherwise(F.least(F.lit(1.0), base + F.when(inside, bonus).otherwise(0.0)))


def ensemble_place(a: Column, b: Column) -> Column:
    """Where the candidate starts in ``a`` (-1 if nowhere), and its length (0 if nowhere)."""
    at = F.when(F.length(_low(b)) >= K.SUBSTRING_MIN_LENGTH, F.instr(_low(a), _low(b)) - 1).otherwise(-1)
    return F.struct(at.alias("start"), F.when(at >= 0, F.length(_low(b))).otherwise(0).alias("length"))


def within(a: Column, b: Column, threshold: float, context: bool = False) -> Column:
    """A cheap condition that every pair with ensemble >= threshold meets: few edits, or containment."""
    longer = F.greatest(F.length(a), F.length(b))
    edits = F.floor(longer * (1 - threshold) + 1e-9).cast("int")
    near = F.call_function("levenshtein", a, b, edits) >= 0
    return near | ((F.length(b) >= K.SUBSTRING_MIN_LENGTH) & F.contains(a, b))


def tokens_of(c: Column) -> Column:
    return F.filter(F.split(_low(c), r"\s+"), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens_of(a), tokens_of(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def contains_either(a: Column, b: Column) -> Column:
    a, b = _low(a), _low(b)
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if not x and not y else 2.0 * _lcs(x or "", y or "") / (len(x or "") + len(y or "")) for x, y in zip(a, b, strict=True)])


def token_sort_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / both lengths of the texts with their words sorted; 0 if either is empty."""
    x, y = (F.array_join(F.array_sort(tokens_of(c)), " ") for c in (a, b))
    both = F.coalesce((x != "") & (y != ""), F.lit(False))
    some = F.when(both & (x != y), x)  # only pairs that differ leave the JVM with their texts
    return F.when(both & (x == y), 1.0).when(both, _indel(some, F.when(some.isNotNull(), y))).otherwise(0.0)
