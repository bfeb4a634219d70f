"""Similarity join of short texts: all pairs within a share of edits, or of which one holds the other, without comparing all pairs.

Edits. A name that may differ from a text in d edits is cut into d + 1 segments; one of them at least is untouched, and stands
in the text at a place that the two lengths and the edits to either side bound. So names are kept under (length, number of the
segment, segment), texts look under the few substrings that may be one, and both meet by an equi-join. d follows from the
threshold and the longest text that a name can match.

Common segments. Where many names share a segment (a common word, a counter's zeros), what is left of name and text without it
still differs in d edits at most. For up to FEW edits, names under such a key and the texts that look there meet under what
remains of that when as many characters are left out: two texts within d edits share one of these, others hardly ever. For more
edits (longer names) they are cut again, up to LEVELS times, and meet under both segments. No key is dropped: after the last cut
they meet whatever their number.

Containment. A text of n characters can only hold a name of m if m / n and the bonus reach the threshold; its substrings of these
lengths, as far as there are names of them, are looked up as they are.

What is broadcast are plans by length: a row for each name length and text length within its reach, and only while the longest
name has LONGEST characters at most (then they have LONGEST ** 2 rows at most).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave import constants as K
from placeweave.plans.stages import staged

#: A key that more names share is common; names of up to FEW edits lose characters then, others are cut LEVELS times at most.
COMMON, FEW, LEVELS = 200, 2, 4
LONGEST = 700


def edits_within(longer: Column, threshold: float) -> Column:
    """How many edits leave 1 - edits / longer at the threshold or above."""
    return F.floor(longer * (1 - threshold) + 1e-9).cast("int")


def _reach(lengths: DataFrame, threshold: float) -> DataFrame:
    """(lb, la, most, edits): text lengths within reach of each name length; the most edits of any, and those of this one."""
    lb = F.col("lb")
    near = F.filter(F.sequence(F.lit(1), 2 * lb + 2), lambda la: F.abs(la - lb) <= edits_within(F.greatest(la, lb), threshold))
    out = lengths.select("lb", near.alias("near")).select("lb", edits_within(F.array_max("near"), threshold).alias("most"), F.explode("near").alias("la"))
    return out.withColumn("edits", edits_within(F.greatest("la", "lb"), threshold))


def _cut(most: Column, length: Column, number: Column) -> tuple[Column, Column]:
    """Start and width of a segment."""
    start = F.floor(number * length / (most + 1)).cast("int")
    return start, F.floor((number + 1) * length / (most + 1)).cast("int") - start


def _near(queries: DataFrame, names: DataFrame, scope: list[str], reach: DataFrame, by_length: Callable, large: bool) -> DataFrame:
    """(scope, a, b) that may be within their edits."""
    left = queries.withColumn("la", F.length("a")).join(by_length(reach), "la").select(*scope, "a", "lb", "most", "edits", (F.col("la") - F.col("lb")).alias("gap"), F.col("a").alias("rest"), F.lit("").alias("path"))
    right = names.withColumn("lb", F.length("b")).join(by_length(reach.select("lb", "most").distinct()), "lb").select(*scope, "b", "lb", "most", F.col("b").alias("rest"), F.lit("").alias("path"))
    found = None
    for level in range(LEVELS):
        # ``lb`` stays the name's whole length; what is cut is the rest, whose length in the name is ``lb`` less what was cut out.
        size = F.col("lb") if level == 0 else F.col("size")
        left = left.withColumns({"size": size, "i": F.explode(F.sequence(F.lit(0), "most"))})
        start, width = _cut(F.col("most"), F.col("size"), F.col("i"))
        left = left.withColumns({"start": start, "width": width})
        first = F.greatest(F.lit(0), F.col("start") + F.ceil((F.col("gap") - F.col("edits")) / 2).cast("int"))
        last = F.least(F.length("rest") - F.col("width"), F.col("start") + F.floor((F.col("gap") + F.col("edits")) / 2).cast("int"))
        left = left.withColumns({"first": first, "last": last}).where("first <= last").withColumn("at", F.explode(F.sequence("first", "last")))
        key = lambda at: F.concat_ws("\0", "path", "lb", "i", F.substring("rest", at + 1, F.col("width")))
        cut = lambda at: F.concat(F.substring("rest", F.lit(1), at), F.substring("rest", at + F.col("width") + 1, F.length("rest")))
        left = left.select(*scope, "a", "lb", "most", "edits", "gap", key(F.col("at")).alias("path"), cut(F.col("at")).alias("rest"), (F.col("size") - F.col("width")).alias("size"))
        right = right.withColumns({"size": size, "i": F.explode(F.sequence(F.lit(0), "most"))}).withColumns({"start": start, "width": width})
        right = right.select(*scope, "b", "lb", "most", key(F.col("start")).alias("path"), cut(F.col("start")).alias("rest"), (F.col("size") - F.col("width")).alias("size"))
        keys = [*scope, "path"]
        common = None
        if large and level < LEVELS - 1:
            left, right = staged(left.distinct(), "texts"), staged(right, "names")
            common = staged(right.groupBy(*keys).count().where(F.col("count") > COMMON).select(*keys), "common")
            if common.limit(1).count() == 0:
                common = None
        rare = right if common is None else right.join(common, keys, "left_anti")
        met = left.select(*keys, "a").distinct().join(rare.select(*keys, "b"), keys).select(*scope, "a", "b")
        found = met if found is None else found.union(met)
        if common is None:
            return found
        left, right = left.join(common, keys, "left_semi"), right.join(common, keys, "left_semi")
        few = F.col("most") <= FEW
        found = found.union(_by_deletions(left.where(few), right.where(few), keys).select(*scope, "a", "b"))
        left, right = left.where(~few), right.where(~few)
    return found


def _by_deletions(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Texts and names under a common key whose rests are equal without as many characters of each as there may be edits, or fewer."""

    def shortened(df: DataFrame, own: str, edits: str) -> DataFrame:
        now = df.select(*keys, own, F.col(edits).alias("most"), F.col("rest").alias("left_over"))
        every = now
        for n in range(1, FEW + 1):
            now = now.where((F.col("most") >= n) & (F.col("left_over") != "")).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("left_over"))))
            without = F.concat(F.substring("left_over", F.lit(1), F.col("at") - 1), F.substring("left_over", F.col("at") + 1, F.length("left_over")))
            now = now.select(*keys, own, "most", without.alias("left_over")).distinct()
            every = every.union(now)
        return every.select(*keys, own, "left_over").distinct()

    return shortened(left, "a", "edits").join(shortened(right, "b", "most"), [*keys, "left_over"])


def _inside(queries: DataFrame, names: DataFrame, scope: list[str], lengths: DataFrame, by_length: Callable, least: float) -> DataFrame:
    """(scope, a, b) where ``a`` holds ``b``, of SUBSTRING_MIN_LENGTH or more and at least ``least`` of its length."""
    longest = F.floor(F.col("lb") / least + 1e-9).cast("int")
    plan = lengths.where((F.col("lb") >= K.SUBSTRING_MIN_LENGTH) & (longest > F.col("lb"))).select("lb", F.explode(F.sequence(F.col("lb") + 1, longest)).alias("la"))
    cuts = queries.withColumn("la", F.length("a")).join(by_length(plan), "la").withColumn("at", F.explode(F.sequence(F.lit(1), F.col("la") - F.col("lb") + 1)))
    return cuts.select(*scope, "a", F.substring("a", F.col("at"), F.col("lb")).alias("b")).distinct().join(names, [*scope, "b"]).select(*scope, "a", "b")


def similar(queries: DataFrame, names: DataFrame, scope: tuple[str, ...], query: str, name: str, threshold: float, bonus: float = K.SUBSTRING_BONUS) -> DataFrame:
    """Distinct (scope, query, name) that can reach the threshold by edits alone or, where the text holds the name, by the bonus.

    ``threshold`` is over 0.5 and over ``bonus``. Pairs that cannot are left out, all others are there; a few that do not reach it
    may be, so score them. Scopes that are null, and null or empty texts and names, meet nothing. An empty ``scope`` is one scope.
    """
    if threshold <= max(0.5, bonus):
        raise ValueError("the threshold has to be over 0.5 and over the bonus")
    some = lambda df, c, to: df.select(*scope, F.col(c).alias(to)).where(F.length(to) > 0).distinct()
    left, right = some(queries, query, "a"), some(names, name, "b")
    size = right.agg(F.count("*").alias("n"), F.max(F.length("b")).alias("longest")).first()
    by_length = F.broadcast if (size["longest"] or 0) <= LONGEST else lambda df: df
    lengths = right.select(F.length("b").alias("lb")).distinct()
    near = _near(left, right, list(scope), _reach(lengths, threshold), by_length, size["n"] > COMMON)
    pairs = near.union(_inside(left, right, list(scope), lengths, by_length, threshold - bonus))
    return pairs.select(*scope, F.col("a").alias(query), F.col("b").alias(name)).distinct()
