"""The administrative gazetteer: dimensions by level, lookups, inference, migrations and abbreviations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.functions import text as T
from placeweave.plans.stages import small

DIVISIONS = "id int, p string, d string, w string, p_full string, d_full string, w_full string, state_code string, county_code string"
ABBREVIATIONS = "key string, word string, province_context string, district_context string"
MIGRATIONS = "old_province string, old_district string, old_ward string, new_province string, new_ward string, note string"
STREETS = "id int, p string, d string, street string"
LEVELS = ("p", "d", "w")


@dataclass
class Gazetteer:
    """Ward-level divisions (names normalised, ``*_full`` as written), abbreviations, migrations and streets."""

    divisions: DataFrame
    abbreviations: DataFrame
    migrations: DataFrame
    streets: DataFrame

    @classmethod
    def of(cls, divisions: DataFrame, abbreviations: DataFrame | None = None, migrations: DataFrame | None = None, streets: DataFrame | None = None) -> Gazetteer:
        empty = divisions.sparkSession.createDataFrame
        return cls(divisions, abbreviations if abbreviations is not None else empty([], ABBREVIATIONS), migrations if migrations is not None else empty([], MIGRATIONS), streets if streets is not None else empty([], STREETS))

    def names(self, level: str) -> DataFrame:
        """Distinct names of a level within their parents, with the smallest id; nulls are no names."""
        keys = LEVELS[: LEVELS.index(level) + 1]
        return self.divisions.where(F.col(level).isNotNull() & (F.col(level) != "")).groupBy(*keys).agg(F.min("id").alias("id"))


def exact_match(rows: DataFrame, divisions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Left lookup of the division with the smallest id by ``keys`` (two or more), levels below the last key nulled."""
    if len(keys) < 2:
        raise ValueError("two keys are needed")
    least = divisions.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in divisions.columns if c not in keys)), "id").alias("found"))
    out = rows.join(least, list(keys), "left")
    return out.select(*rows.columns, *(F.when(F.lit(c.startswith("w") and "w" not in keys), None).otherwise(F.col(f"found.{c}")).alias(c) for c in divisions.columns if c not in keys))


def lookup(rows: DataFrame, divisions: DataFrame, p: str = "p", d: str = "d", w: str = "w", out: str = "found") -> DataFrame:
    """Adds the division with the smallest id that equals all that a row gives of province, district and ward: id, full names and codes.

    Null and empty names are not given, numbers count without leading zeros. With fewer than two given, or none that fits, the
    result is null; names of levels that are not given are null in it.
    """
    given = {level: F.nullif(F.trim(F.col(c)), F.lit("")) for level, c in zip(LEVELS, (p, d, w), strict=True)}
    given |= {level: T.admin_number(given[level]) for level in ("d", "w")}
    keyed, tags = rows.select("*", *(c.alias(f"own_{level}__") for level, c in given.items())), []
    for keys in (("p", "d"), ("p", "w"), ("d", "w"), LEVELS):
        tag = "by_" + "".join(keys) + "__"
        names = (F.col(f"{c}_full") if c in keys else F.lit(None).cast("string") for c in LEVELS)
        division = F.struct("id", *(n.alias(f"{c}_full") for c, n in zip(LEVELS, names, strict=True)), "state_code", "county_code")
        least = divisions.dropna(subset=list(keys)).groupBy(*(F.col(k).alias(f"{tag}{k}") for k in keys)).agg(F.min_by(division, "id").alias(tag))
        others = [F.col(f"own_{c}__").isNull() for c in LEVELS if c not in keys]
        only = reduce(lambda a, b: a & b, others, F.lit(True))
        keyed = keyed.join(small(least), [F.when(only, F.col(f"own_{k}__")) == F.col(f"{tag}{k}") for k in keys], "left")
        tags.append(tag)
    return keyed.select(*rows.columns, F.coalesce(*tags).alias(out))


def scoped(rows: DataFrame, divisions: DataFrame, p: str = "p", d: str = "d") -> DataFrame:
    """A row for each division within the province and district, as far as they are given, that a row of ``rows`` names, with the
    division's columns as a struct ``division``. A row that gives neither has no scope and no rows here: its candidates are the whole
    gazetteer, which nobody needs once for each row."""
    dim = divisions.select(F.col("p").alias("p__"), F.col("d").alias("d__"), F.struct(*divisions.columns).alias("division"))
    has_p, has_d = (F.coalesce(F.trim(F.col(c)) != "", F.lit(False)) for c in (p, d))
    same_p, same_d = F.col(p) == F.col("p__"), F.col(d) == F.col("d__")
    both = rows.where(has_p & has_d).join(dim, same_p & same_d)
    return both.union(rows.where(has_p & ~has_d).join(dim, same_p)).union(rows.where(~has_p & has_d).join(dim, same_d)).drop("p__", "d__")


def validity(rows: DataFrame, divisions: DataFrame, p: str = "p", d: str = "d", w: str = "w", out: str = "valid") -> DataFrame:
    """Flags rows whose (p), (p, d) or (p, d, w), as far as they are given, exist; false without a province."""
    sets = []
    for n in (1, 2, 3):
        sets.append(divisions.select(*LEVELS[:n]).dropna().distinct())
    known = [s.select(*(F.col(c).alias(f"v{n}_{c}") for c in s.columns), F.lit(True).alias(f"v{n}")) for n, s in enumerate(sets, 1)]
    df = rows
    for n, s in enumerate(known, 1):
        cond = [F.col(x) == F.col(f"v{n}_{c}") for x, c in zip((p, d, w)[:n], LEVELS[:n], strict=True)]
        df = df.join(small(s) if n < 3 else s, cond, "left")
    flag = F.when(F.col(w).isNotNull() & F.col(d).isNotNull(), F.col("v3")).when(F.col(w).isNotNull(), None).when(F.col(d).isNotNull(), F.col("v2")).otherwise(F.col("v1"))
    return df.select(*rows.columns, F.coalesce(flag, F.lit(False)).alias(out))


def children(divisions: DataFrame, parent: tuple[str, ...], child: str) -> DataFrame:
    return divisions.where(F.col(child).isNotNull()).select(*parent, child).distinct()


def parents(divisions: DataFrame, given: tuple[str, ...], wanted: str) -> DataFrame:
    """Per given names: the wanted parent with the smallest id, and all of them in order."""
    rows = divisions.dropna(subset=[*given, wanted])
    return rows.groupBy(*given).agg(F.min_by(wanted, "id").alias(wanted), F.array_sort(F.collect_set(wanted)).alias(f"all_{wanted}"))


def collisions(divisions: DataFrame) -> DataFrame:
    """Names that are both a province's and a district's."""
    return divisions.select(F.col("p").alias("name")).distinct().join(divisions.select(F.col("d").alias("name")).distinct(), "name")


def ambiguous_names(divisions: DataFrame) -> DataFrame:
    """Names of more than one level among district and ward, with the levels."""
    levels = divisions.select(F.col("d").alias("name"), F.lit("district").alias("level")).union(divisions.select(F.col("w").alias("name"), F.lit("ward").alias("level")))
    return levels.dropna().groupBy("name").agg(F.array_sort(F.collect_set("level")).alias("levels")).where(F.size("levels") > 1)


def postings(names: DataFrame, name: str) -> DataFrame:
    """The inverted index: a row for each distinct token of each name."""
    return names.withColumn("token", F.explode(F.array_distinct(F.split(name, " ")))).where("token <> ''")


def abbreviation_map(abbreviations: DataFrame, province: str | None = None, district: str | None = None) -> DataFrame:
    """(key, word) in force for a context: district beats province beats global; global keys with several words are dropped."""
    a = abbreviations
    rank = F.when(a.district_context.isNotNull(), 2).when(a.province_context.isNotNull(), 1).otherwise(0)
    fits = (a.province_context.isNull() | (a.province_context == F.lit(province))) & (a.district_context.isNull() | (a.district_context == F.lit(district)))
    rows = a.where(F.coalesce(fits, F.lit(False))).select("key", "word", rank.alias("rank"))
    words = rows.groupBy("key", "rank").agg(F.min("word").alias("word"), F.countDistinct("word").alias("n")).where((F.col("rank") > 0) | (F.col("n") == 1))
    return words.groupBy("key").agg(F.max_by("word", "rank").alias("word"))


def abbreviation_at(rows: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """Lookup of (key, province_context, district_context), nulls equal."""
    a = abbreviations.groupBy("key", "province_context", "district_context").agg(F.min("word").alias("word")).alias("a")
    cond = [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("key", "province_context", "district_context")]
    return rows.alias("r").join(a, cond, "left").select("r.*", "a.word")


def province_candidates(rows: DataFrame, abbreviations: DataFrame, key: str = "key") -> DataFrame:
    """All provinces that a global abbreviation may mean, in order (1 to n)."""
    a = abbreviations.where("province_context is null and district_context is null").select(F.col("key").alias(key), "word").distinct()
    return rows.join(small(a), key)


def full_names(rows: DataFrame, divisions: DataFrame) -> DataFrame:
    """Adds p_full, d_full and w_full by what is known of (p, d, w); empty where unknown."""
    df = rows
    for n, c in enumerate(LEVELS, 1):
        least = divisions.dropna(subset=list(LEVELS[:n])).groupBy(*LEVELS[:n]).agg(F.min_by(f"{c}_full", "id").alias(f"{c}_full"))
        df = df.join(least, list(LEVELS[:n]), "left")
    return df.select(*rows.columns, *(F.coalesce(f"{c}_full", F.lit("")).alias(f"{c}_full") for c in LEVELS))


def migration_priority(note: Column) -> Column:
    """Whole merger, renaming, unchanged, anything else, by what the note says first of these; notes may say more."""
    says = [F.contains(note, F.lit(phrase)) for phrase in ("Nhập toàn bộ", "Đổi tên", "Giữ nguyên")]
    return F.when(says[0], 1).when(says[1], 2).when(says[2], 3).otherwise(4)


def migrations_of(rows: DataFrame, migrations: DataFrame, key: str = "row_id") -> DataFrame:
    """Adds new_addresses: a ward's migrations, else (no ward given) its district's, else its province's; compared in lower case.

    They are in the order of their note's priority, new ward (null first), new province and note. What a province's rows get is the
    same for all of them: its distinct notes are put in order once and only then joined.
    """
    old = {c: F.lower(F.col(f"old_{c}")) for c in ("province", "district", "ward")}
    own = {"province": F.lower("p_full"), "district": F.lower(F.nullif("d_full", F.lit(""))), "ward": F.lower(F.nullif("w_full", F.lit("")))}
    keyed = rows.select(key, *(c.alias(f"own_{n}") for n, c in own.items()))
    m = migrations.select(*(c.alias(n) for n, c in old.items()), "new_province", "new_ward", "note")
    by_ward = keyed.where("own_ward is not null").join(m, (F.col("own_ward") == F.col("ward")) & (F.col("own_district") == F.col("district")) & (F.col("own_province") == F.col("province"))).select(key, "new_province", "new_ward", "note")
    by_district = keyed.where("own_ward is null and own_district is not null").join(m, (F.col("own_district") == F.col("district")) & (F.col("own_province") == F.col("province"))).select(key, "new_province", "new_ward", "note")
    item = F.struct(migration_priority(F.col("note")).alias("priority"), "new_ward", "new_province", "note")
    lists = by_ward.union(by_district).groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("new_addresses"))
    whole = m.select("province", "new_province", F.lit(None).cast("string").alias("new_ward"), "note").groupBy("province").agg(F.array_sort(F.collect_set(item)).alias("new_addresses"))
    by_province = keyed.where("own_ward is null and own_district is null").join(small(whole, of=m), F.col("own_province") == F.col("province")).select(key, "new_addresses")
    empty = F.array().cast("array<struct<priority:int,new_ward:string,new_province:string,note:string>>")
    out = rows.join(lists.union(by_province), key, "left")
    return out.withColumn("new_addresses", F.transform(F.coalesce("new_addresses", empty), lambda x: F.struct(x["new_province"].alias("new_province"), x["new_ward"].alias("new_ward"), x["note"].alias("note"))))


def whole_or_partial(migrations: DataFrame) -> DataFrame:
    """Per old and new province: distinct old wards that go there against all of the old province's."""
    total = migrations.groupBy("old_province").agg(F.countDistinct("old_ward").alias("all_wards"))
    part = migrations.groupBy("old_province", "new_province").agg(F.countDistinct("old_ward").alias("wards"))
    return part.join(total, "old_province").withColumn("kind", F.when(F.col("wards") == F.col("all_wards"), "whole").otherwise("partial"))
