"""Review analytics: ratings, sessions, samples, accuracy; state is derived from logs, never changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RATINGS = (0, 1, 2, 3)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; 0 if b is 0."""
    return F.when(b > 0, a.cast("double") / F.greatest(b, F.lit(1))).otherwise(0.0)


def distribution(df: DataFrame, rating: str = "user_rating") -> DataFrame:
    """One row: total, a count and a percentage per rating; zeros for no rows."""
    counts = [F.coalesce(F.sum(F.when(F.col(rating) == r, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"rating_{r}") for r in RATINGS]
    out = df.agg(F.count("*").alias("total"), *counts)
    return out.select("*", *(F.round(100 * ratio(F.col(f"rating_{r}"), F.col("total")), 4).alias(f"pct_{r}") for r in RATINGS))


def average_by_rating(df: DataFrame, rating: str = "user_rating", value: str = "confidence_score") -> DataFrame:
    """Mean value of each rating, 0 for ratings without one."""
    means = df.where(F.col(value).isNotNull()).groupBy(rating).agg(F.avg(value).alias("mean"))
    every = df.sparkSession.range(len(RATINGS)).select(F.col("id").cast("int").alias(rating))
    return every.join(F.broadcast(means), rating, "left").select(rating, F.coalesce("mean", F.lit(0.0)).alias("mean"))


def conditional_averages(df: DataFrame, rating: str = "user_rating", value: str = "confidence_score") -> DataFrame:
    """One row with the mean value of each rating; null for ratings without one."""
    return df.agg(*(F.avg(F.when(F.col(rating) == r, F.col(value))).alias(f"mean_{r}") for r in RATINGS))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in order with the total and whether more follow."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit is 1 to 500, offset not negative")
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def upsert_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, nulls in keys equal to empty ones."""
    same = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*same).orderBy(*order))).where("rn = 1").drop("rn")


def upsert(base: DataFrame, change: DataFrame, key: list[str]) -> DataFrame:
    """``base`` with rows of ``change`` in the place of those of equal key, and added where there is none."""
    return upsert_latest(base.withColumn("late", F.lit(0)).unionByName(change.withColumn("late", F.lit(1))), key, [F.desc("late")]).drop("late")


def update_rating(df: DataFrame, row_id: int, rating: int, key: str = "id") -> DataFrame:
    if rating not in RATINGS:
        raise ValueError(f"no rating: {rating}")
    return df.withColumn("user_rating", F.when(F.col(key) == row_id, F.lit(rating)).otherwise(F.col("user_rating")))


def insert_absent(base: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``fresh`` whose key, nulls equal, is not there yet, added to ``base``."""
    new = fresh.dropDuplicates(key).alias("f").join(base.select(*key).alias("b"), [F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key], "left_anti")
    return base.unionByName(new, allowMissingColumns=True)


def unprocessed(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a counterpart, nulls in keys equal to empty ones."""
    cond = [F.coalesce(F.col(f"a.{c}").cast("string"), F.lit("")) == F.coalesce(F.col(f"b.{c}").cast("string"), F.lit("")) for c in key]
    return rows.alias("a").join(done.select(*key).alias("b"), cond, "left_anti")


def sample(df: DataFrame, n: int, seed: int, where: Column | None = None) -> DataFrame:
    """A seeded random sample of n rows."""
    return (df if where is None else df.where(where)).orderBy(F.rand(seed)).limit(n)


def rated(df: DataFrame, ratings: list[int], n: int, seed: int, rating: str = "user_rating") -> DataFrame:
    """A seeded random sample of n rows with one of these ratings, to be processed again."""
    return sample(df, n, seed, F.col(rating).isin(ratings))


def sessions(log: DataFrame, session: str = "session_id", rating: str = "user_rating", at: str = "ts") -> DataFrame:
    """Per session: start, end, reviews, counts by rating and the share of ratings 1 and 2 in percent."""
    good = F.count_if(F.col(rating).isin(1, 2))
    counts = [F.count_if(F.col(rating) == r).alias(f"rating_{r}_count") for r in RATINGS]
    return log.groupBy(session).agg(F.min(at).alias("start_time"), F.max(at).alias("end_time"), F.count("*").alias("total_reviews"), *counts, F.round(100 * ratio(good, F.count("*")), 4).alias("accuracy_rate"))


def accuracy(df: DataFrame) -> DataFrame:
    """One row over (truth_p, truth_d, p, d, confidence): accuracy by level among rows whose truth is known, and mean confidence.

    With columns truth_w and w, the ward's accuracy as well; with proximity or time_ms, their means."""
    tp, td = F.col("truth_p").isNotNull(), F.col("truth_d").isNotNull()
    same_p, same_d = F.col("p") == F.col("truth_p"), F.col("d") == F.col("truth_d")
    full = F.count_if(tp & td & same_p & same_d)
    return df.agg(
        F.count("*").alias("total"),
        ratio(F.count_if(tp & same_p), F.count_if(tp)).alias("province_accuracy"),
        ratio(F.count_if(td & same_d), F.count_if(td)).alias("district_accuracy"),
        ratio(full, F.count_if(tp & td)).alias("full_accuracy"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
        *([ratio(F.count_if(F.col("w") == F.col("truth_w")), F.count("truth_w")).alias("ward_accuracy")] if "truth_w" in df.columns else []),
        *(F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("proximity", "time_ms") if c in df.columns),
    )


def failures(df: DataFrame) -> DataFrame:
    """Counts of ways to fail: nothing found, wrong province, wrong district of the right province."""
    none = F.col("p").isNull()
    wrong = ~none & F.col("truth_p").isNotNull() & (F.col("p") != F.col("truth_p"))
    inner = ~none & ~F.coalesce(wrong, F.lit(False)) & F.col("truth_d").isNotNull() & ~F.col("d").eqNullSafe(F.col("truth_d"))
    return df.agg(F.count("*").alias("total"), F.count_if(none).alias("no_match"), F.count_if(wrong).alias("wrong_province"), F.count_if(inner).alias("wrong_district"))


def mapped_rate(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count(column).alias("mapped"), F.round(100 * ratio(F.count(column), F.count("*")), 4).alias("pct"))


def candidates_per_source(df: DataFrame, row: str, source: str) -> DataFrame:
    """How many candidates of a row came from each source."""
    return df.groupBy(row, source).agg(F.count("*").alias("candidates"))


def by_count(df: DataFrame, key: str) -> DataFrame:
    """Each value of ``key`` with its rows and its place in the order of these, most first, equals by value."""
    counts = df.groupBy(key).agg(F.count("*").alias("rows"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rows"), key)).cast("int"))
