"""A streaming face: addresses normalised as they come, ratings folded into a table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placeweave.functions import text as T
from placeweave.operators import review
from placeweave.operators.gazetteer import Gazetteer
from placeweave.operators.resolve import resolve


def normalized_stream(stream: DataFrame, address: str = "address") -> DataFrame:
    """Stateless: the same columns that the batch resolver starts from."""
    return stream.withColumn("norm", T.normalize_address(F.col(address)))


def resolve_stream(stream: DataFrame, gazetteer: Gazetteer, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch goes through the batch resolver and lands as Parquet under its batch id, so a batch that runs again
    replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        resolve(batch, gazetteer).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ratings_by_window(stream: DataFrame, minutes: int = 10, late: int = 30) -> DataFrame:
    """Tumbling windows over (ts, user_rating): counts by rating, for rows at most ``late`` minutes late."""
    rows = stream.withWatermark("ts", f"{late} minutes").groupBy(F.window("ts", f"{minutes} minutes"))
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col("user_rating") == r).alias(f"rating_{r}") for r in review.RATINGS))


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: list[str], order: str = "ts") -> StreamingQuery:
    """Keeps the latest row of each key in one Parquet table per version; version n holds batches 0 to n."""

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = review.upsert_latest(batch, key, [F.desc(order)])
        if batch_id:
            last = review.upsert(spark.read.parquet(f"{target}/version={batch_id - 1}"), last, key)
        last.write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
