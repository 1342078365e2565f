"""Incremental placement: landmark rows that arrive in a stream are placed against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import placement


def place_stream(landmarks: DataFrame, index: tuple[DataFrame, DataFrame], metadata: DataFrame, out: str, checkpoint: str, min_tags: int = 3, min_pairs: int = 2, most: int = 5, once: bool = False) -> StreamingQuery:
    """Place each micro-batch's queries and append the results, with the batch's number, to Parquet.

    A query's landmarks must arrive in one batch (write a file for each query). The batch's folder is
    overwritten when it is retried, so a restart neither loses nor doubles results."""

    def place(batch: DataFrame, number: int) -> None:
        queries = placement.query_landmarks(batch)
        lengths = queries.groupBy("q").agg((F.max("gpos") - F.min("gpos") + 1).alias("length"))
        ranked = placement.search(queries, index, lengths, min_tags, min_pairs, most)
        placement.placements(ranked, queries, metadata).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = landmarks.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def gap_alerts(landmarks: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Landmarks of each series by time window, with late rows up to ``late`` still counted."""
    return landmarks.withWatermark(time, late).groupBy(F.window(time, window), "genome").agg(F.count(F.lit(1)).alias("tags"), F.approx_count_distinct("seq").alias("kinds"))
