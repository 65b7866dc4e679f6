"""Structured Streaming forms of the metric operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet") -> DataFrame:
    """Events as a stream of Parquet files; ``ts`` as a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_rates(events: DataFrame, key: str, hit, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """``(window, key, hits, total)`` in tumbling or sliding windows; rows later than ``late`` are dropped by the watermark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """``(window, key, events)`` of sessions that end after a pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("events"))


def run_updates(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Process everything that is there in update mode and return the last state of every key.

    State is dropped once the watermark has passed it. Each batch writes the keys it changed to a folder of its own below ``path``, again
    if it is run again, so nothing that is done is written twice; the reader keeps the newest row of a key.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    names = stream.columns
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = stream.sparkSession.read.schema(schema).option("basePath", path).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[n for n in names if n not in keys]), "batch").alias("_m")).select(*keys, "_m.*").select(*names)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that is there and return the complete result, which lies as a table below ``path``; for results of bounded size, as all state is kept."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_once_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that is there, append finished windows as Parquet below ``path`` and read them."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
