"""Continuous ingest: a file stream of documents into a content-addressed store, exactly once per content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.corpus import blobs_of, files_of, put_blobs


def ingest(spark: SparkSession, schema: StructType, source: str, store: str, checkpoint: str):
    """Run until what is there is read. Each batch adds the blobs that the store lacks; a batch that is run again after
    a failure overwrites its own folder, so it adds nothing twice."""

    def add(batch: DataFrame, epoch: int) -> None:
        new = blobs_of(files_of(batch))
        try:
            old = spark.read.schema(new.schema).parquet(*[f"{store}/batch={i}" for i in range(epoch)]) if epoch else new.limit(0)
        except Exception as e:  # a batch without rows wrote no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = new.limit(0)
        put_blobs(old, new).write.mode("overwrite").parquet(f"{store}/batch={epoch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling event-time windows; also on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
