"""A stream of rainfall readings, upserted into the station table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rillflow.operators.rain import upsert

SCHEMA = "id long, duration int, probability int, mm_x10 long, version long"
KEYS = ["id", "duration", "probability"]


def readings(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(path)


def upsert_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``target`` at the newest value of each key.

    Each batch writes a new version beside the last, ``target/v=<batch>``, and readers take the
    highest one, so a batch that is run again after a failure writes the same version again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(SCHEMA).parquet(f"{target}/v={number - 1}") if number else spark.createDataFrame([], SCHEMA)
        upsert(old, batch, KEYS, "version").write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
