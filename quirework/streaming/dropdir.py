"""Extension: a drop directory of archives as a stream, processed once each.

Arrivals become entries and blocks; ``available_now`` drains what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.sources import epub

FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.epub").load(path)


def run_available(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Append the entries of every archive not seen before to a parquet table."""

    def batch(frame: DataFrame, number: int) -> None:
        epub.unpacked(frame.select(F.col("path").alias("book"), F.col("content").alias("data"))).write.mode("append").parquet(out)

    arrivals(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

