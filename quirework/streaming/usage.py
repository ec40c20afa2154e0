"""The usage ledger as a stream: calendar days of a zone, late and repeated entries, restarts.

An entry counts on the day of its local time.  One that comes again (an id seen within the time that
entries may be late) does not count twice; one that comes after its day was closed does not count at
all, and is told in Spark's own count of dropped rows.  A day is given out once, when no entry of it can come any more.
State is a sum a job and open day, and the ids of the time that entries may be late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def days(entries: DataFrame, zone: str = "UTC", late: str = "1 hour", key: str = "id") -> DataFrame:
    """(day, month, job_id, entries, tokens_in, tokens_out) of a stream or table of (id, job_id, tokens_in, tokens_out, ts): ts is UTC."""
    local = entries.withColumn("local", F.from_utc_timestamp("ts", zone))
    if entries.isStreaming:
        local = local.withWatermark("local", late).dropDuplicatesWithinWatermark([key])
    else:
        local = local.dropDuplicates([key])
    out = local.groupBy(F.window("local", "1 day").alias("w"), "job_id").agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), F.date_format("w.start", "yyyy-MM").alias("month"), "job_id", "entries", "tokens_in", "tokens_out")


def run_available(entries: DataFrame, out: str, checkpoint: str, zone: str = "UTC", late: str = "1 hour") -> StreamingQuery:
    """Take what is there, append the days that closed to a parquet table, and stop; the next run goes on from the checkpoint."""
    query = days(entries, zone, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
