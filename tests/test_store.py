"""Batches are appended once, together, whatever breaks off."""

import pytest
from pyspark.sql import functions as F

from quirework.sources.store import Store, WrongColumns

USAGE = "id long, job_id string, provider string, model string, input_tokens long, output_tokens long, date_key string, month_key string, created_at timestamp"


def usage(spark, ids):
    return spark.range(1).select(F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("id")).selectExpr("id", "'j' AS job_id", "'mock' AS provider", "'m' AS model", "id * 10 AS input_tokens", "id * 12 AS output_tokens", "'2026-01-02' AS date_key", "'2026-01' AS month_key", "timestamp'2026-01-02 03:04:05' AS created_at")


def cached(spark, ids):
    return usage(spark, ids).selectExpr("'k' || id AS cache_key", "'t' || id AS translated_text", "created_at")


def ids(store, name="usage_ledger", column="id"):
    return sorted(r[0] for r in store.read(name).select(column).collect())


def test_a_batch_is_there_once_and_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert ids(store) == []
    assert store.append("a-1", usage_ledger=usage(spark, [1, 2]), translation_cache=cached(spark, [1]))
    assert not store.append("a-1", usage_ledger=usage(spark, [1, 2]))
    # the second table breaks after the first is written: nothing of the batch shows, and its next attempt replaces it
    broken = cached(spark, [3]).withColumn("translated_text", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="translated_text is null"):
        store.append("a-2", usage_ledger=usage(spark, [3, 99]), translation_cache=broken)
    assert ids(store) == [1, 2] and ids(store, "translation_cache", "cache_key") == ["k1"]
    assert store.append("a-2", usage_ledger=usage(spark, [3]), translation_cache=cached(spark, [3]))
    assert ids(store) == [1, 2, 3] and ids(store, "translation_cache", "cache_key") == ["k1", "k3"]
    assert store.read("usage_ledger").columns[-1] == "batch"


def test_columns_are_those_of_the_relation(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(WrongColumns, match="absent"):
        store.append("b", usage_ledger=usage(spark, [1]).drop("model"))
    with pytest.raises(WrongColumns, match="unknown"):
        store.append("b", usage_ledger=usage(spark, [1]).withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError, match="batch id"):
        store.append("../b")


def test_a_stream_that_is_cut_off_leaves_the_same_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    fails = {"left": 2}

    def tables(frame):
        rows = {"usage_ledger": frame, "translation_cache": frame.selectExpr("'k' || id AS cache_key", "'t' || id AS translated_text", "created_at")}
        if fails["left"]:
            fails["left"] -= 1
            rows["translation_cache"] = rows["translation_cache"].withColumn("translated_text", F.raise_error(F.lit("cut off")))
        return rows

    def go():
        stream = spark.readStream.schema(USAGE).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(store.sink("usage", tables)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        usage(spark, range(10 * k, 10 * k + 10)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    for _ in range(2):
        with pytest.raises(Exception, match="cut off"):
            go()
        assert ids(store) == []
    go()
    go()
    assert ids(store) == list(range(30)) and len(ids(store, "translation_cache", "cache_key")) == 30
