"""Runs: pluggable translation, cache split, contract, outcomes and reports as DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as t
from quirework.operators import contract


class Translator(ABC):
    """The pluggable function: rows (id, text) in, rows (id, ord, translated) out; ids are matched, never places."""

    provider, model = "abstract", "none"

    @abstractmethod
    def translate(self, segments: DataFrame, source: str, target: str) -> DataFrame: ...


class MockTranslator(Translator):
    """Offline and deterministic: the text behind the target language's tag."""

    provider, model = "mock", "mock-1"

    def translate(self, segments: DataFrame, source: str, target: str) -> DataFrame:
        return segments.select("id", F.lit(0).alias("ord"), F.concat(F.lit(f"[{target.upper()}] "), F.col("text")).alias("translated"))


TRANSLATORS: dict[str, type[Translator]] = {"mock": MockTranslator}


def run(segments: DataFrame, cache: DataFrame, translator: Translator, source: str, target: str) -> DataFrame:
    """(id, text, cache_key, status, translated, reason, from_cache) of segments (id, text): cached ones are not sent."""
    key: Column = t.cache_key(F.lit(source), F.lit(target), F.lit(translator.provider), F.lit(translator.model), t.normalized(F.col("text")))
    keyed = segments.withColumn("cache_key", key)
    # the last write of a key counts
    last = cache.groupBy("cache_key").agg(F.max_by("translated_text", "created_at").alias("cached"))
    looked = keyed.join(last, "cache_key", "left")
    hits = looked.where("cached is not null").select("id", "text", "cache_key", F.lit("TRANSLATED").alias("status"), F.col("cached").alias("translated"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("from_cache"))
    sent = looked.where("cached is null").select("id", "text", "cache_key")
    replies = translator.translate(sent.select("id", "text"), source, target)
    verdicts = contract.outcome(sent.select("id", "text"), replies).where("verdict in ('valid', 'rejected', 'missing')")
    first = replies.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_r = 1").select("id", "translated")
    made = sent.join(verdicts, "id").join(first, "id", "left")
    ok = F.col("verdict") == "valid"
    made = made.select("id", "text", "cache_key", F.when(ok, "TRANSLATED").otherwise("FAILED").alias("status"), F.when(ok, F.col("translated")).alias("translated"), F.when(~ok, F.coalesce("reason", "verdict")).alias("reason"), F.lit(False).alias("from_cache"))
    return hits.unionByName(made)


def totals(outcomes: DataFrame) -> DataFrame:
    """One row: processed, translated, failed, cache hits, tokens in and out."""
    sent = ~F.col("from_cache")
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("status") == "TRANSLATED").alias("translated"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if("from_cache").alias("cache_hits"),
        F.coalesce(F.sum(F.when(sent, t.estimated_tokens(F.col("text")))), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum(F.when(sent & F.col("translated").isNotNull(), t.estimated_tokens(F.col("translated")))), F.lit(0)).alias("output_tokens"),
    )


def reports(facts: DataFrame, segments: DataFrame, issues: DataFrame) -> DataFrame:
    """(job_id, path, report): the report of each job as indented JSON, and where it lies: beside the book.

    ``facts``: (job_id, input_path, output_path, source_language, target_language, display_order, provider, model, created_at,
    completed_at); ``segments``: (job_id, id, chapter_path, at, status, error_message, input_tokens, output_tokens);
    ``issues``: (job_id, at, code, message).  A report lists its failures and issues, in order.
    """
    is_ = lambda s: F.count_if(F.col("status") == s)
    failure = F.when(F.col("status") == "FAILED", F.struct("at", F.struct("id", F.col("chapter_path").alias("chapterPath"), F.col("error_message").alias("errorMessage")).alias("x")))
    done = segments.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), is_("TRANSLATED").alias("ok"), is_("FAILED").alias("bad"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.array_sort(F.collect_list(failure)).alias("failures"))
    found = issues.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", F.struct("code", "message").alias("x")))).alias("issues"))
    rows = facts.join(done, "job_id", "left").join(found, "job_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = lambda c, kind: F.coalesce(F.transform(c, lambda y: y["x"]), F.array().cast(kind))
    fields = [
        F.col("job_id").alias("jobId"), F.col("input_path").alias("sourceFile"), F.col("output_path").alias("outputFile"), F.col("source_language").alias("sourceLanguage"), F.col("target_language").alias("targetLanguage"), F.col("display_order").alias("displayOrder"),
        zero("n").alias("totalSegments"), zero("ok").alias("translatedSegments"), zero("bad").alias("failedSegments"), zero("i").alias("inputTokens"), zero("o").alias("outputTokens"), "provider", "model", F.col("created_at").alias("startedAt"), F.col("completed_at").alias("completedAt"),
        each("failures", "array<struct<id:string,chapterPath:string,errorMessage:string>>").alias("failures"), each("issues", "array<struct<code:string,message:string>>").alias("validationIssues"),
    ]
    report = F.to_json(F.struct(*fields), {"pretty": "true", "ignoreNullFields": "false"})
    return rows.select("job_id", F.concat("output_path", F.lit(".report.json")).alias("path"), report.alias("report"))
