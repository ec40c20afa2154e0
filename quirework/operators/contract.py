"""The contract between a request and its response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as t


def rule(source: Column, translated: Column, protected: Column | None = None) -> Column:
    """The first broken rule: blank, placeholder or identical; null if the translation stands."""
    tags = t.placeholder_tags(source) if protected is None else protected
    a, b = t.trimmed(t.without_placeholders(source)), t.trimmed(t.without_placeholders(translated))
    return F.when(t.trimmed(translated) == "", "blank").when(F.exists(tags, lambda p: ~F.contains(translated, p)), "placeholder").when((a == b) & ~t.language_neutral(a), "identical")


def outcome(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, verdict, reason): requests (id, text), responses (id, ord, translated); the first response of an id counts, each later one is a duplicate."""
    first = Window.partitionBy("id").orderBy("ord")
    ranked = responses.withColumn("_r", F.row_number().over(first))
    kept, again = ranked.where("_r = 1").drop("_r"), ranked.where("_r > 1").select("id").withColumns({"verdict": F.lit("duplicate"), "reason": F.lit(None).cast("string")})
    both = requests.select("id", "text", F.lit(True).alias("asked")).join(kept, "id", "full_outer")
    broken = rule(F.col("text"), F.col("translated"))
    verdict = F.when(F.col("asked").isNull(), "unexpected").when(F.col("translated").isNull(), "missing").when(broken.isNotNull(), "rejected").otherwise("valid")
    reason = F.when(F.col("asked").isNotNull() & F.col("translated").isNotNull(), broken)
    return both.select("id", verdict.alias("verdict"), reason.alias("reason")).unionByName(again)
