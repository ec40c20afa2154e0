"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... and share 150 % of
all words.  A target stops at twice its source's size; what is over is shared again by
weight until no target is above (one pass over the sources ordered by cap over weight).

A source whose target is m + r times its size takes m certain whole copies of every
document.  The rest is an unequal-probability sample: a document's inclusion odds are
those of r, less for documents longer than four times their source's mean, and
documents are ranked by random odds divided by inclusion odds.  The sample is the
head of that order whose words fit what is left of the target; a histogram of ranks in
two levels finds its end, so no source is ever sorted or gathered in one task.  The
document outside the head that comes nearest to the missing words closes the gap.

The random number comes from an MD5 of seed and id, so reruns agree.

Defined cases: a null text has 0 words; a null source is a source of its own, the
last; rows that repeat an id share one random number and one decision; other columns
ride along unless they clash with the result's names, which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm._text import checkpointed

#: A word, the weights in turn, the share of all words, the largest multiple of a source, bins a level.
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, SHARE, MOST, BINS = (5, 2, 1), 1.5, 2, 4096
#: Facts of at most so many sources (a few kilobytes each thousand) go to every task; more are joined by a shuffle.
FEW_SOURCES = 10_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): one row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weigh).withColumn("cap", F.lit(most) * F.col("source_size"))
    # those below stop at their cap before the water reaches ratio
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    ahead = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("open", F.sum("weight").over(ahead.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("all", F.sum("source_size").over(every))
    s = s.withColumn("level", (F.lit(share) * F.col("all") - F.col("capped")) / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    return s.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))).drop("weight", "cap", "ratio", "capped", "open", "all", "level")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, carry: list[str] | None = None) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every row, and the ``carry`` columns."""
    carry = [c for c in carry or [] if c not in (id_col, "size", "source_size", "target", "copies", "taken")]
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    # the words are counted once; the search for the cut then reads ids, sources and sizes only
    slim = checkpointed(base.select("_id", "source", "size"))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    few = sizes.count() <= FEW_SOURCES
    plan = targets(sizes, weights=weights, share=share, most=most)
    plan = plan.withColumn("sure", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("left", F.when(F.col("source_size") > 0, F.col("target") - F.col("sure") * F.col("source_size")).otherwise(F.lit(0.0)))
    plan = plan.withColumn("r", F.when(F.col("source_size") > 0, F.col("left") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = plan.withColumn("long", 4.0 * F.col("source_size") / F.col("rows"))

    def ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
        out = rows.join(F.broadcast(plan) if few else plan, rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
        digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_id").cast("string"), F.lit("")))), 1, 12)
        u = (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 48)
        p = F.least(F.greatest(F.col("r") * F.least(F.lit(1.0), F.col("long") / F.greatest(F.col("size"), F.lit(1))), F.lit(1e-9)), F.lit(1 - 1e-9))
        rank = (u / (1 - u)) / (p / (1 - p))
        spot = F.least(F.floor(rank / (1 + rank) * float(BINS * BINS)), F.lit(BINS * BINS - 1))
        return out.withColumn("spot", spot).withColumn("coarse", F.floor(F.col("spot") / BINS))

    def edge(binned: DataFrame, by: str, before: Column | None) -> DataFrame:
        """The last bin of each source that still fits wholly, and the words up to it."""
        bins = binned.groupBy("source", by).agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first(before).alias("have") if before is not None else F.lit(0).cast("long").alias("have"))
        run = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("reach", F.col("have") + F.sum("words").over(run))
        over = F.min(F.when(F.col("reach") > F.col("left"), F.col(by)))
        fits = F.max(F.when(F.col("reach") <= F.col("left"), F.col("reach")))
        return bins.groupBy("source").agg(over.alias("over"), F.coalesce(fits, F.first("have")).alias("fits"))

    all_rows = ranked(slim, plan)
    first = edge(all_rows, "coarse", None).select(F.col("source").alias("s1"), F.col("over").alias("at"), F.col("fits").alias("fits1"))
    near = all_rows.join(F.broadcast(first) if few else first, F.col("source").eqNullSafe(F.col("s1"))).where("coarse = at")
    second = edge(near, "spot", F.col("fits1")).select(F.col("source").alias("s2"), F.col("over").alias("spot_over"), F.col("fits").alias("fits2"))
    cut = first.join(second, F.col("s1").eqNullSafe(F.col("s2")), "left").select(F.col("s1").alias("s"), F.coalesce("spot_over", F.lit(BINS * BINS)).alias("stop"), F.coalesce("fits2", "fits1").alias("fits"))
    plan = plan.join(cut, plan["source"].eqNullSafe(cut["s"])).drop("s").withColumn("gap", F.col("left") - F.col("fits"))
    # the nearest to the gap outside the head; a row only helps if it is shorter than twice the gap
    outside = ranked(slim, plan).where((F.col("spot") >= F.col("stop")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
    close = outside.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("d"), F.col("spot"), F.col("_id"))).alias("c"))
    plan = plan.join(close.select(F.col("source").alias("s3"), F.col("c._id").alias("closing"), F.lit(True).alias("has")), plan["source"].eqNullSafe(F.col("s3")), "left").drop("s3")
    out = ranked(base if carry else slim, plan)
    extra = (F.col("spot") < F.col("stop")) | (F.coalesce("has", F.lit(False)) & F.col("_id").eqNullSafe(F.col("closing")) & (F.col("size") > 0))
    copies = F.least(F.col("sure") + F.when(extra & (F.col("r") > 0), 1).otherwise(0), F.lit(most))
    out = out.withColumn("copies", copies.cast("long"))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"_c_{c}").alias(c) for c in carry])
