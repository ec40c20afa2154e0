"""Blocks, reading order, segments and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as t

#: Rows a bucket of running offsets: bounds what one task sorts.
BUCKET = 4096


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, keep..., line_no, text): each non-blank line is a block."""
    parts = docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return parts.where(t.trimmed(F.col("line")) != "").select("doc_id", *keep, "line_no", t.trimmed(F.col("line")).alias("text"))


def running(rows: DataFrame, group: list[str], order: str, sizes: dict[str, str]) -> DataFrame:
    """Adds, for each (name, column) of ``sizes``, the running total of the column ahead of each row of its group, by an integer order.

    Two levels: totals of order buckets are summed first (few rows a group), then within
    buckets, so a group with a third of all rows is still dealt over many tasks.  Null groups
    and orders count as values, the null order as the last.
    """
    rows = rows.withColumn("_b", F.floor(F.col(order) / BUCKET))
    totals = rows.groupBy(*group, "_b").agg(*[F.sum(c).alias(f"_n_{name}") for name, c in sizes.items()])
    ahead = Window.partitionBy(*group).orderBy(F.asc_nulls_last("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_n_{name}").over(ahead), F.lit(0)).alias(f"_before_{name}") for name in sizes]
    totals = totals.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_b").alias("_of"), *before)
    on = F.col("_b").eqNullSafe(F.col("_of"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    within = Window.partitionBy(*group, "_b").orderBy(F.asc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(totals, on)
    out = out.withColumns({name: F.col(f"_before_{name}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sizes.items()})
    return out.drop("_b", "_of", *[f"_before_{name}" for name in sizes], *[f"_g_{g}" for g in group])


def with_offsets(rows: DataFrame, group: str, order: str, size: str, out: str) -> DataFrame:
    return running(rows, [group], order, {out: size})


def chapters(docs: DataFrame) -> DataFrame:
    """(book, chapter, blocks) of each row: a book is a source, a chapter a document, a block a non-blank line."""
    blocks = F.filter(F.transform(F.split("text", "\n"), t.trimmed), lambda x: x != "")
    return docs.select(F.coalesce("source", F.lit("")).alias("book"), F.col("doc_id").alias("chapter"), F.coalesce(blocks, F.array().cast("array<string>")).alias("blocks"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(book, chapter, chapter_index, text, tokens): segments without their place in the book; nothing is shuffled."""
    rows = chapters(docs).select("book", "chapter", F.posexplode("blocks").alias("at", "text"))
    return rows.select("book", "chapter", (F.col("at") + 1).cast("long").alias("chapter_index"), "text", estimate(F.col("text"), F.col("chapter")).alias("tokens"))


def estimate(text: Column, chapter: Column) -> Column:
    return t.estimated_tokens(text, F.concat(F.lit("ch"), F.coalesce(chapter.cast("string"), F.lit(""))))


def segments(docs: DataFrame) -> DataFrame:
    """(book, chapter, order_index, chapter_index, text, tokens): ``paragraphs`` with their place in the book.

    Chapters come in order of their ids, a null id last.  Rows that share an id are chapters
    of their own, in order of a hash of their blocks.
    """
    own = chapters(docs)
    # offsets come from counts alone; texts are read once more, and never sorted
    facts = own.groupBy("book", "chapter").agg(F.sum(F.size("blocks").cast("long")).alias("n"), F.count(F.lit(1)).alias("rows"))
    first = with_offsets(facts, "book", "chapter", "n", "first").select(F.col("book").alias("_book"), F.col("chapter").alias("_chapter"), "first", "rows")
    placed = own.join(first, F.col("book").eqNullSafe(F.col("_book")) & F.col("chapter").eqNullSafe(F.col("_chapter"))).drop("_book", "_chapter")
    ahead = Window.partitionBy("book", "chapter").orderBy(F.xxhash64("blocks"), F.size("blocks")).rowsBetween(Window.unboundedPreceding, -1)
    again = placed.where("rows > 1").withColumn("first", F.col("first") + F.coalesce(F.sum(F.size("blocks")).over(ahead), F.lit(0)))
    rows = placed.where("rows = 1").unionByName(again).select("book", "chapter", "first", F.posexplode("blocks").alias("at", "text"))
    return rows.select("book", "chapter", (F.col("first") + F.col("at")).alias("order_index"), (F.col("at") + 1).cast("long").alias("chapter_index"), "text", estimate(F.col("text"), F.col("chapter")).alias("tokens"))


def target(limit: int, margin: float) -> int:
    return max(1, int(limit * (1 - margin / 100)))


def packs(tokens: Column, most: int) -> Column:
    """Pack number of each element of an ordered token array: a new pack when the next would exceed ``most``.

    A fold, since where a pack starts depends on where the one before ended; it keeps the
    lengths of finished packs only, so an array is not copied at every element.
    """
    zero = F.struct(F.lit(0).cast("long").alias("have"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["have"] > 0) & (acc["have"] + x > most)
        have, n = F.when(new, x).otherwise(acc["have"] + x), F.when(new, F.lit(1)).otherwise(acc["n"] + 1)
        return F.struct(have.cast("long").alias("have"), n.alias("n"), F.when(new, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"]).alias("out"))

    lengths = F.aggregate(tokens, zero, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["out"], F.array(acc["n"]))).otherwise(acc["out"]))
    return F.flatten(F.transform(lengths, lambda n, k: F.array_repeat(k.cast("long"), n)))


def batches(docs: DataFrame, limit: int = 400, margin: float = 20.0) -> DataFrame:
    """(chapter, chapter_index, tokens, batch): greedy packing of each document's blocks, which never mix chapters."""
    path = F.concat(F.lit("ch"), F.col("doc_id").cast("string"))
    blocks = F.filter(F.transform(F.split("text", "\n"), t.trimmed), lambda x: x != "")
    tokens = F.transform(blocks, lambda x: t.estimated_tokens(x, path))
    packed = docs.select(F.col("doc_id").alias("chapter"), tokens.alias("tok")).withColumn("no", packs(F.col("tok"), target(limit, margin)))
    return packed.select("chapter", F.posexplode(F.arrays_zip("tok", "no")).alias("at", "x")).select("chapter", (F.col("at") + 1).cast("long").alias("chapter_index"), F.col("x.tok").alias("tokens"), F.col("x.no").alias("batch"))


def islands(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Adds ``run``: contiguous stretches of a value within a group; a value seen again later is a new run."""
    w = Window.partitionBy(group).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return rows.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")
