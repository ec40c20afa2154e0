"""Queries over pages as XHTML documents; Python markup operators, so no SQL says the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as t
from quirework.operators import markup
from quirework.sources import epub


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.lit("site").alias("book"), F.col("page_id").cast("int").alias("ord"), F.regexp_replace("url", "^https?://", "").alias("path"), F.col("html").alias("content"))


def page_blocks(spark, sf_dir):
    return epub.blocks(pages(spark, sf_dir)).select(F.col("ord").alias("page_id"), "at", "tag", "locator", "text")


def page_blocks_html(spark, sf_dir):
    """The labelled option: paragraphs and items close as in browsers."""
    return epub.blocks(pages(spark, sf_dir), html_mode=True).select(F.col("ord").alias("page_id"), "at", "tag", "locator", "text")


def page_placeholders(spark, sf_dir):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for page, content in zip(frame.page_id, frame.content, strict=True):
                for k, n in enumerate(markup.leaves(markup.parse(content))):
                    text, table = markup.placeholders(n)
                    rows.append((page, k, text, len(table), markup.rebuilt(text, table)))
            yield pd.DataFrame(rows, columns=["page_id", "at", "text", "inline", "rebuilt"])

    return pages(spark, sf_dir).select(F.col("ord").alias("page_id"), "content").mapInPandas(run, "page_id int, at int, text string, inline int, rebuilt string")


def page_wellformed(spark, sf_dir):
    return pages(spark, sf_dir).select(F.col("ord").alias("page_id"), epub.fault(F.col("content")).alias("fault"))


def page_links(spark, sf_dir):
    """Internal links without a page, and fragments without an anchor."""
    p = pages(spark, sf_dir)
    refs = epub.references(p)
    links, anchors = refs.where("kind = 'link'"), refs.where("kind = 'anchor'").select("target", "fragment")
    there = p.select(F.col("path").alias("target"))
    dead = links.join(there, "target", "left_anti").select("path", "target", F.lit("UNRESOLVED_LINK").alias("code"))
    lost = links.where("fragment is not null").join(there, "target", "left_semi").join(anchors, ["target", "fragment"], "left_anti")
    return dead.unionByName(lost.select("path", "target", F.lit("UNRESOLVED_ANCHOR").alias("code")))


def page_render(spark, sf_dir):
    """Every page with mock translations beside its blocks."""

    @F.pandas_udf("string")
    def render(content: pd.Series) -> pd.Series:
        return content.map(lambda c: markup.rendered(c, [f"[FR] {markup.inner(n)}" for n in markup.leaves(markup.parse(c))], "en", "fr"), na_action="ignore")

    return pages(spark, sf_dir).select(F.col("ord").alias("page_id"), render("content").alias("html"))


def book_issues(spark, sf_dir):
    """Pages bound into one book a language group, packed, read again and validated."""
    return epub.issues(bound(spark, sf_dir))


def book_verdicts(spark, sf_dir):
    return epub.verdicts(bound(spark, sf_dir))


def book_reading_order(spark, sf_dir):
    return epub.reading_order(bound(spark, sf_dir)).select("book", "ord", "path", F.length("content").alias("chars"))


def chapter_drafts(spark, sf_dir):
    """Segments of book chapters, from their blocks: ids, checksums and placeholder texts."""
    return epub.drafts(epub.blocks(epub.reading_order(bound(spark, sf_dir)))).select("book", "id", "order_index", "path", "tag", "locator", "checksum", "placeholder_text")


def book_render(spark, sf_dir):
    """Bilingual books from mock replies to placeholder texts, every third block without one, every fifth without its placeholders: digests of all entries."""
    entries = bound(spark, sf_dir)
    blocks = epub.blocks(epub.reading_order(entries))
    reply = F.when(F.col("at") % 5 == 4, t.without_placeholders(F.col("placeholder_text"))).otherwise(F.col("placeholder_text"))
    replies = blocks.where("at % 3 <> 2").select("book", "path", "at", F.concat(F.lit("[FR] "), reply).alias("translated"))
    made = epub.translated(entries, epub.resolved(blocks, replies), "en", "fr")
    return made.select("book", "ord", "path", F.sha2("data", 256).alias("digest"))


def bound(spark, sf_dir):
    """Entries of books made of 25 pages each, after a round trip through archives."""

    def bind(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page_id")
        items = [(f"p{i}", f"text/{i}.xhtml", c) for i, c in zip(frame.page_id, frame.html, strict=True)]
        opf = "<package><manifest>" + "".join(f'<item id="{i}" href="{h}" media-type="application/xhtml+xml"/>' for i, h, _ in items) + "</manifest><spine>" + "".join(f'<itemref idref="{i}"/>' for i, _, _ in items) + "</spine></package>"
        container = '<container><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
        entries = [("mimetype", epub.MIMETYPE.encode()), ("META-INF/container.xml", container.encode()), ("OEBPS/content.opf", opf.encode()), *[(f"OEBPS/{h}", c.encode()) for _, h, c in items]]
        return pd.DataFrame({"book": [f"book-{frame.book.iloc[0]}"], "data": [epub.pack(entries)]})

    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.floor(F.col("page_id") / 25).cast("string").alias("book"), "page_id", F.coalesce("html", F.lit("")).alias("html"))
    return epub.unpacked(p.groupBy("book").applyInPandas(bind, "book string, data binary"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (page_blocks, page_blocks_html, page_placeholders, page_wellformed, page_links, page_render, book_issues, book_verdicts, book_reading_order, chapter_drafts, book_render)}
