"""Packaged books: a safe reader, package documents, reading order, a deterministic writer, renaming, and validation.

Archives are read from ``binaryFile`` and unpacked in Arrow batches; everything after
that is joins over (book, path) relations.
"""

from __future__ import annotations

import io
import posixpath
import re
import unicodedata
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirework.functions.text import ACCENT, EXTERNAL, SAFE_PATH, UNSAFE, checksum, normalized, segment_id, trimmed
from quirework.operators import lookups, markup, segments

MIMETYPE = "application/epub+zip"
ENTRIES = "book string, ord int, path string, data binary, stored boolean, error string"


@dataclass(frozen=True)
class Limits:
    """Most bytes in, bytes out and entries of an archive."""

    archive: int = 100 << 20
    unpacked: int = 500 << 20
    entries: int = 10_000


class UnsafeArchive(ValueError):
    code = "UNSAFE_ARCHIVE"


def checked(infos: list[zipfile.ZipInfo], limits: Limits) -> list[zipfile.ZipInfo]:
    """The files of a central directory, in order; raises UnsafeArchive, before a byte of them is read."""
    if len(infos) > limits.entries:
        raise UnsafeArchive("too many entries")
    out, total = [], 0
    for i in infos:
        name = i.orig_filename
        if not name or "\0" in name or name.startswith("/") or re.match(r"[A-Za-z]:", name) or ".." in name.split("/"):
            raise UnsafeArchive(f"unsafe path {name!r}")
        if i.create_system == 3 and (i.external_attr >> 16) & 0o170000 == 0o120000:
            raise UnsafeArchive(f"symbolic link {name}")
        if name.endswith("/"):
            continue
        total += i.file_size
        if total > limits.unpacked:
            raise UnsafeArchive("unpacked size too large")
        out.append(i)
    return out


def unpack(data: bytes, limits: Limits = Limits()) -> list[tuple[str, bytes, bool]]:
    """(path, bytes, stored) of each file, in archive order; raises UnsafeArchive."""
    if len(data) > limits.archive:
        raise UnsafeArchive("archive too large")
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(i.orig_filename, z.read(i), i.compress_type == zipfile.ZIP_STORED) for i in checked(z.infolist(), limits)]
    except UnsafeArchive:
        raise
    except Exception as e:
        raise UnsafeArchive(str(e)) from e


def pack(entries: list[tuple[str, bytes]]) -> bytes:
    """Deterministic bytes: mimetype first and stored, the rest deflated, one date and mode."""
    if not any(p == "mimetype" for p, _ in entries):
        raise ValueError("no mimetype entry")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, data in sorted(entries, key=lambda e: e[0] != "mimetype"):
            info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            info.create_system, info.external_attr = 3, 0o100644 << 16
            info.compress_type = zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def read(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Entries of every archive below a path; an unsafe one gives a single row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
    return unpacked(files.select(F.col("path").alias("book"), F.col("content").alias("data")), limits)


def unpacked(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for book, data in zip(frame.book, frame.data, strict=True):
                try:
                    rows = [(book, k, p, d, s, None) for k, (p, d, s) in enumerate(unpack(bytes(data), limits))]
                except UnsafeArchive as e:
                    rows = [(book, None, None, None, None, str(e))]
                # an archive without a file is still a book
                rows = rows or [(book, None, None, None, None, None)]
                yield pd.DataFrame(rows, columns=["book", "ord", "path", "data", "stored", "error"])

    return files.mapInPandas(run, ENTRIES)


def text_of(data: Column) -> Column:
    """Bytes as UTF-8; what is none becomes replacement characters, and never fails the books beside it."""
    return F.make_valid_utf8(data.cast("string"))


def package(entries: DataFrame) -> DataFrame:
    """(book, kind, ord, id, href, media_type, linear, opf): manifest items (href resolved), spine references, or one fault.

    A fault (code in id, detail in href) stands for the whole package: a container or
    package document that is missing, a container without a path, an item or reference
    without what it must have, an href that leaves the archive.
    """
    readable = entries.where("error is null")
    books = readable.select("book").distinct()
    container = readable.where("path = 'META-INF/container.xml'").select("book", text_of(F.col("data")).alias("xml"))
    named = books.join(container, "book", "left").select("book", F.col("xml").isNotNull().alias("has"), root_file("xml").alias("opf"))
    docs = named.join(readable.select("book", F.col("path").alias("opf"), "data"), ["book", "opf"], "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for book, has, opf, data in zip(frame.book, frame.has, frame.opf, frame.data, strict=True):
                try:
                    if not has:
                        raise BrokenBook("MANIFEST_RESOLUTION", "container.xml not found")
                    if not opf:
                        raise BrokenBook("INVALID_EPUB", "container.xml names no package document")
                    if data is None:
                        raise BrokenBook("MANIFEST_RESOLUTION", f"package document not found: {opf}")
                    rows += [(book, *r, opf) for r in items_of(bytes(data).decode("utf-8", "replace"), opf)]
                except BrokenBook as e:
                    rows.append((book, "fault", 0, e.code, str(e), None, None, opf))
            yield pd.DataFrame(rows, columns=["book", "kind", "ord", "id", "href", "media_type", "linear", "opf"])

    return docs.select("book", "has", "opf", "data").mapInPandas(run, "book string, kind string, ord int, id string, href string, media_type string, linear boolean, opf string")


class BrokenBook(ValueError):
    """A book that cannot be read; ``code`` is stable."""

    def __init__(self, code: str, detail: str):
        super().__init__(detail)
        self.code = code


@F.pandas_udf(StringType())
def root_file(xml: pd.Series) -> pd.Series:
    def first(text: str) -> str | None:
        node = next((n for n in markup.parse(text).elements() if n.name.split(":")[-1] == "rootfile"), None)
        return node.get("full-path") if node is not None else None

    return xml.map(first, na_action="ignore")


def items_of(opf: str, path: str) -> list[tuple]:
    """(kind, ord, id, href, media type, linear) of a package document."""
    rows, base = [], posixpath.dirname(path)
    for n in markup.parse(opf).elements():
        up = n.parent.name.split(":")[-1]
        if n.name.split(":")[-1] == "item" and up == "manifest":
            key, href, kind = n.get("id"), n.get("href"), n.get("media-type")
            if not (key and href and kind):
                raise BrokenBook("MANIFEST_RESOLUTION", "a manifest item lacks id, href or media-type")
            target = posixpath.normpath(posixpath.join(base, href.split("#")[0]))
            if target.startswith(".."):
                raise BrokenBook("MANIFEST_RESOLUTION", f"href leaves the archive: {href}")
            rows.append(("manifest", len(rows), key, target, kind, None))
        elif n.name.split(":")[-1] == "itemref" and up == "spine":
            if not n.get("idref"):
                raise BrokenBook("MANIFEST_RESOLUTION", "a spine reference lacks idref")
            rows.append(("spine", len(rows), n.get("idref"), None, None, n.get("linear") != "no"))
    return rows


def mime_faults(entries: DataFrame) -> DataFrame:
    """(book, at, code, detail) of what is wrong with the mimetype entry."""
    files = entries.where("error is null")
    first = files.groupBy("book").agg(F.min_by("path", "ord").alias("first"), F.max(F.when(F.col("path") == "mimetype", F.struct(F.col("stored"), trimmed(text_of(F.col("data"))).alias("text")))).alias("m"))
    found = F.array_compact(F.array(
        F.when(~F.col("first").eqNullSafe(F.lit("mimetype")), F.struct(F.lit(1).alias("at"), F.lit("MIMETYPE_NOT_FIRST").alias("code"))),
        F.when(F.col("m").isNull(), F.struct(F.lit(2).alias("at"), F.lit("MIMETYPE_MISSING").alias("code"))),
        F.when(~F.col("m.stored"), F.struct(F.lit(3).alias("at"), F.lit("MIMETYPE_COMPRESSED").alias("code"))),
        F.when(F.col("m.text") != MIMETYPE, F.struct(F.lit(4).alias("at"), F.lit("MIMETYPE_INVALID_CONTENT").alias("code"))),
    ))
    return first.select("book", F.explode(found).alias("x")).select("book", "x.at", "x.code", F.lit(None).cast("string").alias("detail"))


def refusals(entries: DataFrame) -> DataFrame:
    """(book, code, detail): the first reason not to read a book at all."""
    parts = package(entries)
    unsafe = entries.where("error is not null").select("book", F.lit(0).alias("at"), F.lit("UNSAFE_ARCHIVE").alias("code"), F.col("error").alias("detail"))
    mime = mime_faults(entries).where("code <> 'MIMETYPE_COMPRESSED'").select("book", "at", F.lit("INVALID_EPUB").alias("code"), F.col("code").alias("detail"))
    fault = parts.where("kind = 'fault'").select("book", F.lit(5).alias("at"), F.col("id").alias("code"), F.col("href").alias("detail"))
    spine = parts.where("kind = 'spine' and linear").select("book", "id")
    items = parts.where("kind = 'manifest'").select("book", "id", F.col("href").alias("path"))
    unknown = spine.join(items, ["book", "id"], "left_anti").select("book", F.lit(6).alias("at"), F.lit("MANIFEST_RESOLUTION").alias("code"), F.concat(F.lit("spine names no item: "), "id").alias("detail"))
    absent = spine.join(items, ["book", "id"]).join(entries.select("book", "path"), ["book", "path"], "left_anti").select("book", F.lit(7).alias("at"), F.lit("MANIFEST_RESOLUTION").alias("code"), F.concat(F.lit("no such document: "), "path").alias("detail"))
    every = unsafe.unionByName(mime).unionByName(fault).unionByName(unknown).unionByName(absent)
    return every.groupBy("book").agg(F.min(F.struct("at", "code", "detail")).alias("x")).select("book", "x.code", "x.detail")


def checksums(files: DataFrame) -> DataFrame:
    """(book, input_checksum, archive): the digest of each input, and whether it begins as an archive does."""
    return files.select("book", F.sha2("data", 256).alias("input_checksum"), F.startswith("data", F.lit(b"PK")).alias("archive"))


def reading_order(entries: DataFrame) -> DataFrame:
    """(book, ord, path, content): linear spine documents in order, of the books that ``refusals`` does not name."""
    parts = package(entries)
    spine = parts.where("kind = 'spine' and linear").select("book", "ord", "id")
    # of items with one id the last one counts
    items = parts.where("kind = 'manifest'").groupBy("book", "id").agg(F.max_by("href", "ord").alias("path"))
    good = spine.join(refusals(entries), "book", "left_anti")
    return good.join(items, ["book", "id"]).join(entries.select("book", "path", "data"), ["book", "path"]).select("book", "ord", "path", text_of(F.col("data")).alias("content"))


def blocks(documents: DataFrame, html_mode: bool = False) -> DataFrame:
    """(book, ord, path, at, tag, locator, html, text, placeholder_text) of every translatable block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for book, ord_, path, content in zip(frame.book, frame.ord, frame.path, frame.content, strict=True):
                for k, n in enumerate(markup.leaves(markup.parse(content, html_mode))):
                    rows.append((book, ord_, path, k, n.name, markup.locator(n), markup.inner(n), n.content().strip(), markup.placeholders(n)[0]))
            yield pd.DataFrame(rows, columns=["book", "ord", "path", "at", "tag", "locator", "html", "text", "placeholder_text"])

    return documents.select("book", F.col("ord").cast("int").alias("ord"), "path", "content").mapInPandas(run, "book string, ord int, path string, at int, tag string, locator string, html string, text string, placeholder_text string")


def drafts(blocks: DataFrame) -> DataFrame:
    """Adds order_index (from 0, over the book), chapter_index (from 1), id and checksum to blocks."""
    place = segments.with_offsets(blocks.groupBy("book", "path").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n")), "book", "ord", "n", "first").select("book", "path", "first")
    number = F.row_number().over(Window.partitionBy("book", "path").orderBy("ord", "at"))
    rows = blocks.withColumn("chapter_index", number).join(place, ["book", "path"])
    normal = rows.withColumn("normal", normalized(F.col("text")))
    return normal.withColumn("order_index", F.col("first") + F.col("chapter_index") - 1).withColumn("id", segment_id(F.col("path"), F.col("chapter_index"), F.col("normal"))).withColumn("checksum", checksum(F.col("normal"))).drop("first", "normal")


def references(documents: DataFrame) -> DataFrame:
    """(book, path, kind, target, fragment): resolved internal links, and anchors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for book, path, content in zip(frame.book, frame.path, frame.content, strict=True):
                hrefs, marks = markup.links(markup.parse(content))
                for h in hrefs:
                    if re.match(EXTERNAL, h):
                        continue
                    file, *rest = h.split("#")
                    target = posixpath.normpath(posixpath.join(posixpath.dirname(path), file)) if file else path
                    rows.append((book, path, "link", target, rest[0] if rest and rest[0] else None))
                rows += [(book, path, "anchor", path, m) for m in marks]
            yield pd.DataFrame(rows, columns=["book", "path", "kind", "target", "fragment"])

    return documents.select("book", "path", "content").mapInPandas(run, "book string, path string, kind string, target string, fragment string")


def issues(entries: DataFrame) -> DataFrame:
    """(book, at, code, detail): every structural issue, by check; a valid book has none."""
    parts = package(entries)
    items, spine = parts.where("kind = 'manifest'"), parts.where("kind = 'spine'")
    files = entries.where("error is null and path is not null").select("book", "path", "data")
    one = lambda rows, at, code, detail: rows.select("book", F.lit(at).alias("at"), F.lit(code).alias("code"), detail.alias("detail"))
    out = one(entries.where("error is not null"), 0, "UNSAFE_ARCHIVE", F.col("error")).unionByName(mime_faults(entries))
    out = out.unionByName(parts.where("kind = 'fault'").select("book", F.lit(5).alias("at"), F.col("id").alias("code"), F.col("href").alias("detail")))
    out = out.unionByName(one(items.join(files, (items.book == files.book) & (items.href == files.path), "left_anti"), 6, "MANIFEST_FILE_MISSING", F.col("href")))
    out = out.unionByName(one(spine.join(items, ["book", "id"], "left_anti"), 7, "SPINE_REFERENCES_UNKNOWN_ITEM", F.col("id")))
    pages = items.where("media_type = 'application/xhtml+xml'").select("book", F.col("href").alias("path")).join(files, ["book", "path"]).select("book", "path", text_of(F.col("data")).alias("content"))
    out = out.unionByName(one(pages.withColumn("fault", fault(F.col("content"))).where("fault is not null"), 8, "XHTML_NOT_WELL_FORMED", F.concat_ws(": ", "path", "fault")))
    refs = references(pages)
    links = refs.where("kind = 'link'")
    there = files.select("book", F.col("path").alias("target"))
    out = out.unionByName(one(links.join(there, ["book", "target"], "left_anti"), 9, "UNRESOLVED_LINK", F.concat_ws(" -> ", "path", "target")))
    # anchors may stand in any file that is linked to, whatever the manifest calls it
    held = links.where("fragment is not null").join(there, ["book", "target"], "left_semi")
    marked = held.select("book", F.col("target").alias("path")).distinct().join(files, ["book", "path"]).select("book", "path", text_of(F.col("data")).alias("content"))
    anchors = references(marked).where("kind = 'anchor'").select("book", "target", "fragment")
    lost = held.join(anchors, ["book", "target", "fragment"], "left_anti")
    return out.unionByName(one(lost, 10, "UNRESOLVED_ANCHOR", F.concat_ws("#", "target", "fragment")))


def verdicts(entries: DataFrame) -> DataFrame:
    """(book, valid, issues, codes): one row a book, valid ones too."""
    return lookups.verdicts(entries.select("book").distinct(), issues(entries), "book")


def translated(entries: DataFrame, outcomes: DataFrame, source: str, target: str, display: str = "ENGLISH_FIRST") -> DataFrame:
    """(book, ord, path, data) of bilingual books.

    ``outcomes``: (book, path, at, html), one a block of each chapter, html null where it
    failed.  Chapters without outcomes keep their text and get the sheet's link; refused books give no row.
    """
    opf = package(entries).where("kind <> 'fault'").select("book", "opf").distinct()
    chapters = reading_order(entries).select("book", "path").distinct()
    own = outcomes.groupBy("book", "path").agg(F.array_sort(F.collect_list(F.struct("at", "html"))).alias("o")).select("book", "path", F.col("o.html").alias("html"))
    # a book is bounded by the archive's limits, so one task can hold it
    rows = entries.join(opf, "book").join(chapters.withColumn("chapter", F.lit(True)), ["book", "path"], "left").join(own, ["book", "path"], "left").select("book", "ord", "path", "data", "opf", "html", "chapter")
    good = rows.join(refusals(entries), "book", "left_anti")

    def render(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord")
        outcomes = {p: None if h is None else list(h) for p, h, c in zip(frame.path, frame.html, frame.chapter, strict=True) if c is True}
        first = not markup.english_first(source, target, display)
        made = markup.book([(p, bytes(d)) for p, d in zip(frame.path, frame.data, strict=True)], frame.opf.iloc[0], outcomes, source, target, first)
        return pd.DataFrame({"book": frame.book.iloc[0], "ord": range(len(made)), "path": [p for p, _ in made], "data": [d for _, d in made]})

    return good.groupBy("book").applyInPandas(render, "book string, ord int, path string, data binary")


@F.pandas_udf(StringType())
def rebuilt(html: pd.Series, translated: pd.Series) -> pd.Series:
    """Inline markup of a block from its translated placeholder text; null if it is not there or cannot be rebuilt."""

    def one(own: str, text: str | None) -> str | None:
        return markup.outcome_of(text, markup.placeholders(markup.parse(own))[1])[1]

    return pd.Series([one(a, b) for a, b in zip(html, translated, strict=True)], dtype=object)


def resolved(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """(book, path, at, status, html) of every block, from replies (book, path, at, translated) in placeholder text.

    A block without a reply, or whose placeholders a reply lost, changed or left open, has FAILED and keeps no html.
    """
    rows = blocks.select("book", "path", "at", F.col("html").alias("own")).join(replies.select("book", "path", "at", "translated"), ["book", "path", "at"], "left")
    rows = rows.select("book", "path", "at", rebuilt("own", "translated").alias("html"))
    return rows.select("book", "path", "at", F.when(F.col("html").isNull(), "FAILED").otherwise("TRANSLATED").alias("status"), "html")


@F.pandas_udf(StringType())
def fault(content: pd.Series) -> pd.Series:
    return content.map(markup.fault, na_action="ignore")


def safe_part(part: str) -> str:
    dot = part.rfind(".")
    base, ext = (part[:dot], part[dot:]) if dot > 0 else (part, "")
    base = re.sub(ACCENT, "", unicodedata.normalize("NFKD", base))
    base = re.sub("_+", "_", re.sub(UNSAFE, "_", base)).strip("._")
    return (base or "file") + ext


def renamed(paths: list[str]) -> dict[str, str]:
    """New path of each: safe ones first keep theirs, others get the first free name."""
    out = {p: p for p in paths if re.fullmatch(SAFE_PATH, p)}
    taken = set(out)
    for p in paths:
        if p in out:
            continue
        name = "/".join(map(safe_part, p.split("/")))
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot:]) if dot > 0 else (name, "")
        n = 1
        candidate = name
        while candidate in taken:
            # each try is built on the last name that was taken
            n += 1
            candidate = f"{stem}-{n}{ext}"
            stem = stem if candidate not in taken else f"{stem}-{n}"
        taken.add(candidate)
        out[p] = candidate
    return out


def moved(href: str, old: str, new: str, paths: dict[str, str]) -> str:
    """A reference from a renamed document to a renamed one."""
    file, mark, fragment = href.partition("#")
    if not file or re.match(EXTERNAL, file):
        return href
    to = paths.get(posixpath.normpath(posixpath.join(posixpath.dirname(old), file)))
    return href if to is None else posixpath.relpath(to, posixpath.dirname(new) or ".") + mark + fragment


# Which attribute of which element refers to a file, by kind of document.
REFERS = {".opf": {("item", "href"), ("reference", "href")}, ".ncx": {("content", "src")}, "xhtml": {("a", "href"), ("link", "href"), ("img", "src"), ("image", "xlink:href")}}


def with_safe_paths(entries: list[tuple[str, bytes]]) -> list[tuple[str, bytes]]:
    """Entries under safe paths, with the references to them rewritten; the same if all are safe."""
    paths = renamed([p for p, _ in entries])
    if all(a == b for a, b in paths.items()):
        return entries
    out = []
    for old, data in entries:
        new, ext = paths[old], posixpath.splitext(old)[1].lower()
        refers = {("rootfile", "full-path")} if old == "META-INF/container.xml" else REFERS.get("xhtml" if ext in (".xhtml", ".html", ".htm") else ext)
        if refers:
            text = data.decode("utf-8", "replace")
            base, edits = ("x", "x") if old == "META-INF/container.xml" else (old, new), []
            for n in markup.parse(text).elements():
                for (k, v), (a, b) in zip(n.attrs, n.spots, strict=True):
                    if (n.name.split(":")[-1], k) in refers and (to := moved(v, *base, paths)) != v:
                        edits.append((a, b, markup.quoted(to)))
            data = markup.spliced(text, edits).encode()
        out.append((new, data))
    return out


def write(entries: DataFrame) -> DataFrame:
    """(book, data): one archive a book, from (book, ord, path, data), under safe paths."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("ord")
        made = pack(with_safe_paths([(p, bytes(d)) for p, d in zip(rows.path, rows.data, strict=True)]))
        return pd.DataFrame({"book": [frame.book.iloc[0]], "data": [made]})

    return entries.select("book", "ord", "path", "data").groupBy("book").applyInPandas(run, "book string, data binary")
