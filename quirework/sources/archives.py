"""Archives as a data source: ``spark.read.format("quirework_archive")`` and a sink of the same name.

The reader plans from file sizes alone.  An archive up to ``split`` bytes is a partition with its
neighbours; a larger one is several, each with a run of its entries of about as many
packed bytes.  A task reads the central directory from the end of the file, and then the bytes of its own
entries only; entries that a pushed filter on ``path`` rules out are never read.  So a large
archive is neither one binary value nor one task.

The columns are those of ``epub.unpacked``: an unsafe archive gives one row with its error and no entry
(a fault that shows only when an entry is read gives the error beside the entries that other tasks read;
``epub.refusals`` drops such a book), and an archive without files one row without a path.

The sink takes (book, path, data) rows, in order within a book, all rows of a book in one task
(``save`` deals and sorts them): each book is written beside its place and moved there when the job commits, so
a failed task or job leaves no half archive.

Paths may be URIs of any store that ``pyarrow.fs`` opens, or plain paths.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from quirework.sources import epub

FORMAT, SPLIT = "quirework_archive", 32 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Seekable(io.RawIOBase):
    """A store's file as ``zipfile`` wants it: a place before the start is an OSError."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + (0, self.source.tell(), self.size)[whence]
        if to < 0:
            raise OSError("before the start of the file")
        return self.source.seek(min(to, self.size))

    def tell(self) -> int:
        return self.source.tell()

    def readinto(self, buffer) -> int:
        data = self.source.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


@dataclass
class Run(InputPartition):
    """(file, size, part, parts): whole archives, or one part of a single one."""

    files: list[tuple[str, int, int, int]]


def planned(files: list[tuple[str, int]], split: int) -> list[Run]:
    """Small neighbours together, large archives in parts, by size."""
    runs: list[Run] = []
    held: list[tuple[str, int, int, int]] = []
    for name, size in files:
        if size > split:
            parts = -(-size // split)
            runs += [Run([(name, size, k, parts)]) for k in range(parts)]
            continue
        if held and sum(f[1] for f in held) + size > split:
            runs.append(Run(held))
            held = []
        held.append((name, size, 0, 1))
    return [*runs, Run(held)] if held else runs


def shares(sizes: Sequence[int], parts: int) -> list[int]:
    """The part of each entry, in order: parts hold runs of about as many packed bytes."""
    total, at, out = sum(sizes) + len(sizes), 0, []
    for size in sizes:
        out.append(min(parts - 1, at * parts // max(total, 1)))
        at += size + 1
    return out


class Keep:
    """The pushed filters on ``path``."""

    def __init__(self, filters: list[Filter]):
        self.filters = filters

    def __call__(self, path: str) -> bool:
        return all(self.one(f, path) for f in self.filters)

    @staticmethod
    def known(f: Filter) -> bool:
        return isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and tuple(f.attribute) == ("path",)

    @staticmethod
    def one(f: Filter, path: str) -> bool:
        if isinstance(f, EqualTo):
            return path == f.value
        if isinstance(f, In):
            return path in f.value
        if isinstance(f, StringStartsWith):
            return path.startswith(f.value)
        return path.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in path


def entries(book: str, source, size: int, limits: epub.Limits, part: int = 0, parts: int = 1, keep=lambda path: True) -> Iterator[tuple]:
    """Rows of one part of an archive, from a file object that can seek."""
    try:
        if size > limits.archive:
            raise epub.UnsafeArchive("archive too large")
        with zipfile.ZipFile(source) as z:
            infos = epub.checked(z.infolist(), limits)
            if not infos and not part:
                yield (book, None, None, None, None, None)
            mine = shares([i.compress_size for i in infos], parts)
            for k, i in enumerate(infos):
                if mine[k] == part and keep(i.orig_filename):
                    yield (book, k, i.orig_filename, z.read(i), i.compress_type == zipfile.ZIP_STORED, None)
    except epub.UnsafeArchive as e:
        if not part:
            yield (book, None, None, None, None, str(e))
    except Exception as e:
        yield (book, None, None, None, None, str(e))


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.limits = epub.Limits(*[int(options.get(k, getattr(epub.Limits, k))) for k in ("archive", "unpacked", "entries")])
        self.keep = Keep([])

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        mine = [f for f in filters if Keep.known(f)]
        self.keep = Keep(mine)
        # Spark applies all of them once more: rows that stand for a whole archive have no path
        yield from filters

    def partitions(self) -> Sequence[InputPartition]:
        store, base = opened(self.path)
        info = store.get_file_info(base)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        return planned(sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".epub")), self.split) or [Run([])]

    def read(self, partition: Run) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for name, size, part, parts in partition.files:
            with store.open_input_file(name) as source:
                yield from entries(name, io.BufferedReader(Seekable(source, size)), size, self.limits, part, parts, self.keep)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def place(self, book: str) -> str:
        name = posixpath.basename(book)
        return name if name.lower().endswith(".epub") else f"{name}.epub"

    def write(self, iterator: Iterator) -> Written:
        store, base = opened(self.path)
        store.create_dir(f"{base}/_parts", recursive=True)
        out, book, held = [], None, []

        def done() -> None:
            if held:
                part = f"{base}/_parts/{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(epub.pack(epub.with_safe_paths(held)))
                out.append((part, f"{base}/{self.place(book)}"))

        for row in iterator:
            if row.book != book:
                done()
                book, held = row.book, []
            held.append((row.path, bytes(row.data)))
        done()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        places = [to for _, to in files]
        if len(set(places)) < len(places):
            self.abort(messages)
            raise ValueError("two books have one file name, or a book's rows came from two tasks")
        for part, to in files:
            store.move(part, to)
        store.delete_dir(f"{base}/_parts")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for part, _ in (f for m in messages if m for f in m.files):
            store.delete_file(part)


class ArchiveSource(DataSource):
    """Options: ``path``; ``split`` in bytes; ``archive``, ``unpacked`` and ``entries``, the limits of a safe archive."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return epub.ENTRIES

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def load(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(path)


def save(entries: DataFrame, path: str) -> None:
    """One file a book, from (book, ord, path, data), under safe paths; the entries of a book meet in one task, within an archive's limits."""
    register(entries.sparkSession)
    rows = entries.where("path is not null").select("book", "ord", "path", "data").repartition("book").sortWithinPartitions("book", "ord")
    rows.select("book", "ord", "path", "data", F.lit(None).cast("boolean").alias("stored"), F.lit(None).cast("string").alias("error")).write.format(FORMAT).mode("append").save(path)
