"""The archive source reads what it is asked for, and the sink leaves whole archives or none."""

import io
import os

import pytest
from pyspark.sql import functions as F

from quirework.sources import archives, epub
from tests.test_books import archive, book


class Counted(io.BytesIO):
    """How many bytes were read, once the directory at the end is known."""

    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


def large(n=60, each=20_000):
    return epub.pack([("mimetype", epub.MIMETYPE.encode()), *((f"text/{k:03d}.xhtml", os.urandom(each)) for k in range(n))])


def test_only_the_bytes_of_the_entries_asked_for_are_read():
    data = large()
    rows = lambda **more: (s := Counted(data), list(archives.entries("b", s, len(data), epub.Limits(), **more)))
    whole, all_rows = rows()
    one, some = rows(keep=lambda p: p.endswith("007.xhtml"))
    assert [r[2] for r in some] == ["text/007.xhtml"] and some[0] in all_rows
    assert whole.total > 60 * 20_000 and one.total < 20_000 + 30_000
    parts = [rows(part=k, parts=4) for k in range(4)]
    assert [r for _, p in parts for r in p] == all_rows
    assert all(s.total < 0.3 * len(data) + 30_000 for s, _ in parts)


def test_plans_follow_sizes():
    runs = archives.planned([("a", 10), ("b", 10), ("c", 250), ("d", 90), ("e", 20)], 100)
    assert sorted(tuple(r.files) for r in runs) == [(("a", 10, 0, 1), ("b", 10, 0, 1)), (("c", 250, 0, 3),), (("c", 250, 1, 3),), (("c", 250, 2, 3),), (("d", 90, 0, 1),), (("e", 20, 0, 1),)]
    assert archives.shares([5, 5, 5, 5], 2) == [0, 0, 1, 1] and archives.shares([], 3) == [] and max(archives.shares([1] * 100, 7)) == 6


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.epub").write_bytes(epub.pack(book()))
    (tmp_path / "in/deep/large.EPUB").write_bytes(large(20, 5000))
    (tmp_path / "in/junk.epub").write_bytes(b"no archive")
    (tmp_path / "in/empty.epub").write_bytes(archive([]))
    (tmp_path / "in/up.epub").write_bytes(archive([("../x", b"x", True)]))
    (tmp_path / "in/notes.txt").write_bytes(b"")
    return tmp_path


def test_rows_are_those_of_whole_archives(spark, folder):
    name = lambda b: os.path.basename(b)
    got = archives.load(spark, str(folder / "in"), split=20_000).collect()
    files = [(str(p), p.read_bytes()) for p in (folder / "in").rglob("*") if p.suffix.lower() == ".epub"]
    want = epub.unpacked(spark.createDataFrame(files, "book string, data binary")).collect()
    key = lambda r: (name(r.book), r.ord if r.ord is not None else -1)
    assert [(*r[:5], bool(r.error)) for r in sorted(got, key=key)] == [(*r[:5], bool(r.error)) for r in sorted(want, key=key)]
    assert archives.load(spark, str(folder / "in"), split=20_000).rdd.getNumPartitions() > 5


def test_filters_on_paths_reach_the_reader(spark, folder):
    rows = archives.load(spark, f"file://{folder}/in").where(F.col("path").endswith("c1.xhtml") & (F.col("ord") > 0))
    assert [r.path for r in rows.collect()] == ["OEBPS/text/c1.xhtml"]
    r = archives.Reader({"path": "x"})
    list(r.pushFilters([archives.StringEndsWith(("path",), ".opf"), archives.EqualTo(("book",), "b")]))
    assert r.keep("a.opf") and not r.keep("a.xhtml")


def test_sink_round_trip(spark, folder):
    entries = archives.load(spark, str(folder / "in")).where("error is null")
    archives.save(entries, str(folder / "out"))
    assert sorted(os.listdir(folder / "out")) == ["a.epub", "large.EPUB"]
    assert (folder / "out/a.epub").read_bytes() == epub.pack(book())


def test_a_broken_book_leaves_no_file(spark, folder):
    rows = spark.createDataFrame([("a", 0, "mimetype", b"x"), ("b", 0, "no-mimetype", b"x")], "book string, ord int, path string, data binary")
    with pytest.raises(Exception, match="no mimetype entry"):
        archives.save(rows, str(folder / "bad"))
    assert [f for f in os.listdir(folder / "bad") if f.endswith(".epub")] == []
