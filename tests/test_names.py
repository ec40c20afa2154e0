"""Free names over many files against the loop over one archive."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quirework.functions import text as t
from quirework.operators import names, segments
from quirework.plans import catalogue
from quirework.sources import epub


def test_chains(spark):
    rows = spark.createDataFrame([(x,) for x in ("a.x", "a-2.x", "a-2-3.x", "a-2-2.x", "a-3.x", "a-2-3-2.x", "a-02.x", "a-2-3-4", ".x-2", "d.y/a-2", "-2", "a-1-2.x", "a-99999999999.x")], ["n"])
    got = {r.n: (r.p, r.r, r.k) for r in rows.select("n", names.parent(F.col("n")).alias("p"), names.root(F.col("n")).alias("r"), names.place(F.col("n")).alias("k")).collect()}
    assert got == {
        "a.x": ("a.x", "a.x", 1), "a-2.x": ("a.x", "a.x", 2), "a-2-3.x": ("a.x", "a.x", 3), "a-2-2.x": ("a-2.x", "a.x", 2), "a-3.x": ("a-3.x", "a-3.x", 1), "a-2-3-2.x": ("a-2-3.x", "a.x", 2), "a-02.x": ("a-02.x", "a-02.x", 1),
        "a-2-3-4": ("a", "a", 4), ".x-2": (".x", ".x", 2), "d.y/a-2": ("d.y/a-2", "d.y/a-2", 1), "-2": ("", "", 2), "a-1-2.x": ("a-1.x", "a-1.x", 2), "a-99999999999.x": ("a-99999999999.x", "a-99999999999.x", 1),
    }
    chain = rows.where("n = 'a.x'").select(*[names.chained(F.col("n"), F.lit(k)) for k in (1, 2, 4)]).first()
    assert list(chain) == ["a.x", "a-2.x", "a-2-3-4.x"]


@pytest.mark.parametrize("bucket", [4096, 3])
def test_names_equal_the_loop(spark, monkeypatch, bucket):
    monkeypatch.setattr(segments, "BUCKET", bucket)
    r = random.Random(11)
    parts = ["e", "é", "è", "#", " ", "-2", "-2-3", "-3", "-2-3-4", ".css", ".css", "/", "_", "漢"]
    books = {}
    for k in range(120):
        paths = dict.fromkeys("".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 60)))
        books[k] = list(paths)
    books[500] = [f"{'#' * n}.html" for n in range(1, 40)] + ["file.html", "file-2-3.html", "file-2-3-4-5.html"]
    rows = [(k, o, p) for k, paths in books.items() for o, p in enumerate(paths)]
    got = names.free_names(spark.createDataFrame(rows, "book int, ord int, path string"), "book", "ord", "path").collect()
    want = {(k, p): n for k, paths in books.items() for p, n in epub.renamed(paths).items()}
    assert {(x.book, x.path): x.new_path for x in got} == want and len(got) == len(rows)
    for k in books:
        mine = [x.new_path for x in got if x.book == k]
        assert len(set(mine)) == len(mine)


def test_paths_made_of_other_columns(spark):
    r = random.Random(12)
    rows = [(k, o, r.choice("ab"), r.choice((0, 1, 2, 31, 32, 33, 1023, 1057)), r.choice((".x", "-2.x", ".x!!"))) for k in range(3) for o in range(60)]
    rows = sorted({(k, *rest): (k, o, *rest) for k, o, *rest in rows}.values())
    files = spark.createDataFrame(rows, "book int, ord int, letter string, marks int, ext string")
    made = F.concat("letter", F.repeat(F.lit("! "), F.col("marks")), "ext")
    got = names.free_names(files, "book", "ord", "path", made)
    assert got.columns == ["book", "ord", "path", "new_path"]
    want = {}
    for k in range(3):
        paths = {a + "! " * n + b: o for j, o, a, n, b in rows if j == k}
        want |= {(k, paths[p], p): n for p, n in epub.renamed(list(paths)).items()}
    assert {(x.book, x.ord, x.path): x.new_path for x in got.collect()} == want
    plain = names.free_names(files.select("book", "ord", made.alias("path")), "book", "ord", "path")
    assert {(x.book, x.ord, x.path): x.new_path for x in plain.collect()} == want


def test_long_parts(spark):
    parts = ["!" * 5000 + ".html", "a" + "é" * 2000 + "!" * 3000 + "é", "x.!" + "!" * 2000, "=" * 1025 + "̸" + "=" * 1023 + "a.b", " " * 33 + "#" * 4000 + " .", "." * 40 + "y", ".!", "a.", "\n" * 1025 + "b\n.c\n", "漢" * 2000]
    paths = [*parts, *(f"{a}/{b}" for a in parts for b in parts)]
    got = spark.createDataFrame([(p,) for p in paths], ["p"]).select("p", t.safe_path(F.col("p")).alias("got")).collect()
    assert {x.p: x.got for x in got} == {p: "/".join(map(epub.safe_part, p.split("/"))) for p in paths}


def pages(spark, folder, rows):
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    return catalogue.sanitize_collisions(spark, str(folder))


def test_odd_pages(spark, tmp_path):
    ids = [None, None, 0, *range(-80, 90, 3), 5, 10, 20]
    rows = [(i, f"u{k % 5}") for k, i in enumerate(ids)] + [(3, None), (6, None)]
    got = [tuple(x) for x in pages(spark, tmp_path, rows).select("book", "page_id", "path", "new_path").collect()]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(got) == sorted(c.sql(catalogue.SQL["sanitize_collisions"]).fetchall())


def test_pages_with_long_paths(spark, tmp_path):
    """A hundred paths of a million characters; they took minutes."""
    rows = [(7_000_001 + 70 * k, f"u{k}") for k in range(100)]
    began = time.time()
    got = pages(spark, tmp_path, rows).agg(F.count(F.lit(1)), F.countDistinct("book", "new_path"), F.sum(F.length("path").cast("long")), F.max(F.length("new_path"))).first()
    assert time.time() - began < 60
    ends = sum(len("text/a.html") + 2 * (i % 3 == 0) for i, _ in rows)
    assert list(got)[:3] == [100, 100, sum(i // 7 + 1 for i, _ in rows) + ends] and got[3] < 60
