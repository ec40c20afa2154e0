"""Vectorised text helpers shared by the operators that run in Arrow batches.

A word, unless an operator says otherwise, is a maximal run of bytes outside
``\\x20`` and ``\\x09-\\x0D``.  Word hashes run over UTF-8 bytes and spread every bit; two
seeds give a 128-bit name.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Seeds of two independent names, and an odd multiplier.
SEEDS, ODD = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)), U(0x9E3779B97F4A7C15)
#: Bytes from which a word is hashed by itself, and masks of the bytes that count in a load of eight.
LONG, MASKS = 128, np.asarray([(1 << 8 * k) - 1 for k in range(9)], U)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SAME = np.arange(256, dtype=np.uint8)
#: The column that ``numbered`` adds; keys that hold more than a HOT-th of all rows are fewer than HOT; files listed for all tasks.
NUM, HOT, FILES = "_num", 50_000, 20_000
#: Numbers of rows that every task may hold (8 bytes each); more are joined by a shuffle.
FEW_TEXTS = 200_000
LOWER = SAME.copy()
LOWER[65:91] += 32


def bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def keep_fraction(id_col: Column, fraction: Column | float, seed: str) -> Column:
    """True for a deterministic share of the ids, by hash."""
    share = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return share < fraction


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (in place on a copy)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of byte spans: eight bytes at a time go through the finaliser, so every bit spreads."""
    size, seed = ends - starts, SEEDS[which]
    h = size.astype(U) * ODD ^ seed
    padded, lane = np.concatenate([data, np.zeros(8, np.uint8)]), np.arange(8)
    todo, at = np.flatnonzero(size <= LONG), 0
    while len(todo):
        load = padded[starts[todo][:, None] + (lane + at)].view("<u8")[:, 0]
        h[todo] = mix(h[todo] ^ (load & MASKS[np.minimum(size[todo] - at, 8)]))
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), int(seed))
    return h


def column_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets; nulls are empty."""
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    if data is None or not len(array):
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``limit`` bytes of text, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.binary_length(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())).fill_null(0))
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
        release()


def release() -> None:
    """Give freed memory back to the system; reused workers would hold on to it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most ``rows``: buffers on both sides stay small.

    The default of 10,000 rows is meant for narrow rows; whole documents are wide.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


class Words:
    """Words of a string array: byte spans, their row, and hashes."""

    def __init__(self, array: pa.Array, fold: np.ndarray = SAME, space: np.ndarray = SPACE):
        raw, self.offsets = column_bytes(array)
        self.raw = raw
        self.bytes = fold[raw] if fold is not SAME else raw
        gap = space[raw]
        n = len(raw)
        first = np.zeros(n, bool)
        last = np.zeros(n + 1, bool)
        inner = self.offsets[(self.offsets < n)]
        if n:
            first[0] = True
            first[1:] = gap[:-1]
            first[inner] = True
            first &= ~gap
            last[1:n] = gap[1:] & ~gap[:-1]
            ends = self.offsets[self.offsets > 0]
            last[ends] |= ~gap[ends - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last)
        #: index of the first word of each row, and the total at the end
        self.rows = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hashes(self.bytes, self.starts, self.ends, which)


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbouring hashes, without regard to rows, put together from runs of powers of two."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, run, size, left = None, 0, h, 1, width
    while left:
        if left & 1:
            part = run[done : done + n]
            out = part if out is None else mix(out * ODD + part)
            done += size
        left >>= 1
        if left:
            run = mix(run[:-size] * ODD + run[size:])
            size *= 2
    return mix(out + U(width))


def thin(x: np.ndarray) -> bytes:
    """Integers in as few bytes each as the largest needs; the first byte says how many."""
    most = int(x.max(initial=0))
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def thick(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64 if data[0] < 8 else U)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table to the shared folder the session names and read it.

    Only on one machine, as in tests, may ``spark.checkpoint.dir`` be unset; a folder of
    that machine is taken then.  The tables stay until the folder is emptied.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/quirework-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``checkpointed`` wrote; only once all that is made of it is written, too."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        import tempfile

        named = tempfile.mkdtemp(prefix="quirework-checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def bare_scan(docs: DataFrame) -> bool:
    """Is each row of the frame a row of one file, read once: a scan of distinct paths below nothing but columns chosen and rows filtered."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = [p.rstrip("/") for p in plan.relation().location().rootPaths().mkString("\n").split("\n")]
    return not any(a == b or a.startswith(b + "/") for i, a in enumerate(roots) for j, b in enumerate(roots) if i != j)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows, each with a number of its own, ``NUM``: ids may repeat or be null.

    Rows of files are numbered by file and place, the same in every pass.  Rows of any other plan (exploded, joined,
    united, cached, dealt anew) are written first; so are those of more than ``FILES`` files, whose list every task would hold.
    """
    if not bare_scan(docs):
        return numbered(checkpointed(docs))
    paths = sorted(r[0] for r in docs.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.row_index")).select("p").distinct().limit(FILES + 1).collect())
    if len(paths) > FILES:
        return checkpointed(docs.select(F.monotonically_increasing_id().alias(NUM), "*"))
    files = docs.sparkSession.createDataFrame(list(zip(paths, range(len(paths)), strict=True)), "_file string, _order long")
    rows = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_place"))
    rows = rows.join(F.broadcast(files), F.col("_path") == F.col("_file"))
    return rows.select((F.shiftleft("_order", 40) + F.col("_place")).alias(NUM), *docs.columns)


def of_nums(texts: DataFrame, used: DataFrame, few: bool | None = None) -> DataFrame:
    """(num, text) of the numbers in ``used``; texts only move if there are too many numbers to send.

    ``few``: False where the numbers are a good part of all rows, and so never sent.
    """
    used = checkpointed(used.select(F.col("num").alias("used")).distinct())
    if few is None:
        few = used.count() <= FEW_TEXTS
    return texts.join(F.broadcast(used) if few else used.hint("shuffle_hash"), texts["num"] == used["used"], "left_semi")


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int, row_id: str, where: Column | None = None) -> DataFrame:
    """Left join of rows with facts, one a key, whatever share of the rows a key holds.

    ``count``: rows of each key.  Keys with more than a ``HOT``-th of all rows are fewer
    than ``HOT`` and go to every task; the others are dealt by key.  Rows outside
    ``where`` meet nothing and are dealt by their own number.
    """
    least = max(1000, total // HOT)
    values = [c for c in facts.columns if c not in (*keys, count)]
    hot = facts.where(F.col(count) > least).select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_hv_{v}") for v in values], F.lit(True).alias("_hot"))
    cold = facts.where(F.col(count) <= least).select(*[F.col(k).alias(f"_c_{k}") for k in keys], *[F.col(v).alias(f"_cv_{v}") for v in values], F.lit(0).cast("long").alias("_c_salt"))
    on = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    out = rows.join(F.broadcast(hot), on if where is None else [*on, where], "left")
    settled = F.col("_hot").isNotNull() if where is None else F.col("_hot").isNotNull() | ~F.coalesce(where, F.lit(False))
    out = out.withColumn("_salt", F.when(settled, F.xxhash64(row_id)).otherwise(F.lit(0)).cast("long"))
    out = out.join(cold, [*[F.col(k) == F.col(f"_c_{k}") for k in keys], F.col("_salt") == F.col("_c_salt")], "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hv_{v}", f"_cv_{v}").alias(v) for v in values])
