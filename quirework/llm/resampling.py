"""Importance resampling towards a target distribution of hashed features.

Features are runs of 1 to ``runs`` neighbouring words (lower-cased ASCII letters, digits and
everything beyond ASCII), joined by one space; a feature falls into the bucket of its
CRC-32.  The sparse matrix of documents by buckets is written once, in CSR blocks: a block
is one row with the ids, where each document's entries begin, and the entries' buckets and
counts, in as few bytes each as the largest needs.  All that follows reads blocks, not
texts: column sums give the corpus's distribution, the target table's blocks its own, and
a product of each block with the vector of gains gives the documents' weights.

A bucket's gain is ``floor(1000 ln((t+1)(S+b) / ((s+1)(T+b))))``: t of the target's T features,
s of the corpus's S fall into one of b buckets.  A document's score is its weight plus
``floor(1000 G)``, G the Gumbel variate that its id and a seed give; of the N documents with enough
words the ``percent * N / 100`` with the highest scores are drawn, which samples without replacement
in proportion to exp(weight / 1000).

Only (score, id, number) of eligible documents are sorted: ranges of scores are dealt to tasks,
written, and counted; a rank is a place within a range plus the rows of the ranges before.
The vector of gains and the column sums have as many entries as buckets, which is a parameter.

Defined cases: a null text has no words; without features a weight is 0; a null id counts as no
digits, and sorts after all others; every row is a document of its own, so rows that repeat are
drawn one by one, ties within equal ids in any order; an empty corpus gives no rows, an empty target
even gains; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm._text import LOWER, Words, checkpointed, pieces, release, thick, thin

#: Bytes that are not in words once letters are lower-cased, and the table of CRC-32 by byte.
GAP = np.asarray([b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
CRC = np.asarray([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\x00") for b in range(256)], np.uint32)
#: Words longer than this are fed to zlib by themselves.
LONG = 64
BLOCK = "ids array<bigint>, n_words binary, ends binary, buckets binary, counts binary"


def crc_after(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of what ``state`` is the CRC of, followed by a byte span; all spans take a step together."""
    size, out = ends - starts, ~state
    long = np.flatnonzero(size > LONG)
    todo = np.flatnonzero(size <= LONG)
    at = 0
    while len(todo := todo[size[todo] > at]):
        now = out[todo]
        out[todo] = CRC[(now ^ data[starts[todo] + at]) & 0xFF] ^ (now >> np.uint32(8))
        at += 1
    out = ~out
    for i in long:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]))
    return out


def entries(words: Words, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (row, bucket, count) of the features of a batch."""
    rows, space = words.row_of(), np.asarray([32], np.uint8)
    state = crc_after(np.zeros(len(rows), np.uint32), words.bytes, words.starts, words.ends)
    keys = [rows * buckets + (state % np.uint32(buckets)).astype(np.int64)]
    for k in range(1, runs):
        inside = rows[k:] == rows[:-k]
        first, last = np.flatnonzero(inside), np.flatnonzero(inside) + k
        grown = np.zeros(len(rows), np.uint32)
        gap = crc_after(state[first], space, np.zeros(len(first), np.int64), np.ones(len(first), np.int64))
        grown[first] = crc_after(gap, words.bytes, words.starts[last], words.ends[last])
        state = grown
        keys.append(rows[first] * buckets + (state[first] % np.uint32(buckets)).astype(np.int64))
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return key // buckets, key % buckets, count


def blocks(docs: DataFrame, *, runs: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The CSR blocks of a table, written down."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            words = Words(part.column(1), LOWER, GAP)
            row, bucket, count = entries(words, runs, buckets)
            ends = np.searchsorted(row, np.arange(1, part.num_rows + 1))
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0).cast(pa.int64()))
            packed = [pa.array([thin(x)], pa.binary()) for x in (words.counts, ends, bucket, count)]
            yield pa.RecordBatch.from_arrays([ids, *packed], ["ids", "n_words", "ends", "buckets", "counts"])
            del words, row, bucket, count
            release()

    return checkpointed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(build, BLOCK))


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """Features of each bucket: a task sends what it has seen, one row a bucket at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.bincount(thick(b), thick(c), buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in matrix.select("buckets", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t, b = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every document: each block times the gains."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words, ends, bucket, count = (thick(batch.column(c)[k].as_py()).astype(np.int64) for c in range(1, 5))
                upto = lambda x: np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])]  # noqa: B023, E731
                columns = [words, np.diff(upto(count)), np.diff(upto(count * gain[bucket]))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, *[pa.array(x, pa.int64()) for x in columns]], ["id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(product, "id long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: str) -> Column:
    """``floor(1000 G)`` of a Gumbel variate, by hash."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u))).cast("long")


def ranked(scored: DataFrame, draw: int) -> DataFrame:
    """(id, ..., score) with ``rank``, 1 for the highest score, null beyond ``draw``; ties to smaller ids.

    Rows with one score and id are told apart by ``_row``, so no range holds more than its share.
    """
    by = [F.desc("score"), F.asc_nulls_last("id"), F.asc("_row")]
    dealt = scored.withColumn("_row", F.monotonically_increasing_id())
    dealt = checkpointed(dealt.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").count()
    before = sizes.select(F.col("_range").alias("_of"), F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    out = dealt.join(F.broadcast(before), F.col("_range") == F.col("_of")).withColumn("rank", place + F.col("_before"))
    return out.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).drop("_row", "_range", "_of", "_before")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, runs: int = 1, buckets: int = 10_000, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document; rank is null where it is not drawn."""
    matrix = blocks(docs, runs=runs, buckets=buckets, id_col=id_col, text_col=text_col)
    wanted = blocks(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), runs=runs, buckets=buckets, id_col="id")
    gain = gains(column_sums(matrix, buckets), column_sums(wanted, buckets))
    scored = checkpointed(weights(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    able = scored.where(F.col("n_words") >= least_words)
    drawn = ranked(able, percent * able.count() // 100)
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
