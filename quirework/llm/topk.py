"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size.  For a block, every task scores all its
candidates against all queries (integer inner products) and counts scores in bins
between each query's bounds; the summed histograms tell in which bin the k-th highest
score lies, and the next round counts within that bin, until the bin is one score
wide or few candidates are left at or above it.  Then one pass emits the candidates at
or above the bound.  A task never needs to report more than its own k best (by score,
then smaller id), so ties of any number stay bounded and break deterministically.  What a block
finds is written before the next one begins and its broadcasts are dropped, so the plan of
the result is one scan however many blocks there are.

Defined cases: vectors that are null, or hold null or non-finite components, and rows
without an id take no part; a query is compared with vectors of its own length only;
rows that repeat a query's id are not its candidates, and of rows that repeat an id
the smallest vector is the query; candidate rows that repeat an id each take a place;
fewer than k candidates give fewer rows; vectors so long that a product might not fit 64
bits are an error; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm._text import checkpointed

SCHEMA = "query_id long, rank int, vec_id long, score long"
#: Queries and bytes of query vectors in a block at most (on average), bins a round, scores computed at once.
BLOCK, BLOCK_BYTES, BINS, AT_ONCE = 1024, 8 << 20, 1024, 1 << 21


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


class Block:
    """Queries of one block by length of vector; the k-th score of each is at least low and under high."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        self.ids = np.asarray([r[0] for r in rows], np.int64)
        self.low = np.zeros(len(rows), np.int64)
        self.high = np.zeros(len(rows), np.int64)
        self.width = np.zeros(len(rows), np.int64)
        self.groups = {}
        for d in {len(r[1]) for r in rows}:
            at = np.asarray([i for i, r in enumerate(rows) if len(r[1]) == d])
            self.groups[d] = (at, np.asarray([rows[i][1] for i in at], np.int64).reshape(len(at), d))

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(candidate ids, query numbers, scores); a query's own rows score the least number."""
        for batch in batches:
            lists = batch.column(1)
            lengths, flat = np.asarray(lists.value_lengths()), lists.flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            ids = batch.column(0).to_numpy()
            for d, (at, q) in self.groups.items():
                rows = np.flatnonzero(lengths == d)
                step = max(1, AT_ONCE // len(at))
                for i in range(0, len(rows), step):
                    part = rows[i : i + step]
                    c = flat[starts[part][:, None] + np.arange(d)]
                    most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(d, 1)
                    s = (c.astype(float) @ q.T.astype(float)).astype(np.int64) if most < 2**53 else c @ q.T
                    own = ids[part]
                    order = np.argsort(self.ids[at], kind="stable")
                    spot = np.searchsorted(self.ids[at], own, sorter=order)
                    hit = np.flatnonzero(spot < len(at))
                    hit = hit[self.ids[at][order[spot[hit]]] == own[hit]]
                    s[hit, order[spot[hit]]] = np.iinfo(np.int64).min
                    yield own, at, s


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of each query."""
    spark = vectors.sparkSession
    kept = vectors.where(F.col(id_col).isNotNull() & finite(F.col(vector_col)))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    base = kept.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    asked = kept.where(is_query).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    about = base.agg(F.max(norm).alias("norm"), F.max(F.size("v")).alias("d")).first()
    total = asked.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    if float(about.norm) ** 2 >= 2.0**62:
        raise ValueError("inner products of these vectors do not fit 64 bits; scale them down")
    many = max(1, math.ceil(total / max(1, min(block, BLOCK_BYTES // (8 * max(about.d, 1))))))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(many)))
    written = []
    for b in range(many):
        rows: dict[int, list[int]] = {}
        for r in numbered.where(F.col("block") == b).select("id", "v").collect():
            rows[r.id] = min(rows.get(r.id, r.v), r.v)
        if rows:
            written.append(one_block(base, sorted(rows.items()), about.norm or 0.0, k, bins)._written)
    return spark.read.schema(SCHEMA).parquet(*written)


def one_block(base: DataFrame, rows: list[tuple[int, list[int]]], norm: float, k: int, bins: int) -> DataFrame:
    """The result's rows of one block of queries, written."""
    spark, n = base.sparkSession, len(rows)
    block = Block(rows)
    reach = np.asarray([int(min(2**61, norm * math.sqrt(sum(float(x) * x for x in v)) + 2)) for _, v in rows], np.int64)
    block.low, block.width = -reach, np.maximum(1, -(-(2 * reach + 1) // bins))
    block.high = block.low + bins * block.width
    above, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    while open_.any():
        sent = spark.sparkContext.broadcast((block, open_))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block, open_ = sent.value
            have = np.zeros((len(block.ids), bins), np.int64)
            for _, at, s in block.scores(batches):
                use = open_[at]
                at, s = at[use], s[:, use]
                spot = (s - block.low[at]) // block.width[at]
                good = (s >= block.low[at]) & (s < block.high[at])
                key = (np.broadcast_to(at, s.shape) * bins + spot)[good]
                have += np.bincount(key, minlength=have.size).reshape(have.shape)
            # bins below a task's own k best can't hold the k-th score of all
            over = np.cumsum(have[:, ::-1], 1)[:, ::-1] - have
            q, spot = np.nonzero((have > 0) & (over < k))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(spot, pa.int64()), pa.array(have[q, spot])], ["q", "bin", "n"])

        have = np.zeros((n, bins), np.int64)
        for r in base.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).collect():
            have[r.q, r.bin] = r.n
        sent.destroy()
        reached = above[:, None] + np.cumsum(have[:, ::-1], 1)[:, ::-1]
        for q in np.flatnonzero(open_):
            full = np.flatnonzero(reached[q] >= k)
            if not len(full):  # fewer than k candidates in all: everything counts
                open_[q] = False
                continue
            bin_ = full[-1]
            above[q] = reached[q, bin_] - have[q, bin_]
            block.low[q] += bin_ * block.width[q]
            # bins of the next round may reach beyond this one, whose upper neighbours are counted already
            block.high[q] = min(block.high[q], block.low[q] + block.width[q])
            if block.width[q] == 1 or reached[q, bin_] <= 4 * k:
                open_[q] = False
            else:
                block.width[q] = max(1, -(-block.width[q] // bins))
    sent = spark.sparkContext.broadcast(block)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        q, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for own, at, s in block.scores(batches):
            i, j = np.nonzero((s >= block.low[at]) & (s > np.iinfo(np.int64).min))
            q, ids, scores = np.append(q, at[j]), np.append(ids, own[i]), np.append(scores, s[i, j])
            order = np.lexsort((ids, -scores, q))
            q, ids, scores = q[order], ids[order], scores[order]
            first = np.searchsorted(q, np.arange(len(block.ids)))
            best = np.arange(len(q)) - first[q] < k
            q, ids, scores = q[best], ids[best], scores[best]
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    found = base.mapInArrow(select, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = checkpointed(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    sent.destroy()
    return out
