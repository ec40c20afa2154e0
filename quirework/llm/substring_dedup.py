"""Removal of repeated passages, found by recompression.

Words are named by their content.  Each round first names runs: neighbours with one name
become one symbol, named by the name and the length of the run, as long as the run stays
within the round's cap.  Then a symbol falls on one of two sides by a bit of its name,
and every pair (left-side symbol, right-side symbol) within the cap becomes one symbol.
Names are hashes of what they stand for, so a string gets its name wherever it is, on any
machine: the names are global without an exchange.  Whether a boundary between symbols
survives all rounds depends on at most ``REACH`` words on each side, and no symbol has
more than ``CAPS[-1]`` words (a longer run keeps the boundaries inside it).  So every
window of ``width`` words holds a boundary that survives in each of its occurrences, with
``REACH`` words of the window on both sides.

1. Surviving boundaries are named by the ``REACH`` words before and after them, which
   settle the symbols that meet there.  A window's anchor is its boundary with the least
   name, the same one in each of its occurrences.  Anchors that occur twice anywhere are
   found by ``exchange.shared``: a passage that a third of all documents share costs a
   shard one entry a pack.
2. A window can only repeat if its anchor is shared.  Such windows get a 96-bit hash of
   their words, and the same exchange finds the hashes that occur at two starts.
3. Every word under such a window goes.

Documents with the very same words are one class: with ``width`` words or more all their
words repeat, and only the class's first document takes part in step 2.

Defined cases: null and empty texts have no words, and the hash of the empty string;
documents shorter than the window keep everything; every row is a document of its own,
whether its id repeats or is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm import exchange
from quirework.llm._text import NUM, ODD, U, Words, checkpointed, join_counted, mix, numbered, of_nums, pieces, window_hash

#: Most words of a symbol made in each round.
CAPS = (2, 4)
#: Words on which a boundary's fate depends: in a round, a run up to the cap and the symbol that ends it.
REACH = sum(CAPS) + sum((1, *CAPS[:-1]))
#: Entries a shard at most, and shards at least.
SHARD_WORDS, LEAST_SHARDS = 6_000_000, 64


def least_width() -> int:
    """The shortest window for which a surviving boundary is certain."""
    return 2 * REACH + CAPS[-1] - 1


def boundaries(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indexes of the words before which a boundary survives all rounds."""
    names, start, size = h.copy(), np.arange(len(h)), np.ones(len(h), np.int64)
    for k, cap in enumerate(CAPS):
        if len(names) < 2:
            break
        # runs of one name
        fresh = np.append(True, (names[1:] != names[:-1]) | (rows[start[1:]] != rows[start[:-1]]))
        first = np.flatnonzero(fresh)
        many = np.diff(np.append(first, len(names)))
        whole = (many > 1) & (size[first] * many <= cap)
        names[first[whole]] = mix(names[first[whole]] + U(0x52554E) + many[whole].astype(U) * ODD)
        size[first[whole]] *= many[whole]
        keep = fresh | ~np.repeat(whole, many)
        names, start, size = names[keep], start[keep], size[keep]
        # pairs of a symbol of the left side and one of the right side
        side = (mix(names + U(0xA5A5 + 7919 * k)) & U(1)).astype(bool)
        pair = ~side[:-1] & side[1:] & (rows[start[:-1]] == rows[start[1:]]) & (size[:-1] + size[1:] <= cap)
        at = np.flatnonzero(pair)
        names[at] = mix(names[at] * ODD + names[at + 1] + U(k + 1))
        size[at] += size[at + 1]
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, start, size = names[keep], start[keep], size[keep]
    return start


def anchors(words: Words, h: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, the anchor of each (a word's index), and the names of the boundary before every word."""
    n = len(h)
    name = np.full(n + 1, ~U(0), U)
    b = boundaries(h, rows)
    b = b[(b >= REACH) & (b + REACH <= n)]
    name[b] = np.minimum(window_hash(h, 2 * REACH)[b - REACH], ~U(1))
    start = np.arange(max(0, n - width + 1))
    start = start[rows[start] == rows[start + width - 1]]
    if not len(start):
        return start, start, name
    least = np.lib.stride_tricks.sliding_window_view(name[REACH : n + 1], width - 2 * REACH + 1)
    anchor = np.concatenate([least[part].argmin(1) for part in np.array_split(start, len(start) // 65536 + 1)])
    return start, start + REACH + anchor, name


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 35) -> DataFrame:
    """(id, n_words, n_removed, kept) of every document; kept: the words left, joined by a space."""
    if width < least_width():
        raise ValueError(f"windows must have {least_width()} words or more")
    spark = docs.sparkSession
    base = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary())], ["num", "n", "sha"])

    facts = checkpointed(base.select(NUM, "text").mapInArrow(summary, "num long, n long, sha binary"))
    classes = checkpointed(facts.where(F.col("n") >= width).groupBy("sha").agg(F.min("num").alias("rep"), F.count(F.lit(1)).alias("copies")))
    size = facts.agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("rows")).first()
    shards = max(LEAST_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size.words or 0) / SHARD_WORDS))

    def name_boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch.column(1))
            h, rows = words.hashes(), words.row_of()
            _, at, name = anchors(words, h, rows, width)
            at = np.unique(at)
            if len(at):
                yield exchange.packed(batch.column(0).to_numpy(), rows[at], name[at], shards, at - words.rows[rows[at]])

    shared = exchange.shared(base.select(NUM, "text").mapInArrow(name_boundaries, exchange.WRITTEN), shards, places=True)
    shared = shared.join(classes.select(F.col("rep").alias("num")), "num", "left_semi")
    shared = checkpointed(shared)
    texts = checkpointed(of_nums(base.select(F.col(NUM).alias("num"), "text"), shared).join(shared, "num").select("num", "text", "at"))

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words = Words(batch.column(1))
            h, rows = words.hashes(), words.row_of()
            start, at, _ = anchors(words, h, rows, width)
            lists = batch.column(2)
            known = np.zeros(len(h) + 1, bool)
            known[np.repeat(words.rows[:-1], np.asarray(lists.value_lengths())) + lists.flatten().to_numpy()] = True
            start = start[known[at]]
            if len(start):
                one, two = window_hash(h, width)[start], window_hash(words.hashes(1), width)[start]
                yield exchange.packed(batch.column(0).to_numpy(), rows[start], one, shards, start - words.rows[rows[start]], two)

    windows = exchange.shared(texts.mapInArrow(name_windows, exchange.WRITTEN), shards, places=True, wide=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            removed, kept = [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = (text or "").encode().split()
                step = np.zeros(len(words) + width + 1, np.int64)
                begin = starts.values.to_numpy()
                step[begin] += 1
                step[begin + width] -= 1
                under = np.cumsum(step)[: len(words)] > 0
                removed.append(int(under.sum()))
                kept.append(b" ".join([w for w, u in zip(words, under.tolist(), strict=True) if not u]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], ["num", "removed", "kept"])

    hit = of_nums(texts.select("num", "text"), windows).join(windows.select("num", F.col("at").alias("starts")), "num")
    changed = hit.mapInArrow(cut, "num long, removed long, kept string")
    copied = classes.where("copies > 1").select("sha", "copies", F.lit(True).alias("copied"))
    out = join_counted(facts, copied, ["sha"], "copies", size.rows, "num", F.col("n") >= width)
    out = out.join(base.select(F.col(NUM).alias("num"), "id"), "num").join(changed, "num", "left")
    gone = F.coalesce("copied", F.lit(False))
    kept = F.when(gone, F.lit("")).otherwise(F.col("kept"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(kept.isNotNull(), F.sha2(kept, 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
        kept.alias("kept_text"),
    )
