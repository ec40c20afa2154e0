"""Language-model scores from sharded Elias-Fano tries.

The model is a bigram model over lower-cased words and one end token, with Dirichlet
smoothing towards the smoothed unigram distribution (counts plus 0.5, one type unseen):

    P(w | v) = (c(v w) + strength * P(w)) / (c(v) + strength)

Every word has its own count, its own contexts and its own pairs; the probabilities of
a context, with one unseen type, sum to one.

1. Training words are counted exactly: batches send each shard one packed row.
2. Counts of the ``head`` most frequent words (a table of bounded size) go to all tasks;
   that only spreads the work and changes no result.  Batches then send pairs that end
   in a head word to the shard of (context, part of the words), and pairs that end in
   another word to the shard of that word, where they add up to its count.  Each entry
   carries its row so training counts and the texts to be scored meet in
   one exchange, however frequent a word or a pair is.
3. A shard builds its trie (``elias_fano.Trie``: monotone pointers, quantised logs of
   c(v w) + strength * P(w), in levels mapped from a file), looks up all its pairs by
   successor search within their context, and returns sums by document.  Logs of
   c(v) + strength are subtracted where v is counted, once for each time it is a context.

Nothing of the model is gathered on the driver but the bounded head; shards grow in
number with the corpus.

Defined cases: a null text counts as empty (one end token); every row is a document of
its own, whether its id repeats or is null; an empty training part scores by the unseen type alone; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm._text import LOWER, NUM, U, Words, checkpointed, mix, numbered, pieces, release, thick, thin
from quirework.llm.elias_fano import Trie

#: Frequent words whose counts all tasks hold, strength of the prior, bytes of a batch, tokens a shard, shards at least.
HEAD, STRENGTH, BATCH, SHARD_TOKENS, LEAST_SHARDS = 1 << 17, 300.0, 2_000_000, 2_000_000, 128
END = U(0x454E442D4F462121)
START = U(0x53544152542D4F46)
SALT = 64


def tokens(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, is first of its row) of every token, the end tokens included."""
    words = Words(array, LOWER)
    n = len(words.counts)
    h = np.insert(words.hashes(), words.rows[1:], END)
    rows = np.repeat(np.arange(n), words.counts + 1)
    first = np.zeros(len(h), bool)
    first[words.rows[:-1] + np.arange(n)] = True
    return h, rows, first


def shard_slices(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(ends)):
        yield int(s), order[ends[s] : ends[s + 1]]


def packs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Pieces whose first column, the number of the row, grows by little from row to row."""
    for batch in pieces(batches, limit=limit):
        step = np.diff(batch.column(0).to_numpy())
        cut = [0, *(np.flatnonzero((step <= 0) | (step > 1 << 16)) + 1).tolist(), batch.num_rows]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            yield batch.slice(x, y - x)


def grouped(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, row) in order, with counts; rows are few enough to share 64 bits when packed by rank."""
    names, inverse = np.unique(key, return_inverse=True)
    pair, n = np.unique(inverse.astype(np.int64) * (int(row.max(initial=0)) + 1) + row, return_counts=True)
    width = int(row.max(initial=0)) + 1
    return names[pair // width], pair % width, n


def score(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, strength: float = STRENGTH) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every document; training marks the rows to learn from."""
    spark = docs.sparkSession
    base = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("train")))
    size = base.where("train").agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    shards = max(LEAST_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size.n or 0) / 6 / SHARD_TOKENS))

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=BATCH):
            h, _, _ = tokens(batch.column(0))
            key, n = np.unique(h, return_counts=True)
            out: list[tuple] = []
            for s, o in shard_slices((key % U(shards)).astype(np.int64), shards):
                out.append((s, key[o].tobytes(), thin(n[o])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[i] for x in out], pa.binary()) for i in (1, 2)]], ["shard", "k", "n"])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for batch in batches:
            for i in range(batch.num_rows):
                keys.append(np.frombuffer(batch.column(1)[i].as_buffer(), U))
                counts.append(thick(batch.column(2)[i].as_py()))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
        # each shard has its share of the head; more than enough of its own most frequent words
        top = np.argsort(-n, kind="stable")[: 2 * head // shards + 1000]
        yield pa.RecordBatch.from_arrays([pa.array(key[top].view(np.int64)), pa.array(n[top]), pa.nulls(len(top), pa.int64())], ["key", "n", "types"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n.sum()], pa.int64()), pa.array([len(key)], pa.int64())], ["key", "n", "types"])
        del keys, counts, key, at, n, top
        release()

    words = base.where("train").select("text").mapInArrow(send_words, "shard int, k binary, n binary").repartition(shards, "shard").mapInArrow(count_words, "key long, n long, types long")
    words = checkpointed(words)
    totals = words.where("types is not null").agg(F.sum("n").alias("n"), F.sum("types").alias("v")).first()
    n_all, types = int(totals.n or 0), int(totals.v or 0)
    top = words.where("types is null").orderBy(F.desc("n"), "key").limit(head).toArrow()
    key = top.column("key").to_numpy().view(U)
    order = np.argsort(key)
    scale = n_all + 0.5 * (types + 1)
    sent = spark.sparkContext.broadcast((key[order], top.column("n").to_numpy()[order]))
    starts = int(size.rows)

    def shared():
        """Head keys and the hash of a text's start, counts of the head by symbol; the last symbol is the start."""
        keys, counts = sent.value
        return np.append(keys, START), counts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, c = shared()
        keys, start = hashes[:-1], len(hashes) - 1
        for batch in packs(batches, BATCH):
            n, nums = batch.num_rows, batch.column(0).to_numpy()
            # a row is told by how far its number is from the pack's first, and whether it is learned from
            pack, off = int(nums[0]), nums - nums[0]
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            h, rows, first = tokens(batch.column(1))
            sym = np.searchsorted(keys, h)
            common = hashes[sym] == h
            common &= sym < start
            # words outside the head are numbered behind the start
            rare, at = np.unique(h[~common], return_inverse=True)
            sym[~common] = start + 1 + at
            names = np.concatenate([hashes, rare])
            # a common word's own terms: its share, and what its count as a context divides by
            share, context = np.zeros(len(names)), np.zeros(len(names))
            share[:start] = np.log10(c + 0.5)
            context[:start] = np.where(keys == END, 0.0, -np.log10(c + strength))
            one = np.bincount(rows, weights=share[sym], minlength=n)
            two = np.bincount(rows, weights=context[sym], minlength=n) - math.log10(starts + strength)
            known = np.bincount(rows[common], minlength=n)
            length = np.bincount(rows, minlength=n)
            out: list[tuple] = []
            code = 2 * off + train
            before = np.where(first, start, np.concatenate([[0], sym[:-1]]))
            pair, r, k = grouped(before * len(names) + sym, rows)
            left, right = pair // len(names), pair % len(names)
            # all pairs that end in a rare word meet at its shard, which so has its count; frequent words are spread
            where = np.where(right > start, names[right], mix(names[left] * U(SALT) + mix(names[right]) % U(SALT))) % U(shards)
            for s, o in shard_slices(where.astype(np.int64), shards):
                x, y = left[o], right[o]
                some = np.unique(np.concatenate([x[x > start], y[y > start]]))
                x, y = (np.where(v > start, start + 1 + np.searchsorted(some, v), v) for v in (x, y))
                key = x * (start + 1 + len(some)) + y
                out.append((s, names[some].tobytes(), thin(np.diff(key, prepend=0)), thin(code[r[o]]), thin(k[o])))
            m, none = len(out), pa.list_(pa.float64())
            columns = [pa.array([x[0] for x in out], pa.int32()), pa.array([pack] * m, pa.int64()), *[pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3, 4)]]
            columns += [pa.nulls(m, none), pa.nulls(m, none), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))]
            fields = ["shard", "pack", "name", "key", "row", "n", "sums", "score", "known", "length"]
            yield pa.RecordBatch.from_arrays(columns, fields)
            lone = lambda x: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(x))
            spread = int(h[0] % U(shards)) if len(h) else 0
            columns = [pa.array([spread], pa.int32()), pa.array([pack], pa.int64()), *[pa.nulls(1, pa.binary())] * 2, pa.array([thin(code)], pa.binary()), pa.nulls(1, pa.binary()), lone(one), lone(two), lone(known.astype(np.int64)), lone(length.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, fields)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, c = shared()
        start = len(c)
        held: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda j, i=i, batch=batch: batch.column(j)[i]
                pack, code = get(1).as_py(), thick(get(4).as_py())
                if not get(2).is_valid:
                    yield result(pack + (code >> 1), *[get(j).values.to_numpy() for j in (6, 7, 8, 9)])
                    continue
                name = np.frombuffer(get(2).as_buffer(), U)
                left, right = np.divmod(np.cumsum(thick(get(3).as_py()).astype(np.int64)), start + 1 + len(name))
                held.append((pack, name, left.astype(np.int32), right.astype(np.int32), (code >> 1).astype(np.int32), thick(get(5).as_py()).astype(np.int32), (code & 1) > 0))
        if held:
            yield from met(held)
        release()

    def met(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Sums of all pairs of a shard; empties the list, to hold less."""
        hashes, c = shared()
        start = len(c)
        rare = np.unique(np.concatenate([x[1] for x in held]))
        symbols, keys = start + 1 + len(rare), []
        for _, name, left, right, *_ in held:
            to = start + 1 + np.searchsorted(rare, name)
            for side in (left, right):
                late = side > start
                side[late] = to[side[late] - start - 1]
            keys.append(left.astype(np.int64) * symbols + right)
        n, train = (np.concatenate([x[j] for x in held]) for j in (5, 6))
        rows = [(x[0], x[4]) for x in held]
        held.clear()
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        at = at.astype(np.int32)
        del keys
        count = np.bincount(at[train], weights=n[train], minlength=len(names))
        left, right = names // symbols, names % symbols
        lone = right > start
        full = np.bincount(right[lone], weights=count[lone], minlength=symbols)
        full[:start] = c
        prior = strength * (full[right] + 0.5) / scale
        got = count > 0
        # the context's count divides elsewhere, where its word is counted
        trie = Trie(left[got], right[got], np.log10(count[got] + prior[got]), symbols)
        log = trie.lookup(left, right)
        trie.close()
        log = np.where(np.isnan(log), np.log10(prior), log)
        end = np.append(hashes, rare)[right] == END
        log -= np.where(lone & ~end, np.log10(full[right] + strength), 0.0)
        share, seen = np.where(lone, np.log10(full[right] + 0.5), 0.0), lone & (full[right] > 0)
        del left, right, prior, got, trie, names, count, train
        done = 0
        for pack, row in rows:
            part = slice(done, done + len(row))
            done += len(row)
            some, place = np.unique(row, return_inverse=True)
            sums = [np.bincount(place, weights=x[at[part]] * n[part]) for x in (share, log, seen)]
            yield result(pack + some.astype(np.int64), sums[0], sums[1], sums[2].astype(np.int64), np.zeros(len(some), np.int64))

    def result(nums: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nums, pa.int64()), pa.array(a), pa.array(b), pa.array(known, pa.int64()), pa.array(length, pa.int64())], ["num", "sums", "score", "known", "length"])

    blob = "shard int, pack long, name binary, key binary, row binary, n binary, sums array<double>, score array<double>, known array<long>, length array<long>"
    parts = base.select(NUM, "text", "train").mapInArrow(send, blob).repartition(shards, "shard").mapInArrow(meet, "num long, sums double, score double, known long, length long")
    parts = parts.groupBy("num").agg(F.sum("length").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("sums").alias("sums"), F.sum("score").alias("score"))
    out = parts.join(base.select(F.col(NUM).alias("num"), "id"), "num")
    return out.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("sums") - F.col("n_tokens") * math.log10(scale)).alias("base_score"), "score",
    )
