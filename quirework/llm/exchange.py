"""Which keys of a document occur elsewhere, for keys as many as words.

A pack is a batch of documents.  It writes down each of its distinct keys once, however
many of its documents hold it, in one row a shard (a range of keys); beside the keys, in
the same row, stand the places they came from.  Only the keys and how often the pack has
each travel to the shards; a shard adds up the counts of equal keys and answers every
pack with one bit a key.  Back at the pack, bits and places meet, and each document with
a hit gets one row.

So a key that a third of all documents hold costs a shard one entry a pack, no task
gathers the documents of a key, and what travels depends on the entries, not on the
number of shards: a row has a pack number and a shard number beside its entries, and
the numbers of a pack's documents are kept in a single row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm._text import U, checkpointed, discard, mix, release, thick, thin

WRITTEN = "pack long, shard int, k0 binary, k1 binary, n binary, size binary, row binary, at binary"
FIELDS = [f.split()[0] for f in WRITTEN.split(", ")]
ANSWER = "pack long, shard int, hit binary, total binary, name binary"


def starts(shards: int) -> np.ndarray:
    """The least key of each shard."""
    return np.asarray([(i << 64) // shards for i in range(shards)], U)


def packed(nums: np.ndarray, row: np.ndarray, key: np.ndarray, shards: int, at: np.ndarray | None = None, second: np.ndarray | None = None, exact: bool = False) -> pa.RecordBatch:
    """What a pack writes: entries (row in the pack, key, place); counts above 2 only if ``exact``.

    Without ``second``, keys are cut to 48 bits behind those that tell the shard; with it,
    a key has 64 bits and 32 of the second.
    """
    order = np.argsort(key, kind="stable") if second is None else np.lexsort((second, key))
    k = key[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = k[1:] != k[:-1]
    if second is not None:
        s2 = second[order]
        fresh[1:] |= s2[1:] != s2[:-1]
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(k)))
    names, edge, least = k[first], np.append(first, len(k)), starts(shards)
    cut = np.append(np.searchsorted(names, least), len(names))
    shift = U(max(0, 17 - shards.bit_length()))
    count = size if exact else np.minimum(size, 2)
    row, at = row[order], None if at is None else at[order]
    pack = int(nums[0])
    out: list[tuple] = [(pack, -1, None, None, None, None, nums.astype(np.int64).tobytes(), None)]
    for s in np.flatnonzero(np.diff(cut)).tolist():
        a, b = int(cut[s]), int(cut[s + 1])
        x, y = int(edge[a]), int(edge[b])
        if second is None:
            short = (names[a:b] - least[s]) >> shift
            k0, k1 = short.astype(np.uint32).tobytes(), (short >> U(32)).astype(np.uint16).tobytes()
        else:
            k0, k1 = names[a:b].tobytes(), s2[first[a:b]].astype(np.uint32).tobytes()
        out.append((pack, s, k0, k1, thin(count[a:b]), thin(size[a:b]), thin(row[x:y]), None if at is None else thin(at[x:y])))
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], FIELDS)


def keys_of(k0: bytes, k1: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray | None]:
    if wide:
        return np.frombuffer(k0, U), np.frombuffer(k1, np.uint32)
    return np.frombuffer(k0, np.uint32).astype(U) | (np.frombuffer(k1, np.uint16).astype(U) << U(32)), None


def shared(sent: DataFrame, shards: int, *, places: bool = False, names: bool = False, wide: bool = False) -> DataFrame:
    """(num, hits) of every document with keys that occur twice or more, with their places (at) or names and counts (name, n).

    ``wide``: packed with second keys.
    """
    sent = checkpointed(sent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, parts, counts = [], [], []
        for batch in batches:
            for pack, shard, k0, k1, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                who.append((pack, shard))
                parts.append(keys_of(k0, k1, wide))
                counts.append(thick(n))
        if not who:
            return
        length = np.asarray([len(c) for c in counts])
        shard = np.repeat(np.asarray([s for _, s in who]), length)
        key, weight = np.concatenate([p[0] for p in parts]), np.concatenate(counts).astype(np.int64)
        by = (key, shard) if not wide else (np.concatenate([p[1] for p in parts]), key)
        del parts, counts
        order = np.lexsort(by)
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in by], 0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        total = np.bincount(group, weights=weight).astype(np.int64)[group]
        hit = total >= 2
        ends, rows = np.cumsum(length), []
        for (pack, s), end, n in zip(who, ends.tolist(), length.tolist(), strict=True):
            h = hit[end - n : end]
            if h.any():
                of = slice(end - n, end)
                name = mix(key[of][h] ^ (U(s) << U(48))).tobytes() if names else None
                rows.append((pack, s, np.packbits(h, bitorder="little").tobytes(), thin(total[of][h]) if names else None, name))
        if rows:
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["pack", "shard", "hit", "total", "name"])
        del key, weight, by, order, group, total, rows
        release()

    answers = sent.where("shard >= 0").select("pack", "shard", "k0", "k1", "n").repartition(shards, "shard").mapInArrow(meet, ANSWER)
    none = F.lit(None).cast("binary")
    left = sent.select("pack", "shard", F.lit(0).alias("kind"), "size", "row", "at", none.alias("hit"), none.alias("total"), none.alias("name"))
    right = answers.select("pack", "shard", F.lit(1).alias("kind"), none.alias("size"), none.alias("row"), none.alias("at"), "hit", "total", "name")
    back = left.unionByName(right).repartition("pack").sortWithinPartitions("pack", "shard", "kind")
    schema = "num long, hits int" + ", at array<int>" * places + ", name array<long>, n array<int>" * names

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nums, waiting, found = None, None, None, []
        for batch in batches:
            for pack, shard, kind, size, row, at, hit, total, name in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if pack != now:
                    if found:
                        yield documents(nums, found)
                    now, found = pack, []
                if shard < 0:
                    nums = np.frombuffer(row, np.int64)
                elif kind == 0:
                    waiting = (size, row, at)
                else:
                    found.append(held(*waiting, hit, total, name))
        if found:
            yield documents(nums, found)
        release()

    def held(size: bytes, row: bytes, at: bytes | None, hit: bytes, total: bytes | None, name: bytes | None) -> tuple:
        size = thick(size)
        good = np.unpackbits(np.frombuffer(hit, np.uint8), count=len(size), bitorder="little").astype(bool)
        use = np.repeat(good, size)
        out = [thick(row)[use]]
        if places:
            out.append(thick(at)[use])
        if names:
            out += [np.repeat(np.frombuffer(name, np.int64), size[good]), np.repeat(thick(total), size[good])]
        return tuple(out)

    def documents(nums: np.ndarray, found: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        row, first, many = np.unique(columns[0][order], return_index=True, return_counts=True)
        ends = pa.array(np.append(first, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order].astype(np.int64 if names and k == 0 else np.int32))) for k, x in enumerate(columns[1:])]
        return pa.RecordBatch.from_arrays([pa.array(nums[row]), pa.array(many.astype(np.int32)), *lists], ["num", "hits", *["at"] * places, *["name", "n"] * names])

    out = checkpointed(back.mapInArrow(expand, schema))
    discard(sent)
    return out
