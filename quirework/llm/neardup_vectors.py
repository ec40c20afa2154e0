"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

Vectors are compared within a group (a label) and a length.  Equal vectors of a group are one
class, which is hashed once and counts as many times as it has rows.  In each of several tables a
class has a key of ``bits`` signs, one for each of as many random hyperplanes; classes that
share a key in some table are compared.  Two vectors at angle a share one with probability
``1 - (1 - (1 - a / pi) ** bits) ** tables``.  ``bits`` grows with the logarithm of the number of
classes, so that chance meetings stay a few a class at any size, and ``tables`` with it, so
that a pair just at the threshold is missed with a probability of ``1 - recall`` at most.

Keys travel without vectors first; only classes that share a key get one.  A key's classes are dealt
to parts of about ``part`` rows, and each pair of parts is a unit of bounded size, so neither a
task nor a group gathers a large key.  A unit computes cosines in double precision as products of matrices
and gives, for each class, how many rows it links to and one edge towards the smallest class of its
local component: rows that grow with members, never with pairs.  A pair that shares several keys counts in the
first of them only.  Edges meet in distributed connected components.

What a key of m different classes costs: m / ``part`` copies of its rows and m * m / 2 products, as
counting links between different vectors needs; copies of one vector cost nothing.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and all of a
null group, link with nothing (0 links, their own component); the length of a vector does not
matter, nor does its size (it is scaled before it is squared); vectors of different lengths
do not link; rows that repeat an id are rows of their own; a null id counts as a row, is
nobody's component if another id is reachable, and is kept if none is; an empty table gives no rows;
other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm._text import checkpointed, join_counted, mix, release
from quirework.llm.components import components

#: Rows of a part; members up to which the pairs of all units of a batch are compared at once.
PART, FEW = 1024, 12
#: Share of the pairs at the threshold that the tables find, by their number.
RECALL = 0.995


def shape(classes: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many classes."""
    bits = max(8, math.ceil(math.log2(max(classes, 2))) + 2)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def scaled(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their scaled vectors) of each length that occurs."""
    size = pc.list_value_length(vectors).to_numpy()
    for s in np.unique(size):
        of = np.flatnonzero(size == s)
        yield of, scaled(vectors.take(pa.array(of)))


def keys(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """(row, table) keys: the signs of each table's planes, in 64 bits."""
    plane = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    sign = (x @ plane >= 0).reshape(len(x), tables, bits)
    out = np.zeros((len(x), tables), np.uint64)
    for b in range(0, bits, 32):
        value = sign[:, :, b : b + 32] @ (np.uint64(1) << np.arange(min(32, bits - b), dtype=np.uint64))
        out = mix(out ^ (value.astype(np.uint64) + np.uint64(b + 1)))
    return out.view(np.int64)


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of n rows that each reaches over the pairs (a, b)."""
    least = np.arange(n)
    while True:
        old, low = least.copy(), np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == old).all():
            return least


def near(x: np.ndarray, unit: np.ndarray, sign: np.ndarray, table: np.ndarray, cosine: float, few: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs within units of ``few`` rows at most, all units at once: rows 1, 2, 3 ... apart."""
    found = [(np.zeros(0, np.int64),) * 2]
    for d in range(1, few):
        a = np.flatnonzero(unit[d:] == unit[:-d])
        seen = (sign[a] == sign[a + d]) & (np.arange(sign.shape[1]) < table[a][:, None])
        a = a[~seen.any(1)]
        a = a[np.einsum("ij,ij->i", x[a], x[a + d]) >= cosine]
        found.append((a, a + d))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def many(x: np.ndarray, sign: np.ndarray, table: int, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one unit: within its part, or between its two parts."""
    first, second = (np.flatnonzero(side == k) for k in (0, 1))
    if not len(second):
        second = first
    hit = x[first] @ x[second].T >= cosine
    if second is first:
        hit = np.triu(hit, 1)
    for s in range(table):
        hit &= sign[first, s][:, None] != sign[second, s][None, :]
    a, b = np.nonzero(hit)
    return first[a], second[b]


def compare(cosine: float, tables: int, part: int, few: int):
    """Rows of units, sorted by unit, to (num, links, other) of those that link."""

    def whole(rows: pa.Table, edge: np.ndarray) -> pa.RecordBatch:
        num, table, side, weight = (rows.column(c).to_numpy() for c in ("num", "table", "side", "weight"))
        sign = rows.column("sign").combine_chunks().flatten().to_numpy().reshape(-1, tables)
        vectors = rows.column("vector").combine_chunks()
        size = np.diff(np.append(edge, len(num)))
        unit = np.repeat(np.arange(len(edge)), size)
        crosses = np.zeros(len(edge), bool)
        crosses[unit[side == 1]] = True
        small = ((size <= few) & ~crosses)[unit]
        pairs = [(np.zeros(0, np.int64),) * 2]
        if small.any():
            for of, x in by_length(vectors.filter(pa.array(small))):
                of = np.flatnonzero(small)[of]
                a, b = near(x, unit[of], sign[of], table[of], cosine, few)
                pairs.append((of[a], of[b]))
        for k in np.flatnonzero((size > few) | crosses):
            of = slice(edge[k], edge[k] + size[k])
            a, b = many(scaled(vectors[of]), sign[of], int(table[of][0]), side[of], cosine)
            pairs.append((a + edge[k], b + edge[k]))
        a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
        links = np.zeros(len(num), np.int64)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        root, hit = smallest(len(num), a, b), np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (num[hit], links[hit], num[root[hit]])], ["num", "links", "other"])

    def edges(rows: pa.Table) -> np.ndarray:
        """Where units begin."""
        fresh = np.zeros(len(rows), bool)
        fresh[:1] = True
        for c in ("key", "kind", "lo", "hi"):
            x = rows.column(c).combine_chunks()
            fresh[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(len(h) for h in held) < 2 * part:
                continue
            rows = pa.Table.from_batches(held)
            edge = edges(rows)
            if len(edge) > 1:  # the last unit may go on
                yield whole(rows.slice(0, edge[-1]), edge[:-1])
                rows = rows.slice(edge[-1])
            held = rows.to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield whole(rows, edges(rows))
        release()

    return run


def usable(vector: Column) -> Column:
    """Not null, every component a finite number, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.98, recall: float = RECALL, seed: int = 12, part: int = PART, few: int = FEW) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; without ``label_col`` all rows are one group."""
    label = F.lit("") if label_col is None else F.col(label_col).cast("string")
    rows = rows.select(F.col(id_col).alias("id"), label.alias("kind"), F.col(vector_col).alias("vector"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("able", F.col("kind").isNotNull() & usable(F.col("vector")))
    # numbers of classes follow their smallest ids, so the smallest number of a component has its smallest id
    classes = rows.where("able").groupBy("kind", "vector").agg(F.count("*").alias("weight"), F.min("id").alias("least"))
    classes = classes.repartitionByRange(F.asc_nulls_last("least"), F.xxhash64("vector")).sortWithinPartitions(F.asc_nulls_last("least"))
    classes = checkpointed(classes.withColumn("num", F.monotonically_increasing_id()))
    total = classes.count()
    bits, tables = shape(total, cosine, recall)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, tables), np.int64)
            for of, x in by_length(batch.column(1)):
                out[of] = keys(x, bits, tables, seed)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["num", "sign"])

    signs = checkpointed(classes.select("num", "vector").mapInArrow(sign, "num long, sign array<long>"))
    about = classes.select("num", "kind", "weight", "vector")
    keyed = signs.join(classes.select("num", F.xxhash64("kind", F.size("vector")).alias("of")), "num").select("num", "of", F.posexplode("sign").alias("table", "s"))
    keyed = checkpointed(keyed.select("num", "table", F.xxhash64("of", "table", "s").alias("key")))
    meet = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("m", F.col("n"))
    members = join_counted(keyed, meet, ["key"], "n", total * tables, "num").where("m > 1")
    members = members.join(about, "num").join(signs, "num")
    members = members.withColumn("parts", F.ceil(F.col("m") / F.lit(float(part))).cast("int")).withColumn("mine", F.pmod(F.xxhash64("num"), F.col("parts")).cast("int"))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.withColumn("lo", F.least("mine", "with")).withColumn("hi", F.greatest("mine", "with"))
    members = members.select("num", "key", "kind", "table", "lo", "hi", (F.col("mine") > F.col("with")).cast("int").alias("side"), "weight", "sign", "vector")
    units = members.repartition("key", "lo", "hi").sortWithinPartitions("key", "kind", "lo", "hi")
    linked = checkpointed(units.mapInArrow(compare(cosine, tables, part, few), "num long, links long, other long"))

    reach = components(linked.select(F.col("num").alias("a"), F.col("other").alias("b")))
    roots = reach.groupBy("comp").agg(F.count("*").alias("n")).join(classes.select(F.col("num").alias("comp"), F.col("least").alias("root")), "comp")
    reach = join_counted(reach, roots, ["comp"], "n", total, "id").select(F.col("id").alias("num"), "root")
    links = linked.groupBy("num").agg(F.sum("links").alias("links"))
    facts = classes.join(links, "num", "left").join(reach, "num", "left")
    facts = facts.select("kind", "vector", F.col("weight").alias("n"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "least").alias("component"))
    out = join_counted(rows, facts, ["kind", "vector"], "n", total, "row", F.col("able"))
    component = F.when(F.col("able"), F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
