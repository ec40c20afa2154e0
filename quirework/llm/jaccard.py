"""Similarity join on word n-gram sets by token-combination prefixes.

Two documents link when their sets' Jaccard similarity reaches num / den.  The tokens
(hashes of shingles) have one order for all documents: the more documents have one, the
later it comes.  Counts come from ``exchange.shared``, in two passes.  The first counts
the tokens in the lowest ``SPAN`` of the hash range over all documents.  A document whose
prefix can be filled with tokens that no other document has can link with nothing and
leaves; the second pass counts all tokens of the rest, one document of each class of
equal sets, against each other.

If two sets of n and m tokens link, their prefixes of n - ceil(t n) + l and
m - ceil(t m) + l tokens share l tokens.  Prefixes are extended by l = B + 1, where B
is the number of parts into which frequent tokens are dealt: then either a rare token
is shared, or B + 1 frequent ones, two of which lie in the same part.  So rare tokens
are indexed one by one and frequent tokens by pairs within a part.  B depends on a
size class; a document is indexed under its own and the next one, so any two that can
link meet in one.

Documents with equal sets form a class that is joined once.  A unit holds the members of
the signatures that have one smallest member; every pair with a common signature lies in
one.  A member is held first against the smallest one with which it shares a signature,
which settles groups of copies.  Where a unit still spans several components, its members
outside the largest of them meet all its members.  Both comparisons run in blocks of
bounded rows and bytes, which hold the texts, check every pair of different components
(first an exact bound by bucketed counts, then the sets) and merge components as they go:
a block yields fewer links than it has members, no pairs of a group are written out, and
no link between components is lost.

Defined cases: null and empty texts (or texts without words) have no set, link with
nothing and are their own component; fewer words than n give one shingle; every row is a
document of its own, and of rows that repeat an id each gets a row; a null id counts as
larger than any other, so it is a component only where no id is reachable; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm import exchange
from quirework.llm._text import FEW_TEXTS, LOWER, NUM, U, Words, checkpointed, join_counted, mix, numbered, of_nums, pieces, release, signed, window_hash
from quirework.llm.components import components

#: Part of the hash range for which it is found out whether a token is shared.
SPAN = 0.3
LIMIT = U(int(SPAN * (1 << 64)))
#: Tokens of the span a shard at most, and shards at least.
SHARD_TOKENS, LEAST_SHARDS = 2_000_000, 64
#: Members and shingles in a block of a unit; buckets of the counts; sets so large that their counts are not used.
BLOCK, BLOCK_TOKENS, BUCKETS, WIDE = 1024, 400_000, 256, 65535
#: Documents from which a token is frequent; tokens a part.
FREQUENT, PART = 32, 6


def shingle_sets(array: pa.Array, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct shingle hashes of each row, and its number of words."""
    words = Words(array, LOWER)
    h = words.hashes()
    wide = window_hash(h, width)
    out = []
    for i, n in enumerate(words.counts):
        at = words.rows[i]
        if n >= width:
            out.append(np.unique(wide[at : at + n - width + 1]))
        elif n:
            out.append(mix(window_hash(h[at : at + n], int(n)) + U(n)))
        else:
            out.append(np.zeros(0, U))
    return out, words.counts


def parts_of(label: np.ndarray | int, num: int, den: int):
    """B of a size class: its largest size's slack dealt into parts of about PART tokens."""
    largest = np.ceil((den / num) ** (np.asarray(label, float) + 1))
    return np.maximum(1, np.ceil(largest * (1 - num / den) / PART)).astype(np.int64)


def label_of(n: int, num: int, den: int) -> int:
    """k with (den/num)**k <= n < (den/num)**(k+1), by exact integers."""
    k = int(np.log(n) / np.log(den / num))
    while n * num ** (k + 1) >= den ** (k + 1):
        k += 1
    while n * num**k < den**k:
        k -= 1
    return k


def reach(n: int, num: int, den: int) -> tuple[int, int, list[int]]:
    """Slack n - ceil(t n), size class and parts under both classes of a set of n tokens."""
    label = label_of(n, num, den)
    return n - -(-num * n // den), label, [int(parts_of(k, num, den)) for k in (label, label + 1)]


def prefix(n: int, num: int, den: int) -> int:
    """Tokens of the longest prefix of a set of n tokens."""
    slack, _, parts = reach(n, num, den)
    return slack + 1 + max(parts)


def signatures(n: int, alone: int, x: np.ndarray, often: np.ndarray, num: int, den: int) -> np.ndarray:
    """n: tokens of the set; alone: those that no other has; x: names of the others, the rarest first; often: are they frequent."""
    slack, label, parts = reach(n, num, den)
    take = slack + 1 + max(parts) - alone
    if take <= 0 or not len(x):
        return np.zeros(0, U)
    rare, common = x[~often], x[often]
    out = [mix(rare[:take] + U(1))]
    if take > len(rare) and len(common):
        for k, b in zip((label, label + 1), parts, strict=True):
            held = common[: max(0, slack + 1 + b - alone - len(rare))]
            part = (mix(held + U(7)) % U(b)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            held, part = held[order], part[order]
            tag = U(1000003 * (k + 2))
            for d in range(1, len(held)):
                same = part[d:] == part[:-d]
                if not same.any():
                    break
                a, c = held[d:][same], held[:-d][same]
                out.append(mix(mix(np.minimum(a, c) + tag) + np.maximum(a, c)))
    return np.unique(np.concatenate(out))


def grouped(base: DataFrame, text_col: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents (num, n, c1, c2), classes of equal sets (n, c1, c2, rep, copies) with their component (rep where it is alone), rows.

    ``base``: numbered rows.
    """
    spark = base.sparkSession
    texts = base.select(F.col(NUM).alias("num"), F.col(text_col).alias("text"))
    totals = texts.agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    shards = max(LEAST_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")), int((totals.n or 0) / 6 * SPAN / SHARD_TOKENS))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets, _ = shingle_sets(batch.column(1), width)
            size = np.asarray([len(x) for x in sets], np.int64)
            one = np.asarray([mix(x).sum(dtype=U) for x in sets], U)
            two = np.asarray([mix(x + U(0x51ED27)).sum(dtype=U) for x in sets], U)
            span = pa.array([int(np.searchsorted(x, LIMIT)) for x in sets], pa.int32())
            take = pa.array([prefix(int(n), num, den) if n else 0 for n in size], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(signed(one)), pa.array(signed(two)), span, take], ["num", "n", "c1", "c2", "span", "take"])

    def sender(whole: bool):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                sets, _ = shingle_sets(batch.column(1), width)
                low = sets if whole else [x[: np.searchsorted(x, LIMIT)] for x in sets]
                key = np.concatenate(low)
                if len(key):
                    yield exchange.packed(batch.column(0).to_numpy(), np.repeat(np.arange(len(low)), [len(x) for x in low]), key, shards, exact=whole)

        return send

    described = checkpointed(texts.mapInArrow(describe, "num long, n long, c1 long, c2 long, span int, take int"))
    documents = described.select("num", "n", "c1", "c2")
    reps = checkpointed(documents.where("n > 0").groupBy("n", "c1", "c2").agg(F.min("num").alias("rep"), F.count(F.lit(1)).alias("copies")))
    met = exchange.shared(texts.mapInArrow(sender(False), exchange.WRITTEN), shards)
    # of a class with copies every token is met, so only its own counts can tell; such classes stay
    members = reps.select(F.col("rep").alias("num"))
    open_ = described.select("num", "n", "span", "take").join(members, "num", "left_semi").join(met, "num", "left").where(F.col("span") - F.coalesce("hits", F.lit(0)) < F.col("take"))
    facts = checkpointed(open_.select("num", "n", "take"))
    known = exchange.shared(of_nums(texts, facts.select("num"), False).mapInArrow(sender(True), exchange.WRITTEN), shards, names=True)
    placed = known.withColumnRenamed("n", "held").join(facts, "num").where(F.col("n") - F.col("hits") < F.col("take")).select("num", "n", "name", "held")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.zeros(0, U)]
            for n, name, held in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                x, h = name.values.to_numpy().view(U), held.values.to_numpy()
                order = np.lexsort((x, h))
                sigs.append(signatures(n, n - len(x), x[order], h[order] >= FREQUENT, num, den))
            ends = np.cumsum([len(x) for x in sigs]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(sigs))))], ["num", "sigs"])

    sigs = checkpointed(placed.mapInArrow(sign, "num long, sigs array<long>").select("num", F.explode("sigs").alias("sig")))
    # signatures with the very same members (by two 64-bit hashes of the set) say the same: one of them stays
    groups = sigs.groupBy("sig").agg(F.min("num").alias("low"), F.max("num").alias("high"), F.count(F.lit(1)).alias("g"), F.bit_xor(F.xxhash64("num")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(7), "num")).alias("x2")).where("low < high")
    groups = groups.groupBy("low", "high", "g", "x1", "x2").agg(F.min("sig").alias("sig")).select("sig", "low")
    shared = checkpointed(sigs.join(groups, "sig"))
    # a unit: the members of signatures with one smallest member; every pair that can link lies in one
    pairs = checkpointed(shared.where("num > low").select(F.col("low").alias("unit"), "num").distinct())
    sizes = facts.select("num", "n")
    # first each member is held against the smallest one with which it shares a signature; sizes may rule a link out
    hub = sizes.select(F.col("num").alias("unit"), F.col("n").alias("hub"))
    near = pairs.groupBy("num").agg(F.min("unit").alias("unit")).join(sizes, "num").join(hub, "unit").where((den * F.least("n", "hub")) >= (num * F.greatest("n", "hub")))
    counted = near.groupBy("unit").agg(F.lit(-1).cast("long").alias("most"), F.lit(1).alias("outer"), F.lit(0).cast("long").alias("outer_tokens"), F.count(F.lit(1)).alias("all"), F.sum("n").alias("tokens"))
    dealt = checkpointed(dealt_in_blocks(near.withColumn("comp", F.col("num")), counted).where("not o"))
    heads = dealt.select("unit", "i", "j").distinct().select("unit", "i", "j", F.lit(True).alias("o"), F.col("unit").alias("num"), F.col("unit").alias("comp"))
    linked = checkpointed(settle(dealt.unionByName(heads), texts, width, num, den))
    comp = components(linked)
    # units that still span several components: members outside the largest one meet all members
    members = pairs.unionByName(pairs.select("unit", F.col("unit").alias("num")).distinct())
    left = checkpointed(members.join(sizes, "num").join(comp.withColumnRenamed("id", "num"), "num", "left").select("unit", "num", "n", F.coalesce("comp", "num").alias("comp")))
    more = checkpointed(settle(dealt_in_blocks(left, spanning(left)), texts, width, num, den))
    if more.limit(1).count():
        comp = components(linked.unionByName(more))
    classes = checkpointed(reps.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("n", "c1", "c2", "rep", "copies", F.coalesce("comp", "rep").alias("comp")))
    return documents, classes, totals.rows


def spanning(rows: DataFrame) -> DataFrame:
    """Units of (unit, num, n, comp) with several components: the one with most members, members and tokens in all and outside it."""
    per = rows.groupBy("unit", "comp").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("tokens"))
    out = per.groupBy("unit").agg(F.max(F.struct("g", "tokens", "comp")).alias("top"), F.sum("g").alias("all"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    return out.select("unit", F.col("top.comp").alias("most"), (F.col("all") - F.col("top.g")).alias("outer"), (F.col("tokens") - F.col("top.tokens")).alias("outer_tokens"), "all", "tokens")


def dealt_in_blocks(rows: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, i, j, o, num, comp): rows outside the component ``most`` in blocks i (o), all rows in blocks j.

    ``rows``: unit, num, n, comp; ``units``: unit, most, and members and tokens of either kind.
    """
    blocks = lambda members, tokens: F.greatest(F.lit(1), F.ceil(F.col(members) / BLOCK), F.ceil(F.col(tokens) / BLOCK_TOKENS)).cast("int")
    own = lambda many: F.pmod(F.xxhash64("num"), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    sized = rows.join(units.select("unit", "most", blocks("outer", "outer_tokens").alias("many_o"), blocks("all", "tokens").alias("many")), "unit")
    few = sized.where("comp <> most").select("unit", own("many_o").alias("i"), every("many").alias("j"), F.lit(True).alias("o"), "num", "comp")
    return few.unionByName(sized.select("unit", every("many_o").alias("i"), own("many").alias("j"), F.lit(False).alias("o"), "num", "comp"))


def links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(id, n_shingles, component) of every row."""
    base = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    documents, classes, rows = grouped(base, "text", width, num, den)
    owned = checkpointed(owners(documents.join(base.select(F.col(NUM).alias("num"), "id"), "num"), classes, rows))
    least = owned.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("many"))
    out = join_counted(owned, least, ["comp"], "many", rows, "num", F.col("comp").isNotNull())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def owners(documents: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """The documents with their component, null where it has no other document."""
    sizes = classes.groupBy("comp").agg(F.sum("copies").alias("size"), F.count(F.lit(1)).alias("many")).where("size > 1")
    open_ = join_counted(classes, sizes, ["comp"], "many", rows, "rep").where("size is not null").select("n", "c1", "c2", "copies", "comp")
    return join_counted(documents, checkpointed(open_), ["n", "c1", "c2"], "copies", rows, "num", F.col("n") > 0)


def distinct(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, one of each component: that of the smallest id (null last, then the first row)."""
    base = numbered(docs)
    documents, classes, rows = grouped(base, text_col, width, num, den)
    owned = checkpointed(owners(documents, classes, rows))
    members = owned.where("comp is not null").join(base.select(F.col(NUM).alias("num"), F.col(id_col).alias("id")), "num")
    best = members.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "num")).alias("b")).select(F.col("b.num").alias("num"))
    # the rows that go are few beside those that stay
    gone = checkpointed(members.select("num").join(best, "num", "left_anti").withColumnRenamed("num", "gone"))
    few = gone.count() <= FEW_TEXTS
    return base.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), base[NUM] == gone["gone"], "left_anti").select(*docs.columns)


def allowed(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Do sizes and bucketed counts allow sets to link: shared tokens are at most the sum of the smaller counts."""
    most = np.minimum(x, y).sum(-1, dtype=np.int64)
    wide = np.minimum(n, m) >= WIDE
    return wide | ((den * most >= num * (n + m - most)) & (den * np.minimum(n, m) >= num * np.maximum(n, m)))


def bucket_counts(x: np.ndarray) -> np.ndarray:
    return np.bincount((x >> U(56)).astype(np.int64), minlength=BUCKETS).clip(0, 65535).astype(np.uint16)


class Unit:
    """Members of a unit that arrive one after the other; pairs of different components are checked once."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.up = num, den, {}

    def find(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def links(self, outer: np.ndarray, nums: np.ndarray, comps: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """(a, b) of members that link and whose components were still apart."""
        num, den = self.num, self.den
        sizes = np.asarray([len(x) for x in sets])
        counts = np.stack([bucket_counts(x) for x in sets])
        inner = np.flatnonzero(~outer)
        for a in np.flatnonzero(outer):
            own = self.find(comps[a])
            apart = np.asarray([self.find(comps[b]) != own for b in inner], bool)
            some = inner[apart]
            some = some[(den * np.minimum(sizes[some], sizes[a]) >= num * np.maximum(sizes[some], sizes[a]))]
            if not len(some):
                continue
            for b in some[allowed(counts[a], counts[some], sizes[a], sizes[some], num, den)]:
                x, y = self.find(comps[a]), self.find(comps[b])
                if x == y:
                    continue
                at = np.searchsorted(sets[a], sets[b])
                at[at == len(sets[a])] = 0
                both = int((sets[a][at] == sets[b]).sum())
                if den * both >= num * (sizes[a] + sizes[b] - both):
                    self.up[max(x, y)] = min(x, y)
                    yield int(nums[a]), int(nums[b])


def settle(units: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) found in units (unit, i, j, o, num, comp): rows marked o are held against the others, fewer links than rows."""
    units = checkpointed(units)
    held = of_nums(texts, units.select("num"))
    rows = units.join(held, "num").select("unit", "i", "j", "o", "num", "comp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(part: pa.RecordBatch) -> pa.RecordBatch | None:
            outer = part.column(3).to_numpy(zero_copy_only=False).astype(bool)
            if outer.all() or not outer.any():
                return None
            sets, _ = shingle_sets(part.column(6), width)
            found = list(Unit(num, den).links(outer, part.column(4).to_numpy(), part.column(5).to_pylist(), sets))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"]) if found else None

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], 1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(x, y - x)
                if waiting and any(waiting[0].column(c)[0] != part.column(c)[0] for c in (0, 1, 2)):
                    if (out := unit(joined(waiting))) is not None:
                        yield out
                    waiting = []
                if y > x:
                    waiting.append(part)
        if waiting and (out := unit(joined(waiting))) is not None:
            yield out
        release()

    return rows.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j").mapInArrow(run, "a long, b long").distinct()


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
