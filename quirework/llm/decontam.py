"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

Test items are indexed once (item sets are small beside a corpus; they are taken in
blocks of at most ``BLOCK_ITEMS``, so what is sent to the tasks is bounded).  Weights
are BM25 weights divided by the item's own score, so a passage that holds every term of
an item scores 1 for it, and one threshold serves all items.

Every document is cut into passages of three times the longest item, each starting one
such length after the last, so every stretch of two items' length lies wholly in a
passage: what is found does not depend on the other items of the block.  A passage
is searched only if an upper bound allows a hit: of each item, the least telling terms
that together weigh at most half the threshold are left out; the others must reach the
rest.  Searches are document-at-a-time with block-max WAND and return every item at or
above the threshold.  A hit is then verified in windows of twice the item's own length:
one of them must score as much, and the words of the item's question and of its answer
(split after a question mark or before "answer:", else after two thirds of the words)
must each be found in it to at least ``overlap``.

Words are runs of letters and digits, in lower case; each character of a script that is
written without spaces (``ALONE``) is a word.  Items with fewer than ``least_words``
words are too short for shares of words: their exact sequence of words is a hit.

Defined cases: null and empty texts hold nothing, items without a word are in nothing;
equal items are each reported; rows that repeat a document id are pooled; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm._text import U, Words, pieces, type_of, window_hash

K1, B, POSTINGS = 1.2, 0.75, 32
BLOCK_ITEMS = 20000
#: Bytes outside letters, digits and non-ASCII characters part words.
GAP = np.ones(256, bool)
GAP[48:58] = GAP[65:91] = GAP[97:123] = False
GAP[128:] = False

#: Thai to Myanmar, Khmer, kana, Han and its extensions.
ALONE = "([\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}])"


def words_of(array: pa.Array) -> Words:
    array = pc.utf8_lower(array)
    words = Words(array, space=GAP)
    # all these characters have three bytes or more
    if not (words.bytes >= 0xE0).any():
        return words
    return Words(pc.replace_substring_regex(array, ALONE, " \\1 "), space=GAP)


def item_words(texts: list[str | None]) -> list[list[bytes]]:
    w = words_of(pa.array(texts, pa.string()))
    raw = w.bytes.tobytes()
    spans = [raw[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
    return [spans[w.rows[i] : w.rows[i + 1]] for i in range(len(texts))]


def word_hashes(words) -> np.ndarray:
    return Words(pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), space=GAP).hashes() if len(words) else np.zeros(0, U)


def question_length(text: str, words: list[bytes]) -> int:
    """How many of the words are the question's."""
    lower = text.lower()
    cut = lower.find("?") + 1 or max(lower.find("answer:"), 0)
    n = len(item_words([text[:cut]])[0]) if cut else 0
    return n if 0 < n < len(words) else max(1, min(len(words) - 1, math.ceil(len(words) * 2 / 3)))


class Index:
    """Inverted index with postings in blocks, each with its largest weight."""

    def __init__(self, items: list[tuple], idf_of, mean_length: float, threshold: float, least_words: int = 1):
        self.ids = [i for i, _ in items]
        words = item_words([t for _, t in items])
        texts = [t or "" for _, t in items]
        self.threshold = threshold
        self.bags = [Counter(w) for w in words]
        self.split = [question_length(t, w) if len(w) > 1 else len(w) for t, w in zip(texts, words, strict=True)]
        self.parts = [(Counter(w[:k]), Counter(w[k:])) for w, k in zip(words, self.split, strict=True)]
        self.longest = max([16, *(len(w) for w in words if len(w) >= least_words)])
        names = sorted({t for b, w in zip(self.bags, words, strict=True) if len(w) >= least_words for t in b})
        number = {t: i for i, t in enumerate(names)}
        postings: list[list[tuple[int, float]]] = [[] for _ in names]
        needed: list[list[tuple[int, float]]] = [[] for _ in names]
        #: short items by number of words: from the sequence of words to the items
        self.short: dict[int, dict[tuple, list[int]]] = {}
        self.long = False
        for i, bag in enumerate(self.bags):
            if len(words[i]) < least_words:
                self.short.setdefault(len(words[i]), {}).setdefault(tuple(words[i]), []).append(i)
                continue
            self.long = True
            raw = {t: idf_of(t) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words[i]) / mean_length)) for t, n in bag.items()}
            own = sum(raw.values()) or 1.0
            spare = threshold / 2
            for t, x in sorted(raw.items(), key=lambda y: (y[1], y[0])):
                postings[number[t]].append((i, x / own))
                if x / own <= spare:
                    spare -= x / own
                else:
                    needed[number[t]].append((i, x / own))
        self.items = [np.asarray([p for p, _ in x], np.int64) for x in postings]
        self.weights = [np.asarray([w for _, w in x]) for x in postings]
        self.tops = [[float(w[k : k + POSTINGS].max()) for k in range(0, len(w), POSTINGS)] for w in self.weights]
        self.top = [max(t, default=0.0) for t in self.tops]
        self.names = names
        self.own: list[dict[int, float]] = [{} for _ in self.bags]
        for t, (own, weights) in enumerate(zip(self.items, self.weights, strict=True)):
            for i, w in zip(own.tolist(), weights.tolist(), strict=True):
                self.own[i][t] = w
        self.numbered = [tuple({number[t]: n for t, n in q.items() if t in number} for q in parts) for parts in self.parts]
        hashes = word_hashes(names)
        order = np.argsort(hashes)
        self.hashes, self.term = hashes[order], order
        # postings of the telling terms of each item, one after the other
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in needed])]).astype(np.int64)
        self.telling = np.asarray([i for x in needed for i, _ in x], np.int64)
        self.gain = np.asarray([w for x in needed for _, w in x])

    def terms(self, h: np.ndarray) -> np.ndarray:
        """Term number of each hash, -1 for words of no item."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        i = np.searchsorted(self.hashes, h)
        i[i == len(self.hashes)] = 0
        return np.where(self.hashes[i] == h, self.term[i], -1)

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Every item whose score is at the threshold or above, by block-max WAND."""
        goal = self.threshold - 1e-9
        lists = [[int(self.items[t][0]), 0, t] for t in terms]
        found = []
        while lists:
            lists.sort()
            total, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                total += self.top[t]
                if total >= goal:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # what the blocks that hold the pivot allow, and where the first of them ends
            most, reach = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 60
            for x in lists[: pivot + 1]:
                own = self.items[x[2]]
                at = int(np.searchsorted(own, item)) if x[0] < item else x[1]
                if at < len(own):
                    block = at // POSTINGS
                    most += self.tops[x[2]][block]
                    reach = min(reach, int(own[min(len(own), (block + 1) * POSTINGS) - 1]) + 1)
            if most < goal:
                to = max(reach, item + 1)
            elif lists[0][0] == item:
                score = sum(float(self.weights[t][at]) for own, at, t in lists[: pivot + 1] if own == item)
                if score >= goal:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            kept = []
            for k, x in enumerate(lists):
                if k <= pivot and x[0] < to:
                    own = self.items[x[2]]
                    x[1] += int(np.searchsorted(own[x[1] :], to))
                    if x[1] == len(own):
                        continue
                    x[0] = int(own[x[1]])
                kept.append(x)
            lists = kept
        return found

    def passages(self, array: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of every window that scores enough, verified or rejected."""
        words = words_of(array)
        yield from self.exact(words)
        if not self.long:
            return
        term = self.terms(words.hashes())
        # passages start at every multiple of the longest item within a row; any window of two items lies wholly in one
        many = np.maximum(1, -(-words.counts // self.longest) - 2)
        many[words.counts == 0] = 0
        row = np.repeat(np.arange(len(many)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = words.rows[row] + k * self.longest
        end = np.minimum(start + 3 * self.longest, words.rows[row + 1])
        # (passage, telling term) of every word; a word lies in its own passage and the two before
        at = np.flatnonzero(term >= 0)
        at = at[np.diff(self.first)[term[at]] > 0]
        where = np.searchsorted(words.rows, at, "right") - 1
        own = (at - words.rows[where]) // self.longest
        base = (np.cumsum(many) - many)[where]
        keys = [(base + k)[good] * len(self.names) + term[at][good] for k in (own, own - 1, own - 2) for good in ((k >= 0) & (k < many[where]),)]
        key = np.unique(np.concatenate(keys))
        passage, t = key // max(1, len(self.names)), key % max(1, len(self.names))
        n = self.first[t + 1] - self.first[t]
        post = np.repeat(self.first[t] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair, inverse = np.unique(np.repeat(passage, n) * len(self.ids) + self.telling[post], return_inverse=True)
        likely = np.unique(pair[np.bincount(inverse, weights=self.gain[post], minlength=len(pair)) >= self.threshold / 2 - 1e-9] // len(self.ids)) if len(pair) else []
        for p in likely:
            a, b = int(start[p]), int(end[p])
            have = np.unique(term[a:b])
            have = have[have >= 0]
            hits = self.search(have.tolist())
            if hits:
                held = np.flatnonzero(term[a:b] >= 0)
                held = list(zip(held.tolist(), term[a:b][held].tolist(), strict=True))
                for item, _ in hits:
                    for hit in self.windows(item, held):
                        yield int(row[p]), item, *hit

    def exact(self, words: Words) -> Iterator[tuple[int, int, float, float, float]]:
        """Hits of short items: their words, one after the other."""
        raw = words.bytes
        h = words.hashes() if self.short else None
        for n, items in self.short.items():
            if len(h) < n:
                continue
            goals = np.unique(window_hash(np.concatenate([word_hashes(x) for x in items]), n)[::n])
            at = np.flatnonzero(np.isin(window_hash(h, n), goals))
            row = np.searchsorted(words.rows, at, "right") - 1
            inside = at + n <= words.rows[row + 1]
            for a, r in zip(at[inside].tolist(), row[inside].tolist(), strict=True):
                have = tuple(raw[x:y].tobytes() for x, y in zip(words.starts[a : a + n].tolist(), words.ends[a : a + n].tolist(), strict=True))
                for i in items.get(have, ()):
                    yield r, i, 1.0, 1.0, 1.0

    def windows(self, item: int, held: list[tuple[int, int]]) -> Iterator[tuple[float, float, float]]:
        """(score, question overlap, answer overlap) of windows twice the item's length, one from each of its words."""
        weight = self.own[item]
        spots = [(at, t) for at, t in held if t in weight]
        width, goal = 2 * sum(self.bags[item].values()), self.threshold - 1e-9
        counts, found, last = Counter(), [0, 0], 0
        for at, t in spots:
            while last < len(spots) and spots[last][0] < at + width:
                new = spots[last][1]
                counts[new] += 1
                for k in (0, 1):
                    found[k] += counts[new] <= self.numbered[item][k].get(new, 0)
                last += 1
            score = sum(weight[x] for x, n in counts.items() if n)
            if score >= goal:
                yield score, *(n / max(1, sum(q.values())) for n, q in zip(found, self.numbered[item], strict=True))
            for k in (0, 1):
                found[k] -= counts[t] <= self.numbered[item][k].get(t, 0)
            counts[t] -= 1


def indexes(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", threshold: float = 0.6, least_words: int = 8, block_items: int = BLOCK_ITEMS) -> Iterator[Index]:
    """Indexes of blocks of items; inverse document frequencies come from all items."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = rows.count()
    many = max(1, math.ceil(total / block_items))
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(many)))
    token = F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), ALONE, " $1 "), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " ")), " ")))
    frequency = rows.select(token.alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    length = F.size(F.split(F.trim(F.regexp_replace(F.regexp_replace("text", ALONE, " $1 "), "[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+", " ")), " "))
    mean = (rows.agg(F.avg(length)).first()[0]) or 1.0
    for b in range(many):
        block = numbered.where(F.col("block") == b)
        own = [(r.id, r.text) for r in block.select("id", "text").collect()]
        own = [x for x, w in zip(own, item_words([t for _, t in own]), strict=True) if w] if own else []
        if not own:
            continue
        terms = block.select(token.alias("t")).distinct()
        df = {r.t.encode(): r.n for r in frequency.join(terms, "t", "left_semi").collect()}
        yield Index(sorted(own, key=lambda x: (x[0] is None, x[0], x[1])), lambda t, df=df: math.log(1 + (total - df.get(t, 1) + 0.5) / (df.get(t, 1) + 0.5)), mean, threshold, least_words)


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.75, least_words: int = 8, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id, item, score, question_overlap, answer_overlap): every item that a document holds."""
    spark = docs.sparkSession
    kind, item_kind = type_of(docs, id_col), type_of(items, item_col)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item {item_kind}, score double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(items, id_col=item_col, text_col=item_text_col, threshold=threshold, least_words=least_words, block_items=block_items):
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            kinds = None
            for batch in pieces(batches):
                hits = [h for h in index.passages(batch.column(1)) if h[3] >= overlap and h[4] >= overlap]
                if hits:
                    kinds = pa.array(index.ids)
                    columns = [batch.column(0).take(pa.array([h[0] for h in hits])), kinds.take(pa.array([h[1] for h in hits])), *[pa.array([h[i] for h in hits], pa.float64()) for i in (2, 3, 4)]]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "item", "score", "question_overlap", "answer_overlap"])

        found = base.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    best = out.groupBy("id", "item").agg(*[F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")])
    return best.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.75, least_words: int = 8, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs that hold no item, without moving a text."""
    at = docs.columns.index(text_col)
    for index in indexes(items, id_col=item_col, text_col=item_text_col, threshold=threshold, least_words=least_words, block_items=block_items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in pieces(batches, text_col):
                bad = {h[0] for h in index.passages(batch.column(at)) if h[3] >= overlap and h[4] >= overlap}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)])) if bad else batch

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
