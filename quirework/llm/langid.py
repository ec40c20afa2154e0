"""Language identification by rank-order profiles and out-of-place distance.

A profile lists the most frequent character n-grams (1 to 3 letters of a word, with
a mark for the word's edge) of a language in order of frequency.  A document's own
list is compared to each profile: every n-gram adds how far it is out of place, and
``size`` where the profile lacks it.  The nearest profile wins.

Profiles are fitted on a bounded sample of labelled rows (``profile_docs`` a language
on average, taken by hash of the id); documents are predicted over their whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text when nothing could be learned; equal distances go to the language that
sorts first; rows that repeat an id each get their row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm._text import keep_fraction, pieces, type_of

#: N-grams in a profile, labelled documents sampled for a language on average, longest n-gram.
SIZE, PROFILE_DOCS, LONGEST = 400, 2000, 3
EDGE = 1
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: is it a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def lettered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each word followed and preceded by ``EDGE``; row of each."""
    low = [" " + t.lower() + " " if t else "  " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(low)), [len(t) for t in low])
    points = np.where(letters()[points], points, EDGE)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != EDGE) | (points[:-1] != EDGE) | (rows[1:] != rows[:-1])
    return points[keep], rows[keep]


def grams(points: np.ndarray, rows: np.ndarray, bits: int, longest: int, edge: int = EDGE) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram as an integer) of every n-gram without an edge inside and with a letter."""
    found, of = [], []
    key = points
    for n in range(1, longest + 1):
        if n > 1:
            if len(points) < n:
                break
            key = (key[:-1] << bits) | points[n - 1 :]
        m = len(key)
        good = rows[:m] == rows[n - 1 :]
        for k in range(n):
            if n == 1 or 0 < k < n - 1:
                good &= points[k : k + m] != edge
        if n == 2:
            good &= (points[:m] != edge) | (points[1:] != edge)
        if n == 3:
            good &= points[1 : 1 + m] != edge
        found.append(key[good])
        of.append(rows[:m][good])
    return np.concatenate(of), np.concatenate(found)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return at, np.diff(np.append(at, len(sorted_keys)))


def fit_profiles(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", where: Column | None = None, size: int = SIZE, profile_docs: int = PROFILE_DOCS) -> dict[str, list[int]]:
    """Profiles by language: n-grams (21 bits a code point) in order of rank."""
    train = docs if where is None else docs.where(where)
    train = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    totals = {r[0]: r[1] for r in train.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return {}
    share = F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(min(1.0, profile_docs / n)))])
    sample = train.where(keep_fraction(F.col(id_col), share[F.col(lang_col)], "profiles")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            points, rows = lettered(batch.column(1).to_pylist())
            of, found = grams(points, np.asarray([names.index(x) for x in langs])[rows], 21, LONGEST)
            for k, name in enumerate(names):
                key = np.sort(found[of == k])
                at, n = runs(key)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(key[at]), pa.array(n)], ["lang", "gram", "n"])

    from pyspark.sql import Window

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {lang: [] for lang in sorted(totals)}
    for r in counted.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        out[r.lang].append(r.gram)
    return {k: v for k, v in out.items() if v}


class Profiles:
    """Profiles ready for whole batches: n-grams as 63-bit integers, and the rank of each in every profile."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size, self.names = size, sorted(profiles)
        ranks: dict[int, dict[int, int]] = {}
        for k, name in enumerate(self.names):
            for rank, g in enumerate(profiles[name]):
                ranks.setdefault(g, {})[k] = rank
        self.keys = np.asarray(sorted(ranks), np.int64)
        self.rank = np.full((len(self.keys) + 1, max(1, len(self.names))), -1, np.int64)
        for i, key in enumerate(self.keys):
            for k, rank in ranks[int(key)].items():
                self.rank[i, k] = rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.names:
            return ["und"] * n, np.zeros(n)
        points, rows = lettered(texts)
        # every letter of the batch, known or not, is a symbol of its own, in order of code points; 0 is none
        alphabet, symbol = np.unique(points, return_inverse=True)
        bits = max(2, int(len(alphabet) + 1).bit_length())
        of, key = grams(symbol + 1, rows, bits, LONGEST, edge=1 if len(alphabet) and alphabet[0] == EDGE else -1)
        wide = 3 * bits
        if wide + n.bit_length() < 63:
            both = np.sort((of << wide) | key)
            at, count = runs(both)
            of, key = both[at] >> wide, both[at] & ((1 << wide) - 1)
        else:
            order = np.lexsort((key, of))
            of, key = of[order], key[order]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])])) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.append(at, len(key)))
            of, key = of[at], key[at]
        order = np.lexsort((key, -count, of))
        of, key = of[order], key[order]
        first, length = runs(of)
        place = np.arange(len(of)) - np.repeat(first, length)
        keep = place < self.size
        of, key, place = of[keep], key[keep], place[keep]
        point = np.concatenate([[0], alphabet])
        known = np.zeros(len(key), np.int64)
        for k in (2, 1, 0):
            known = (known << 21) | point[(key >> (k * bits)) & ((1 << bits) - 1)]
        i = np.searchsorted(self.keys, known)
        i[(i == len(self.keys))] = 0
        i[self.keys[i] != known] = len(self.keys)
        rank = self.rank[i]
        apart = np.where(rank < 0, self.size, np.abs(rank - place[:, None]))
        held = np.bincount(of, minlength=n)
        away = np.stack([np.bincount(of, weights=apart[:, k], minlength=n) for k in range(len(self.names))], 1)
        best = away.argmin(1)
        score = 1 - away[np.arange(n), best] / np.maximum(held * self.size, 1)
        return [self.names[b] if h else "und" for b, h in zip(best, held, strict=True)], np.where(held > 0, np.clip(score, 0, 1), 0.0)


def identify(docs: DataFrame, profiles: dict[str, list[int]], *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id unless given) with lang_pred and score for every row."""
    keep = keep or [id_col]
    read = [*keep, *([] if text_col in keep else [text_col])]
    at = read.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    fields = ", ".join(f"`{c}` {type_of(docs, c)}" for c in keep)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(sent.value, size)
        for batch in pieces(batches, text_col, 1 << 20):
            langs, score = model.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*read).mapInArrow(predict, f"{fields}, lang_pred string, score double")
