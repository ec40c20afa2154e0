"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes ratios.

Each document is the set of its character n-grams (4 and 5 characters of a word, with
its edges marked), hashed into 2**22 buckets.  On the training rows every bucket has a
log-count ratio r = log((p / |p|) / (q / |q|)) from its smoothed document counts p in
toxic and q in other rows; a logistic regression is fitted on x * r over the most
telling buckets.  Training takes a bounded sample of labelled rows (``max_rows`` rows and
``max_bytes`` of text for each label on average, by hash of the id, reweighted to the true
rates), which is what the driver holds; scoring reads every whole text once and keeps only
the buckets that have a weight.

Defined cases: a null text counts as empty and gets the score of a text without
features; rows without a label, or with labels that disagree (the higher one counts),
never stop the fit; with one label only, every score is that label's rate; rows that
repeat an id each get their row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm._text import keep_fraction, pieces, type_of

BITS, WIDTHS = 22, (4, 5)
#: Sampled rows and bytes of each label, buckets that may get a weight, least documents with a bucket.
MAX_ROWS, MAX_BYTES, MAX_FEATURES, LEAST = 4000, 32 << 20, 20000, 3
_PLAIN: list[np.ndarray] = []


def word_points() -> np.ndarray:
    """Each code point, or 1 (an edge) where it is neither letter nor digit."""
    if not _PLAIN:
        _PLAIN.append(np.fromiter((i if chr(i).isalnum() else 1 for i in range(0x110000)), np.uint32, 0x110000))
    return _PLAIN[0]


def hashed(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, buckets) of the n-grams of each width."""
    low = [" " + t.lower() + " " if t else "  " for t in texts]
    points = word_points()[np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)]
    rows = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 1) | (points[:-1] != 1) | (rows[1:] != rows[:-1])
    points, rows = points[keep], rows[keep]
    edge = np.concatenate([[0], np.cumsum(points == 1)])
    for width in WIDTHS:
        n = len(points) - width + 1
        if n <= 0:
            continue
        h = np.full(n, 0x811C9DC5 + width, np.uint32)
        for k in range(width):
            h ^= points[k : k + n]
            h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        # no edge strictly inside, and one row
        good = (edge[width - 1 : width - 1 + n] - edge[1 : 1 + n] == 0) & (rows[:n] == rows[width - 1 :])
        yield rows[:n][good], (h[good] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


@dataclass
class Model:
    """Weights by bucket (only those that have one) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def scorer(self):
        index = np.zeros(1 << BITS, np.int32)
        index[self.buckets] = np.arange(1, len(self.buckets) + 1)
        weights = np.concatenate([[0.0], self.weights])

        def score(texts: list[str | None]) -> np.ndarray:
            found = []
            for rows, h in hashed(texts):
                i = index[h]
                some = i > 0
                found.append((rows[some].astype(np.int64) << 32) | i[some])
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
            z = self.intercept + np.bincount(pairs >> 32, weights=weights[pairs & 0xFFFFFFFF], minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

        return score


def logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, sample: np.ndarray, ridge: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights on x * scale and intercept, by gradient descent with Adam steps; x is 1 at (rows, cols)."""
    n, m = len(y), len(scale)
    w, b = np.zeros(m + 1), np.log(max(sample[y == 1].sum(), 1e-9) / max(sample[y == 0].sum(), 1e-9))
    w[m] = b
    mean, var = np.zeros(m + 1), np.zeros(m + 1)
    total = sample.sum()
    for t in range(1, steps + 1):
        z = w[m] + np.bincount(rows, weights=(w[:m] * scale)[cols], minlength=n)
        e = sample * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.empty(m + 1)
        g[:m] = scale * np.bincount(cols, weights=e[rows], minlength=m) + ridge * w[:m]
        g[m] = e.sum()
        g /= total
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        w -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
    return w[:m] * scale, float(w[m])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", where: Column | None = None, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, max_features: int = MAX_FEATURES) -> Model:
    """Learn from the labelled rows for which ``where`` (on the id) holds."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    if where is not None:
        marked = marked.withColumnRenamed("id", id_col).where(where).withColumnRenamed(id_col, "id")
    held = docs.select(F.col(id_col).alias("id"), F.octet_length(text_col).alias("size")).groupBy("id").agg(F.sum("size").alias("size"))
    sizes = {r.y: (r.n, r.size or 0) for r in marked.join(held, "id", "left").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    if len(sizes) < 2:
        rate = float(next(iter(sizes), 0))
        return Model(np.zeros(0, np.int64), np.zeros(0), 500.0 if rate else -500.0)
    share = {y: min(1.0, max_rows / n, max_bytes / max(size, 1)) for y, (n, size) in sizes.items()}
    chosen = marked.where(keep_fraction(F.col("id"), F.when(F.col("y") == 1, F.lit(share[1])).otherwise(F.lit(share[0])), "toxic"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1 << 20):
            of, found = zip(*([*hashed(batch.column(0).to_pylist())] or [(np.zeros(0, np.int32), np.zeros(0, np.uint32))]), strict=True)
            pairs = np.unique((np.concatenate(of).astype(np.int64) << 32) | np.concatenate(found))
            ends = np.searchsorted(pairs >> 32, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists], ["y", "x"])

    # the sample has at most about 2 * max_rows ids: small enough for every task
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("text", "y").mapInArrow(features, "y int, x array<int>").toArrow()
    if not sample.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), -500.0)
    y = sample.column("y").to_numpy().astype(float)
    lists = sample.column("x").combine_chunks()
    cols = lists.flatten().to_numpy()
    rows = np.repeat(np.arange(len(y)), np.asarray(lists.value_lengths()))
    p = 1 + np.bincount(cols, weights=y[rows], minlength=1 << BITS)
    q = 1 + np.bincount(cols, weights=1 - y[rows], minlength=1 << BITS)
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    seen = p + q - 2
    telling = np.where(seen >= LEAST, np.abs(r) * np.sqrt(seen), 0)
    buckets = np.flatnonzero(telling >= max(1e-12, np.partition(telling, -max_features)[-max_features]))
    index = np.full(1 << BITS, -1, np.int64)
    index[buckets] = np.arange(len(buckets))
    some = index[cols] >= 0
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    w, b = logistic(rows[some], index[cols[some]], r[buckets], y, weight / weight.mean())
    return Model(buckets, w, b)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in pieces(batches, limit=1 << 20):
            s = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {type_of(docs, id_col)}, score double, predicted int")
    return out.withColumnRenamed("id", id_col)
