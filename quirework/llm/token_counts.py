"""Token counts of a byte-level BPE vocabulary without materialising ids.

Pieces are counted once per distinct pre-token and joined to the per-document
pre-token frequencies.  The most frequent pre-tokens of a small sample (a bounded
table, which only decides where a pre-token is counted, never the result) are
counted up front and sent to the tasks; every other pre-token is dealt by its text.
There, rows of one pre-token lie side by side, its pieces are counted once, and the count
is joined to the frequencies of the documents on the spot, so texts are split only once.
A word that fills the corpus never lands in one task, and the shuffle carries the rare
pre-tokens only.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); rows that repeat an
id are pooled into one row whose counts add up; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm._text import keep_fraction, pieces, type_of

#: The same pre-tokens as the vocabulary's own splitter gives, for texts without an ``ODD`` character.
COMMON = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters whose class may differ between regular-expression libraries; texts with one take the vocabulary's splitter.
ODD = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0530-\u200f\u2070-\U0010ffff]")
#: How many frequent pre-tokens at most are counted up front, from how many sampled rows at most.
HEAD, HEAD_ROWS = 1 << 17, 4000


def splitter(vocabulary: str, specials: list[str]):
    """A function text -> Counter of pre-tokens; special strings are kept whole."""
    find = COMMON.findall
    parts = re.compile("|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) or r"(?!)")

    def split(text: str) -> Counter:
        if any(s in text for s in specials):
            out: Counter = Counter(parts.findall(text))
            for part in parts.split(text):
                out.update(split(part))
            return out
        if ODD.search(text):
            return Counter(text[a:b] for _, (a, b) in load(vocabulary).pre_tokenizer.pre_tokenize_str(text))
        return Counter(find(text))

    return split


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


@lru_cache(1)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def count_pieces(tokenizer, words: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, head: int = HEAD, head_rows: int = HEAD_ROWS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document.

    ``vocabulary`` is the path of a tokenizer file that every executor can open.
    """
    spark, kind = docs.sparkSession, type_of(docs, id_col)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, specials = docs.count(), special_strings(load(vocabulary))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, total = splitter(vocabulary, specials), Counter()
        for batch in pieces(batches, limit=1 << 20):
            for text in batch.column(0).to_pylist():
                total.update(split(text or ""))
        top = total.most_common(head)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    sample = docs.where(keep_fraction(F.col("id"), min(1.0, head_rows / max(rows, 1)), "head")).select("text")
    words = [r.word for r in sample.mapInArrow(sampled, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(head).collect()]
    known = spark.sparkContext.broadcast(dict(zip(words, count_pieces(load(vocabulary), words), strict=True)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, have = splitter(vocabulary, specials), known.value
        for batch in pieces(batches, limit=1 << 20):
            ids, keys, counts, sizes, of = [], [], [], [], batch.column(0)
            for row, text in enumerate(batch.column(1).to_pylist()):
                sure, text = 0, text or ""
                for word, n in split(text).items():
                    k = have.get(word)
                    if k is None:
                        ids.append(row), keys.append(word), counts.append(n), sizes.append(0)
                    else:
                        sure += k * n
                ids.append(row), keys.append(None), counts.append(sure), sizes.append(len(text.encode()))
            yield pa.RecordBatch.from_arrays([of.take(pa.array(ids, pa.int32())), pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["id", "word", "n", "n_bytes"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last = load(vocabulary), (None, 0)
        for batch in batches:
            words = batch.column(1).dictionary_encode()
            names = words.dictionary.to_pylist()
            # rows come in order, so only a batch's first pre-token can be known from the one before
            known = [last[1]] if names and names[0] == last[0] else []
            k = np.asarray(known + count_pieces(tokenizer, names[len(known) :]) + [1], np.int64)
            if names:
                last = names[-1], int(k[len(names) - 1])
            at = words.indices.fill_null(len(names)).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(batch.column(2).to_numpy() * k[at]), batch.column(3)], ["id", "n", "n_bytes"])

    # A row without a word holds what is already summed; its key spreads such rows evenly.
    seen = docs.mapInArrow(frequencies, f"id {kind}, word string, n long, n_bytes long").withColumn("key", F.coalesce("word", F.concat(F.lit("\0"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    dealt = seen.repartition("key").sortWithinPartitions("key").select("id", "word", "n", "n_bytes")
    joined = dealt.mapInArrow(counted, f"id {kind}, n long, n_bytes long")
    out = joined.groupBy("id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
