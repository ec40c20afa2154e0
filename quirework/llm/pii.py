"""Personal data by weak supervision.

Base rules find e-mail addresses, IP addresses, card numbers and phone numbers; these
spans always stay.  Looser rules propose more candidates of the same kinds.  Labelers
vote on every candidate: its shape (regular expressions and checksums), gazetteers
(domain endings, card prefixes, calling formats), and the words around it.  Votes of
one pattern are counted over all documents; expectation-maximisation on those counts
estimates how reliable each labeler is, and how likely a pattern is personal data.  The
final span classifier, a logistic regression on features of the span and its
surroundings (not on the labelers), is trained on these likelihoods; a candidate that
it accepts, and that touches no accepted span, is added.

Everything fitted comes from counts over all documents: the distinct patterns are few,
whatever the size of the corpus.

Defined cases: null and empty texts hold no spans; rows that repeat an id each get their
row; without candidates the classifier accepts nothing; other columns are ignored.
Spans are in code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm._text import pieces, type_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, so the look-behind changes nothing
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Looser proposals: spelled-out addresses, spaced or bracketed dots, numbers in the usual groups without a country code.
LOOSE = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[\.\][0-9]{1,3}|\(\.\)[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[./][0-9]{4}){2}[./][0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])|(?<![0-9])00[1-9][0-9]{0,2}[\x20-][0-9][0-9\x20-]{6,14}[0-9]"),
}
# Gazetteers: common domain endings, card prefixes, words near each kind, words near other numbers.
ENDINGS = frozenset("com org net edu gov info io co uk de fr es it nl eu us ca".split())
NEAR = {
    "email": frozenset("email e-mail mail contact write courriel correo adresse".split()),
    "ip": frozenset("ip host server address login addr from".split()),
    "card": frozenset("card visa mastercard amex credit payment carte tarjeta karte".split()),
    "phone": frozenset("phone tel call mobile fax telephone telefon telefono cell".split()),
}
OTHER = frozenset("version v order invoice isbn id ref no nr number page chapter section".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def octet(digits: str) -> int:
    """The number, or 999 if it has more than three digits that count."""
    digits = digits.lstrip("0")
    return int(digits or "0") if len(digits) <= 3 else 999


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, by start, then kind as listed."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end(), "email"))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(octet(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, is base) of all proposals; looser ones that touch a base span are left out."""
    out = [(*s, True) for s in base]
    found = []
    if DIGIT.search(text):
        for kind in ("ip", "card", "phone"):
            found += [(m.start(), m.end(), kind) for m in LOOSE[kind].finditer(text)]
    if "(at)" in text or "[at]" in text or " at " in text:
        if " dot " in text or "(dot)" in text or "[dot]" in text or "(at)" in text or "[at]" in text:
            found += [(m.start(), m.end(), "email") for m in LOOSE["email"].finditer(text)]
    # base spans of different kinds may overlap: of those that start before b, only the furthest end counts
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    done = 0
    for a, b, kind in sorted(found, key=lambda s: (s[0], -s[1])):
        before = bisect_left(starts, b)
        if a >= done and (not before or reach[before - 1] <= a):
            done = b
            out.append((a, b, kind, False))
    return out


def surroundings(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    split = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
    return [w.lower() for w in split.findall(text[max(0, start - 40) : start])][-4:], [w.lower() for w in split.findall(text[end : end + 24])][:2]


def votes(text: str, span: tuple[int, int, str, bool]) -> tuple[int, ...]:
    """What each labeler says: 1 personal data, 0 not, -1 nothing."""
    a, b, kind, base = span
    s = text[a:b]
    digits = re.sub(r"[^0-9]", "", s)
    before, after = surroundings(text, a, b)
    shape = 1 if base else -1
    if kind == "email":
        check = 1 if re.search(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$", s) else -1
        end = re.split(r"[^A-Za-z0-9]+", s.lower())[-1]
        list_ = 1 if end in ENDINGS else 0 if not end.isalpha() else -1
    elif kind == "ip":
        parts = [octet(p) for p in re.findall(r"[0-9]+", s)]
        check = 1 if len(parts) == 4 and max(parts) <= 255 else 0
        list_ = 0 if parts[0] == 0 else 1 if parts[0] < 240 else -1
    elif kind == "card":
        check = 1 if 12 <= len(digits) <= 19 and luhn(digits) else 0
        list_ = 1 if digits[:1] in "3456" and digits[:1] else 0
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1
        list_ = 1 if s[0] == "+" or s.startswith(("(", "00")) else -1
    near = 1 if NEAR[kind].intersection(before) or NEAR[kind].intersection(after) else -1
    other = 0 if OTHER.intersection(before[-2:]) else -1
    edge = 0 if (a and (text[a - 1].isalnum() or text[a - 1] in "_/=")) or (b < len(text) and (text[b].isalnum() or text[b] == "_")) else -1
    return shape, check, list_, near, other, edge


def features(text: str, span: tuple[int, int, str, bool]) -> tuple[int, ...]:
    """Small counts that describe a span and its surroundings, for the classifier."""
    a, b, kind, _ = span
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    before, after = surroundings(text, a, b)
    joined = (a > 0 and text[a - 1].isalnum()) + (b < len(text) and text[b].isalnum())
    return (
        KINDS.index(kind), min(digits, 20), min(sum(not c.isalnum() for c in s), 8), int("@" in s), int(s[0] == "+"), int(s[0] == "("), int(" " in s), int("[" in s or "(" in s[1:]),
        int(bool(NEAR[kind].intersection(before))), int(bool(NEAR[kind].intersection(after))), int(bool(OTHER.intersection(before[-2:]))), joined,
    )


def one_hot(rows: list[tuple[int, ...]]) -> np.ndarray:
    """Indicators of each feature's values, by kind where it matters."""
    widths = (4, 21, 9, 2, 2, 2, 2, 2, 2, 2, 2, 3)
    out = np.zeros((len(rows), 1 + sum(widths)))
    out[:, 0] = 1
    for i, row in enumerate(rows):
        at = 1
        for x, w in zip(row, widths, strict=True):
            out[i, at + x] = 1
            at += w
    return out


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], steps: int = 60) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over (votes, count): prior, chances of a vote 1 in either class, and each pattern's likelihood."""
    v = np.asarray([p for p, _ in patterns])
    n = np.asarray([c for _, c in patterns], float)
    cast = v >= 0
    prior, yes, no = 0.5, np.full(v.shape[1], 0.85), np.full(v.shape[1], 0.25)
    for _ in range(steps):
        a = np.log(prior) + np.where(cast, np.where(v == 1, np.log(yes), np.log(1 - yes)), 0).sum(1)
        b = np.log(1 - prior) + np.where(cast, np.where(v == 1, np.log(no), np.log(1 - no)), 0).sum(1)
        q = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        prior = float(np.clip((n * q).sum() / n.sum(), 0.02, 0.98))
        for weight, table in ((n * q, yes), (n * (1 - q), no)):
            seen, one = (weight[:, None] * cast).sum(0), (weight[:, None] * (v == 1)).sum(0)
            table[:] = np.clip((one + (1.7 if table is yes else 0.5)) / (seen + 2), 0.02, 0.98)
    return prior, yes, no, q


class Model:
    """The span classifier, and what was estimated on the way."""

    def __init__(self, counts: list[tuple[tuple[int, ...], tuple[int, ...], int]], threshold: float):
        self.threshold, self.weights, self.labelers = threshold, None, None
        if not counts:
            return
        tally: Counter = Counter()
        for v, _, n in counts:
            tally[v] += n
        patterns = sorted(tally.items())
        self.prior, yes, no, q = reliabilities(patterns)
        self.labelers = list(zip(yes.tolist(), no.tolist(), strict=True))
        of = {p: x for (p, _), x in zip(patterns, q.tolist(), strict=True)}
        by: dict[tuple[int, ...], list[float]] = {}
        for v, f, n in counts:
            cell = by.setdefault(f, [0.0, 0.0])
            cell[0] += n
            cell[1] += n * of[v]
        rows = sorted(by)
        x, n, y = one_hot(rows), np.asarray([by[r][0] for r in rows]), np.asarray([by[r][1] / by[r][0] for r in rows])
        n = np.sqrt(n)  # a very frequent pattern must not drown the others
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            w -= np.linalg.solve(h, x.T @ (n * (p - y)) + 0.1 * w)
        self.weights = w

    def accepts(self, text: str, span: tuple[int, int, str, bool]) -> bool:
        if self.weights is None:
            return False
        z = float((one_hot([features(text, span)]) @ self.weights)[0])
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) >= self.threshold

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Base spans, and all spans with what the classifier adds."""
        base = base_spans(text)
        more = [s[:3] for s in candidates(text, base) if not s[3] and self.accepts(text, s)]
        return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else base


def fit(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.9) -> Model:
    """Estimate reliabilities and train the classifier on vote and feature counts of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in pieces(batches, limit=1 << 20):
            for text in batch.column(0).to_pylist():
                if text:
                    for s in candidates(text, base_spans(text)):
                        tally[votes(text, s), features(text, s)] += 1
        keys = list(tally)
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], kind), pa.array([k[1] for k in keys], kind), pa.array([tally[k] for k in keys], pa.int64())], ["v", "f", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "v array<int>, f array<int>, n long").groupBy("v", "f").agg(F.sum("n").alias("n")).collect()
    return Model(sorted((tuple(r.v), tuple(r.f), r.n) for r in rows), threshold)


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of base spans, and all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in pieces(batches, limit=1 << 20):
            base, every, digest = [], [], []
            for text in batch.column(1).to_pylist():
                b, e = model.spans(text or "")
                base.append(Counter(k for _, _, k in b))
                digest.append(hashlib.sha256(written(b).encode()).hexdigest())
                every.append(written(e))
            columns = [pa.array([b[k] for b in base], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digest, pa.string()), pa.array(every, pa.string())], ["id", *counts, "base_sha256", "spans"])

    schema = f"id {type_of(docs, id_col)}, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: Model, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows with every span replaced by its kind in angle brackets."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in pieces(batches, text_col, 1 << 20):
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    done, parts = 0, []
                    for a, b, kind in model.spans(text)[1]:
                        if b <= done:
                            continue
                        parts += [text[done : max(a, done)], f"<{kind.upper()}>"]
                        done = b
                    text = "".join(parts) + text[done:] if parts else text
                out.append(text)
            yield batch.set_column(at, text_col, pa.array(out, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(docs.schema[length_col].dataType))
    return out
