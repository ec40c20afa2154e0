"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirework.llm import _text, decontam, exchange, jaccard, langid, mixing, ngram_lm, pii, substring_dedup, token_counts, topk, toxicity
from quirework.llm._text import bucket
from quirework.llm.elias_fano import EliasFano, Trie

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sig long, word string, size long"


def corpus():
    """(doc_id, text): copies, near copies, shared passages, one hot word, null, empty, blank, short and very long texts."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 6))) for _ in range(400)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \t\n", "One", "one", "two words", "two  words", "😀 é x <|endoftext|> y", "a " * 3000]
    passage, base = make(60), make(120)
    texts += [" ".join(make(r.randint(1, 150))) for _ in range(30)]
    texts += [" ".join(make(20) + passage + make(r.randint(0, 40))) for _ in range(12)]
    texts += [" ".join(base)] * 5
    for k in range(15):
        near = list(base)
        for _ in range(k % 6):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        texts.append("\n".join(near).upper() if k == 3 else " ".join(near))
    texts += [" ".join(make(20000)), " ".join(passage[:34]), " ".join(passage[:35]), "x " * 34 + "y", "x " * 40]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def rows():
    return corpus()


def frame(spark, rows, langs=("en", "fr", None), sources=("a", "a", "b", None)):
    return spark.createDataFrame([(i, t, langs[(i or 0) % len(langs)], sources[(i or 0) % len(sources)], len(t or ""), "clash", 1, "w", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode())


def test_top_k(spark):
    r = random.Random(1)
    vec = [(i, [float(np.float32(r.uniform(-1, 1))) for _ in range(8)]) for i in range(300)]
    vec += [(1000 + i, [0.5] * 8) for i in range(200)]  # ties
    vec += [(2000, None), (2001, [float("nan")] * 8), (2002, [None] * 8), (2003, [0.1] * 3), (2100, [0.2] * 3), (None, [0.3] * 8), (100, vec[100][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vec], "vec_id long, embedding array<float>, score string").repartition(4)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=10, bins=16).collect()}
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vec if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, a in {i: v for i, v in good if i % 100 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a))
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scored[:10])}
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_among_hundreds_of_near_copies(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=(4, 64))
    near = np.repeat(base, 300, 0) + r.normal(size=(1200, 64)) * 0.02
    near = (near / np.linalg.norm(near, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(near)], "vec_id long, embedding array<float>").repartition(4)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=10).collect()}
    whole = np.floor(near.astype(float) * 1024).astype(np.int64)
    want = {}
    for q in range(0, 1200, 100):
        s = whole @ whole[q]
        want |= {(q, k + 1): (i, int(s[i])) for k, i in enumerate(sorted((i for i in range(1200) if i != q), key=lambda i: (-s[i], i))[:10])}
    assert got == want


def test_decontamination(spark, rows):
    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(r.randint(8, 50)))) for i in range(120)] + [(500, None), (501, "too short")]
    body = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(r.randint(0, 300)))) for i in range(80)]
    leaked = {i: items[i] for i in range(0, 80, 7)}
    body = [(i, f"{t} {leaked[i][1].upper() if i % 2 else leaked[i][1]}. {t}" if i in leaked else t) for i, t in body] + [(900, None), (901, "")]
    d = spark.createDataFrame([(i, t, 0) for i, t in body], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.leaks(d, b).collect()}
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9]+", (t or "").lower())) + " "
    want = {(i, k) for i, t in body for k, x in items[:120] if plain(x) in plain(t)}
    assert want == got and len(want) == len(leaked)
    assert {(x.doc_id, x.item_id) for x in decontam.leaks(d, b, block_items=25).collect()} == got
    assert sorted(x.doc_id for x in decontam.clean(d, b).collect()) == sorted(i for i, _ in body if i not in leaked)
    assert decontam.leaks(d, b.limit(0)).count() == 0 and decontam.leaks(d.limit(0), b).count() == 0


def test_scattered_words_are_no_leak_beside_a_long_item(spark):
    item = [f"w{k}" for k in range(12)]
    filler = lambda n, k: [f"f{(7 * j + k) % 997}" for j in range(n)]
    apart = " ".join(x for k, w in enumerate(item) for x in [w, *filler(40, k)])
    texts = [apart, " ".join([*filler(90, 0), *item, *filler(3000, 1)]), " ".join([*filler(790, 2), *item]), " ".join(x for k, w in enumerate(item) for x in [w, *filler(1, k)])]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short, long = (1, " ".join(item)), (2, " ".join(f"z{k}" for k in range(400)))
    for items in ([short], [short, long]):
        b = spark.createDataFrame(items, "item_id long, text string")
        assert sorted((x.doc_id, x.item_id) for x in decontam.leaks(d, b).collect()) == [(1, 1), (2, 1), (3, 1)]
        assert [x.doc_id for x in decontam.clean(d, b).collect()] == [0]


def test_short_and_unspaced_items_are_found(spark):
    han = "水的化学式是什么答案是氢二氧一"
    items = [(1, "Who wrote Faust?"), (2, "yes"), (3, "水是什么"), (4, han), (5, "..."), (6, "who wrote  FAUST"), (7, "w1 w2 w3 w4 w5 w6 w7 w8 w9")]
    texts = ["so, who wrote\nFaust today", "who wrote a Faust", "Yes!", "yesterday", "他问水是什么呢", f"我们知道{han}吧", "who wrote", "faust", None, "", "faust who wrote faust"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    for some in (b, b.where("item_id <> 7 and item_id <> 4")):
        want = {(0, 1), (0, 6), (2, 2), (4, 3), (5, 4), (10, 1), (10, 6)} & {(i, r.item_id) for i in range(11) for r in some.collect()}
        assert {(x.doc_id, x.item_id) for x in decontam.leaks(d, some).collect()} == want
        assert {x.doc_id for x in decontam.clean(d, some).collect()} == set(range(11)) - {i for i, _ in want}


def test_wand_equals_every_item_scored():
    r = random.Random(4)
    items = [(i, " ".join(f"t{int(r.paretovariate(0.7)) % 60}" for _ in range(r.randint(8, 20)))) for i in range(300)]
    index = decontam.Index(items, lambda t: 1.0 + len(t), 14.0, 0.3)
    for _ in range(60):
        terms = sorted(r.sample(range(len(index.names)), 12))
        score = Counter()
        for t in terms:
            for i, w in zip(index.items[t], index.weights[t], strict=True):
                score[int(i)] += w
        want = {i: round(s, 9) for i, s in score.items() if s >= 0.3 - 1e-9}
        assert {i: round(s, 9) for i, s in index.search(terms)} == want


def water(sizes):
    names = sorted((s for s in sizes if s is not None), key=str) + [None] * (None in sizes)
    w, t = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, dict.fromkeys(names, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total, over = sum(w[s] for s in open_), 0.0
        for s in sorted(open_, key=str):
            t[s] += left * w[s] / total
        for s in list(open_):
            if t[s] >= 2 * sizes[s]:
                over += t[s] - 2 * sizes[s]
                t[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = over
    return t


def test_mixing(spark, rows):
    d = frame(spark, rows, sources=("z", "é", "b", None, "z", "z"))
    out = {r.doc_id: r for r in mixing.mix(d, carry=["source"]).collect()}
    sizes = Counter()
    for i, t in rows:
        sizes[out[i].source] += len(words(t))
        assert out[i].size == len(words(t)) and 0 <= out[i].taken <= 2 * out[i].size
    want, taken = water(sizes), Counter()
    for r in out.values():
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    # whole documents can't come nearer than half of the largest one
    largest = {s: max(r.size for r in out.values() if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= max(0.1 * want[s], largest[s] / 2) for s in sizes)
    assert {r.doc_id: r.copies for r in mixing.mix(d).collect()} == {i: r.copies for i, r in out.items()}


def test_mixing_of_nothing(none):
    assert mixing.mix(none).count() == 0


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, bound in ((0, 5), (1, 1), (7, 9), (500, 1 << 40), (3000, 3001)):
        v = np.sort(r.integers(0, bound, n))
        e, zero = EliasFano(v, bound), np.zeros(200, np.int64)
        assert (e.get(np.arange(n)) == v).all()
        x = r.integers(0, bound, 200)
        assert (e.successor(x, zero, zero + n) == np.searchsorted(v, x)).all()


def test_trie():
    key = np.unique(np.random.default_rng(2).integers(0, 40 * 90, 700))
    logp = -np.random.default_rng(3).random(len(key)) * 6
    trie = Trie(key // 90, key % 90, logp, 90)
    every = np.arange(40 * 90)
    got = trie.lookup(every // 90, every % 90)
    assert np.isnan(np.delete(got, key)).all() and np.abs(got[key] - logp).max() < 0.002


def test_lm_scores(docs, rows):
    out = {r.doc_id: r for r in ngram_lm.score(docs, bucket(F.col("doc_id"), 5) != 1, strength=50.0).collect()}
    toks = {i: [w.translate(LOW) for w in words(t)] + [None] for i, t in rows}
    train = {i for i in toks if zlib.crc32(str(i).encode()) % 5 != 1}
    c = Counter(w for i in train for w in toks[i])
    n, scale = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    pairs = Counter(p for i in train for p in zip(["<s>", *toks[i][:-1]], toks[i], strict=True))
    for i, ws in toks.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / scale) for w in ws), rel_tol=1e-9)
        s = sum(math.log10((pairs[v, w] + 50 * (c[w] + 0.5) / scale) / ((len(train) if v == "<s>" else c[v]) + 50)) for v, w in zip(["<s>", *ws[:-1]], ws, strict=True))
        assert abs(r.score - s) < 0.002 * len(ws)


@pytest.mark.parametrize("head", [0, 1, 7])
def test_lm_scores_do_not_depend_on_the_head(docs, rows, head):
    out = {r.doc_id: r for r in ngram_lm.score(docs, bucket(F.col("doc_id"), 5) != 1, strength=50.0, head=head).collect()}
    toks = {i: ["<s>", *[w.translate(LOW) for w in words(t)], None] for i, t in rows}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 5 != 1]
    c, v = Counter(w for i in train for w in toks[i][1:]), Counter(w for i in train for w in toks[i][:-1])
    pairs = Counter(p for i in train for p in zip(toks[i][:-1], toks[i][1:], strict=True))
    n, scale = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for i, ws in toks.items():
        s = sum(math.log10((pairs[a, b] + 50 * (c[b] + 0.5) / scale) / (v[a] + 50)) for a, b in zip(ws[:-1], ws[1:], strict=True))
        base = sum(math.log10((c[w] + 0.5) / scale) for w in ws[1:])
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(ws) - 1, sum(w in c for w in ws[1:]), n)
        assert abs(out[i].score - s) < 0.002 * len(ws) and math.isclose(out[i].base_score, base, rel_tol=1e-9)


def test_lm_sums_to_one(spark):
    """Over every text of one word and the unseen type, and on to the end: the chances behind a start, and behind each word, sum to one."""
    learned, types = [(0, "a a b c a b"), (0, "b a")], ["a", "b", "c"]
    asked = [(1, w) for w in [*types, "new", ""]] + [(2, f"{v} {w}") for v in types for w in [*types, "new"]]
    d = spark.createDataFrame(learned + asked, "doc_id long, text string")
    n, c = 10, {"a": 4, "b": 3, "c": 1, "</s>": 2}
    pairs = Counter({("<s>", "a"): 1, ("<s>", "b"): 1, ("a", "a"): 1, ("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 1, ("b", "</s>"): 1, ("b", "a"): 1, ("a", "</s>"): 1})
    p1 = lambda w: (c.get(w, 0) + 0.5) / (n + 0.5 * 5)
    p2 = lambda v, w: (pairs[v, w] + p1(w)) / (({"<s>": 2} | c).get(v, 0) + 1)
    for v in ("<s>", *types):
        assert math.isclose(sum(p2(v, w) for w in [*c, "new"]), 1)
    for head in (0, 2, 1 << 17):
        out = ngram_lm.score(d, F.col("doc_id") == 0, head=head, strength=1.0).where("doc_id > 0").collect()
        want = sorted(sum(math.log10(p2(v, w)) for v, w in zip(["<s>", *t.split()], [*t.split(), "</s>"], strict=True)) for _, t in asked)
        assert np.allclose(sorted(r.score for r in out), want, atol=0.005)


def test_lm_of_repeated_ids(spark):
    rows = repeated()
    out = ngram_lm.score(frame(spark, rows).repartition(3), F.col("doc_id") == 1).collect()
    c = Counter(w for i, t in rows if i == 1 for w in [*words(t), None])
    want = sorted((str(i), len(words(t)) + 1, sum(w in c for w in [*words(t), None])) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in out) == want


def test_lm_of_nothing(none, docs):
    assert ngram_lm.score(none, F.lit(True)).count() == 0
    assert ngram_lm.score(docs, F.lit(False)).where("score > 0 or score is null").count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_on_random_texts():
    r = random.Random(7)
    for _ in range(20000):
        t = "".join(r.choice("ab1290..@@+- ()%_é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == base_spans(t), t


def test_pii(spark):
    texts = [None, "", "mail me at a.b@c.de or call +1 (555) 555-0100 today", "server 10.0.0.1 and 999.1.1.1", "card 4111 1111 1111 1111 ok", "call (555) 555-0199 or tel 555-555-0123", "é😀 x@y.zz", "0" * 4000 + ".1.1.1", "plain"]
    d = spark.createDataFrame([(i, t, "c") for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, spans string")
    model = pii.fit(d)
    for r in pii.find(d, model).collect():
        t = texts[r.doc_id] if r.doc_id < len(texts) else texts[2]
        base = base_spans(t)
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert set(pii.written(base).split(",")) - {""} <= set(r.spans.split(","))
    red = {r.doc_id: r.text for r in pii.redact(d, model).collect()}
    assert red[0] is None and red[1] == "" and red[2].startswith("mail me at <EMAIL> or call <PHONE>") and red[8] == "plain"
    assert pii.find(d.limit(0), pii.fit(d.limit(0))).count() == 0


def test_reliabilities_tell_good_labelers_from_bad():
    r = random.Random(1)
    tally = Counter()
    for _ in range(4000):
        y = r.random() < 0.5
        tally[tuple(int(y if r.random() < p else not y) for p in (0.95, 0.9, 0.55))] += 1
    _, yes, no, _ = pii.reliabilities(sorted(tally.items()))
    assert yes[0] > 0.85 and no[0] < 0.15 and yes[2] - no[2] < 0.3


def test_toxicity(spark):
    r = random.Random(3)
    make = lambda bad: " ".join([f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnrs')}o" for _ in range(r.randint(5, 80))] + ["vequ" + r.choice("aeiou") for _ in range(3 * bad)])
    data = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    d = spark.createDataFrame([*[(i, t, "l") for i, t, _ in data], (900, None, "l"), (901, "", "l")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*[(i, y) for i, _, y in data], (1, None), (None, 1)], "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.score(d, toxicity.fit(d, labels, where=bucket(F.col("doc_id"), 5) != 0)).collect()}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in out.values()) and out[900].score == out[901].score
    flat = toxicity.fit(d, labels.where("toxic = 0"))
    assert toxicity.score(d, flat).where("predicted = 1").count() == 0
    assert toxicity.score(d.limit(0), flat).count() == 0


def test_substring_dedup(spark, docs, rows, none):
    width, starts = 35, Counter()
    toks = {i: words(t) for i, t in rows}
    for w in toks.values():
        starts.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = {r.doc_id: r for r in substring_dedup.dedup(docs, width=width).collect()}
    for i, w in toks.items():
        under = [False] * len(w)
        for k in range(len(w) - width + 1):
            if starts[tuple(w[k : k + width])] > 1:
                under[k : k + width] = [True] * width
        kept = b" ".join(x for x, u in zip(w, under, strict=True) if not u)
        assert (out[i].n_words, out[i].n_removed, out[i].kept_sha256) == (len(w), sum(under), hashlib.sha256(kept).hexdigest()), i
    assert sum(r.n_removed for r in out.values()) > 500
    assert substring_dedup.dedup(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup(docs, width=20)


def test_boundaries_depend_on_what_is_near():
    r = np.random.default_rng(5)
    for letters in [2, 3, 6] * 200:
        core = r.integers(0, letters, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        cuts = []
        for _ in range(2):
            left, right = (r.integers(0, letters, r.integers(0, 30)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
            h = np.concatenate([left, core, right])
            b = substring_dedup.boundaries(h, np.zeros(len(h), np.int64)) - len(left)
            cuts.append({int(x) for x in b if substring_dedup.REACH <= x <= 60 - substring_dedup.REACH})
            assert np.diff(np.append(b, len(core) + len(right))).max() <= substring_dedup.CAPS[-1]
        assert cuts[0] == cuts[1]


def test_token_counts(docs, rows, none):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    tok = token_counts.load(path)
    for head in (1 << 17, 5):
        for r in token_counts.token_counts(docs, path, head=head, limit=100).collect():
            t = dict(rows)[r.doc_id] or ""
            n = len(tok.encode(t, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100)
    assert token_counts.token_counts(none, path).count() == 0


def test_language_id(spark, none):
    r = random.Random(6)
    sound = {"aa": "bcdaei", "bb": "xyzouw", "cc": "ßéèlmn"}
    text = lambda lang: " ".join("".join(r.choice(sound[lang]) for _ in range(r.randint(2, 7))) for _ in range(r.randint(3, 60)))
    data = [(i, text(k), k) for i, k in enumerate(list(sound) * 60)]
    d = spark.createDataFrame([*data, (900, None, "aa"), (901, "12 34 ... 😀", "bb"), (902, "", None), (0, data[0][1], "aa")], "doc_id long, text string, lang string")
    profiles = langid.fit_profiles(d, where=bucket(F.col("doc_id"), 4) != 2)
    out = langid.identify(d, profiles).collect()
    assert len(out) == len(data) + 4 and all(0 <= x.score <= 1 for x in out)
    got = {x.doc_id: x.lang_pred for x in out}
    assert got[900] == got[901] == got[902] == "und"
    held = [(i, k) for i, _, k in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i] == k for i, k in held)
    assert {x.lang_pred for x in langid.identify(d, {}).collect()} == {"und"}
    assert langid.identify(none, profiles).count() == 0 and langid.fit_profiles(none) == {}


def jaccard_components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = [x.translate(LOW) for x in words(t)]
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "num"), [(4, 85), (5, 80)])
def test_jaccard(docs, rows, width, num):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.links(docs, width=width, num=num, den=100).collect()}
    assert got == jaccard_components(rows, width, num, 100)


def test_jaccard_in_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    monkeypatch.setattr(_text, "FEW_TEXTS", 0)
    some = rows[:4] + rows[50:75]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.links(frame(spark, some)).collect()}
    assert got == jaccard_components(some, 4, 85, 100)


def test_jaccard_of_nothing(none):
    assert jaccard.links(none).count() == 0


def removals(rows, width=35):
    """Rows in order as (n_words, n_removed, digest), by plain loops over rows, whatever their ids."""
    toks, starts = [words(t) for _, t in rows], Counter()
    for w in toks:
        starts.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for w in toks:
        under = [False] * len(w)
        for k in range(len(w) - width + 1):
            if starts[tuple(w[k : k + width])] > 1:
                under[k : k + width] = [True] * width
        out.append((len(w), sum(under), hashlib.sha256(b" ".join(x for x, u in zip(w, under, strict=True) if not u)).hexdigest()))
    return out


def twins():
    """Two different words of 1,024 characters, a Thue-Morse word and its complement, and the same of 1,024 words."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)], [" ".join(("left", "right")[b ^ flip] for b in bits) for flip in (0, 1)]


def repeated():
    """Rows whose ids repeat or are null, with different and with equal texts."""
    r = random.Random(11)
    make = lambda n: [f"v{r.randrange(4000)}" for _ in range(n)]
    shared, near = make(63), make(80)
    other = [*near]
    other[40] = "changed"
    (one, two), (left, right) = twins()
    rows = [(1, " ".join(make(150) + shared + make(107))), (1, " ".join(shared)), (2, " ".join(make(9) + shared)), (1, " ".join(near)), (5, " ".join(near)), (9, " ".join(other))]
    rows += [(None, " ".join(other)), (None, " ".join(make(50))), (None, None), (7, ""), (7, None), (8, left), (8, right), (3, " ".join(near)), (3, " ".join(near))]
    return rows + [(20 + k, " ".join([*(f"q{j}" for j in range(39)), w])) for k, w in enumerate((one, two))]


def test_substring_dedup_of_repeated_ids(spark):
    rows = repeated()
    out = substring_dedup.dedup(frame(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == sorted((str(i), *x) for (i, _), x in zip(rows, removals(rows), strict=True))


def test_jaccard_of_repeated_ids(spark):
    rows = repeated()
    plain = jaccard_components(list(enumerate(t for _, t in rows)), 4, 85, 100)
    least = {}
    for k, (n, c) in plain.items():
        least.setdefault(c, []).extend([rows[k][0]] if rows[k][0] is not None else [])
    want = sorted((str(rows[k][0]), n, str(min(least[c], default=None))) for k, (n, c) in plain.items())
    got = jaccard.links(frame(spark, rows).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    kept = jaccard.distinct(frame(spark, rows).repartition(3), width=4, num=85)
    assert kept.count() == len({c for _, c in plain.values()}) and len(kept.columns) == 9


def test_hashes_of_thue_morse_words_differ():
    (one, two), (left, right) = twins()
    for which in (0, 1):
        h = _text.Words(pa.array([one, two, left, right])).hashes(which)
        assert h[0] != h[1] and len(np.unique(h)) == 4
        assert _text.window_hash(h[2:1026], 1024) != _text.window_hash(h[1026:], 1024)
    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 300))) for _ in range(3000)]
    assert len(np.unique(_text.Words(pa.array(texts)).hashes())) == len(set(texts) - {""})


def test_one_key_in_every_pack(spark):
    """A key of all documents costs a shard one entry a pack."""
    nums = np.arange(5000)
    sent = exchange.packed(nums, nums, np.full(5000, 12345, np.uint64), 64)
    assert sent.num_rows == 2 and len(sent.column("k0")[1].as_py()) == 4
    df = spark.createDataFrame([tuple(x) for x in zip(*[c.to_pylist() for c in sent.columns], strict=True)], exchange.WRITTEN)
    assert sorted((r.num, r.hits) for r in exchange.shared(df, 64).collect()) == [(k, 1) for k in range(5000)]


def test_products_that_do_not_fit_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e12] * 4), (1, [1e12] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        topk.top_k(df, F.col("vec_id") % 100 == 0)


def test_language_id_is_the_out_of_place_distance(spark):
    r = random.Random(8)
    sound = {"aa": "bcdaeié", "bb": "bcdouwz"}
    text = lambda lang: " ".join("".join(r.choice(sound[lang]) for _ in range(r.randint(1, 7))) + r.choice(["", ",", "!"]) for _ in range(r.randint(1, 80)))
    rows = [(i, text(k), k) for i, k in enumerate(list(sound) * 25)] + [(99, "Zażółć 12 gęślą", None), (100, "x " * 9000, None), (101, "bad cab русский текст и ещё bcd 漢字仮名", None), (102, "aaaa bbbb " * 50, None), (103, "".join(map(chr, range(0x4E00, 0x9000))) + " abc", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def ranked(texts, size=60):
        n = Counter()
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                w = f"\x01{w}\x01"
                n.update(w[k : k + m] for m in (1, 2, 3) for k in range(len(w) - m + 1) if w[k : k + m] != "\x01")
        return sorted(n, key=lambda g: (-n[g], sum(ord(c) << 21 * (len(g) - 1 - j) for j, c in enumerate(g))))[:size]

    profiles = {k: ranked([t for _, t, x in rows if x == k]) for k in sound}
    found = langid.fit_profiles(d, size=60)
    assert {k: [sum(ord(c) << 21 * (len(g) - 1 - j) for j, c in enumerate(g)) for g in v] for k, v in profiles.items()} == found
    for x in langid.identify(d, found, size=60).collect():
        mine = ranked([rows[[i for i, *_ in rows].index(x.doc_id)][1]])
        away = {k: sum(abs(p.index(g) - i) if g in p else 60 for i, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert x.lang_pred == best and math.isclose(x.score, 1 - away[best] / (60 * len(mine)), abs_tol=1e-9)


def test_toxicity_scores_are_the_weighted_grams(spark):
    r = random.Random(4)
    make = lambda bad: " ".join(["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(r.randint(5, 40))] + ["grumblex"] * bad)
    rows = [(i, make(i % 3 == 0)) for i in range(150)] + [(500, "Grumblex?! " * 3000), (501, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int"))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))

    def grams(text):
        flat = " " + "".join(c if c.isalnum() else " " for c in (text or "").lower()) + " "
        words = [f"\x01{w}\x01" for w in flat.split()]
        return {w[k : k + m] for w in words for m in (4, 5) for k in range(len(w) - m + 1)}

    def bucket_of(gram):
        h = 0x811C9DC5 + len(gram)
        for c in gram:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
            h ^= h >> 15
        return ((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - toxicity.BITS)

    for x in toxicity.score(d, model).collect():
        z = model.intercept + sum(weight.get(b, 0) for b in {bucket_of(g) for g in grams(dict(rows)[x.doc_id])})
        assert math.isclose(x.score, 1 / (1 + math.exp(-z)), rel_tol=1e-6, abs_tol=1e-12) and x.predicted == (x.score >= 0.5)
    # the sign of a gram's weight follows its log-count ratio
    p, q = Counter(), Counter()
    for i, t in rows[:150]:
        (p if i % 3 == 0 else q).update({bucket_of(g) for g in grams(t)})
    told = [b for b in weight if p[b] >= 30 and q[b] == 0]
    assert told and all(weight[b] > 0 for b in told)


def test_pii_adds_what_the_base_rules_miss(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    planted, rows = {}, []
    for i in range(300):
        filler = lambda n: " ".join(word() for _ in range(n))
        digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        kind = ["email", "phone", "base", "none", "version"][i % 5]
        hit = {"email": f"{word()} (at) {word()} (dot) com", "phone": f"({r.randint(200, 999)}) {r.randint(200, 999)}-{digits(4)}", "base": f"{word()}@{word()}.org", "none": word(), "version": f"version {digits(1)}.{digits(1)}.{digits(2)}"}[kind]
        before = {"email": "contact ", "phone": "call ", "base": "mail "}.get(kind, "")
        text = f"{filler(r.randint(3, 30))} {before}{hit} {filler(5)}"
        rows.append((i, text))
        at = text.index(hit)
        if kind in ("email", "phone"):
            planted[i] = (kind, at, at + len(hit))
    out = {x.doc_id: x.spans for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    caught = sum("%s:%d:%d" % s in out[i].split(",") for i, s in planted.items())
    assert caught >= 0.9 * len(planted)
    assert all(not out[i] for i in range(300) if i % 5 in (3, 4))


@pytest.mark.parametrize("op", ["mixing", "pii", "tokens", "toxic", "langid", "decontam"])
def test_repeated_and_null_ids(spark, op):
    rows = repeated()
    d = frame(spark, rows).repartition(2)
    many = Counter(str(i) for i, _ in rows)
    if op == "mixing":
        out = mixing.mix(d)
    elif op == "pii":
        out = pii.find(d, pii.fit(d))
    elif op == "tokens":
        P = pytest.importorskip("public_tokenizers")
        got = {str(x.doc_id): x.n_bytes for x in token_counts.token_counts(d, P.path("byte_bpe_50k.json")).collect()}
        assert got == {k: sum(len((t or "").encode()) for i, t in rows if str(i) == k) for k in many}
        return
    elif op == "toxic":
        out = toxicity.score(d, toxicity.fit(d, spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")))
    elif op == "langid":
        out = langid.identify(d, langid.fit_profiles(d))
    else:
        items = spark.createDataFrame([(1, rows[1][1]), (2, " ".join(f"z{k}" for k in range(4000)))], "item_id long, text string")
        assert {(x.doc_id, x.item_id) for x in decontam.leaks(d, items).collect()} == {(1, 1), (2, 1)}
        return
    assert Counter(str(x.doc_id) for x in out.collect()) == many
