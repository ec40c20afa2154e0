"""Fill-in-middle, near-duplicate vectors and importance resampling against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirework.llm import fim, jaccard, neardup_vectors, ngram_lm, pii, resampling, substring_dedup
from quirework.llm._text import NUM, numbered

DOCS = "doc_id long, text string, n long, form string, output string, marked string, weight long, rank long, _row long, id long"
ODD = [None, "", " ", "x", "é😀z", "\x01", "\x02", "a\x02d\x01e\x02", "has <P> inside", "<", "<P", "<S>", "tail <M", "a\nb\r\nc\n", "\x00nul", "Ärger 12 über-all", "$1 \\ {x}"]


def texts():
    r = random.Random(3)
    long = ["".join(r.choice("ab \n\x01\x02<P>é😀") for _ in range(30_000))]
    return ODD + ["".join(r.choice("abc <>PSM\n\t\x01\x02de😀") for _ in range(r.randint(1, 60))) for _ in range(150)] + long + ["same text here"] * 3


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "clash", "clash", "clash", 1, 2, 3, 4) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(texts()), (None, "no id"), (5, "an id again"), (5, "an id again")]


UNIT = {"char": "(?s).", "word": r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+", "line": r"[^\n]*\n|[^\n]+"}


def told(doc_id, text, unit, seed, fim_percent, spm_percent):
    text = text or ""
    hexes = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexes[8 * k : 8 * k + 8], 16) for k in range(4)]
    ends = [0] + [m.end() for m in re.finditer(UNIT[unit], text)]
    n = len(ends) - 1
    low, high = sorted(x % (n + 1) for x in h[:2])
    a, b = ends[low], ends[high]
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= fim_percent:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("unit", "seed", "fim_percent", "spm_percent"), [("char", "1", 90, 20), ("word", "s", 100, 50), ("line", "t", 60, 0)])
def test_fill_in_middle(spark, rows, unit, seed, fim_percent, spm_percent):
    out = fim.transform(frame(spark, rows), unit=unit, seed=seed, fim_percent=fim_percent, spm_percent=spm_percent)
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted((told(i, t, unit, seed, fim_percent, spm_percent) for i, t in rows), key=str)
    back = out.select("doc_id", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_fill_in_middle_stays_in_the_jvm_without_a_shuffle(spark, rows):
    plan = fim.transform(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_fill_in_middle_of_nothing_and_bad_markers(spark):
    assert fim.transform(frame(spark, [])).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("<P>", "<S>", "<"), ("aXb", "X", "q")):
        with pytest.raises(ValueError, match="markers"):
            fim.transform(frame(spark, []), markers=bad)


def weigh(rows, target, runs, buckets):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(words[k : k + n]) for n in range(1, runs + 1) for k in range(len(words) - n + 1)]
        return len(words), Counter(zlib.crc32(g.encode()) % buckets for g in grams)

    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(), Counter()
    for _, _, c in docs:
        s += c
    for x in target:
        t += features(x)[1]
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = []
    for i, n, c in docs:
        u = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(k * gain[b] for b, k in c.items())
        out.append((i, n, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize(("runs", "buckets", "percent"), [(1, 10_000, 10), (2, 97, 30), (3, 1000, 100)])
def test_resampling(spark, rows, runs, buckets, percent):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcé0Z") for _ in range(r.randint(1, 5))) for _ in range(60)] + ["w" * 200]
    docs = [*rows, *((1000 + k, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 90)))) for k in range(120)), *[(2000, "one two three four five")] * 3]
    target = [" ".join(vocabulary[:20]), None, "", "abc 12"]
    wanted = weigh(docs, target, runs, buckets)
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = resampling.resample(frame(spark, docs).repartition(5), goal, percent=percent, runs=runs, buckets=buckets, least_words=5).collect()
    assert sorted((x[:4] for x in map(tuple, out)), key=str) == sorted(((i, n, w, s) for i, _, n, w, s in wanted), key=str)
    able = sorted(((-s, i is None, i) for i, words, _, _, s in wanted if words >= 5))
    drawn = sorted((x.rank, x.doc_id, x.score) for x in out if x.rank is not None)
    assert drawn == [(k + 1, i, -s) for k, (s, _, i) in enumerate(able[: percent * len(able) // 100])]


def test_resampling_of_nothing(spark, rows):
    goal = spark.createDataFrame([], "text string")
    assert resampling.resample(frame(spark, []), goal).count() == 0
    assert resampling.resample(frame(spark, rows), goal).count() == len(rows)


def test_csr_blocks_are_read_in_place_of_texts(spark, rows):
    matrix = resampling.blocks(frame(spark, rows).repartition(2), runs=1, buckets=50)
    assert matrix.columns == ["ids", "n_words", "ends", "buckets", "counts"] and matrix.count() < len(rows)
    assert int(resampling.column_sums(matrix, 50).sum()) == sum(n for _, _, n, _, _ in weigh(rows, [], 1, 50))


VECTORS = "vec_id long, embedding array<double>, label int, num long, key long, kind string, row long, n_links long"


def cloud(seed=1):
    """(id, vector, label): groups of near copies, exact and scaled copies, and rows that link with nothing."""
    r = np.random.default_rng(seed)
    out = []
    for label in (0, 1, 2):
        bases = r.standard_normal((25, 16))
        for k, base in enumerate(bases):
            for _ in range(1 + k % 4):
                out.append((base + r.standard_normal(16) * r.choice([0, 0.02, 0.2]) * np.abs(base).mean(), label))
        out += [(bases[0] * 3, label), (bases[1] * 1e-150, label), (bases[2] * 1e150, label), (-bases[0], label)]
    hot = r.standard_normal(16)
    out += [(hot + r.standard_normal(16) * 0.03, 1) for _ in range(60)] + [(hot, 1)] * 20 + [(bases[3][:8], 2), (bases[3][:8], 2), (bases[4], None)]
    rows = [(k, [float(y) for y in x], label) for k, (x, label) in enumerate(out)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16]
    rows += [(5000 + k, x, 1) for k, x in enumerate(odd)] + [(None, rows[0][1], 0), (7, rows[-1][1], 2), (7, rows[9][1], 0)]
    random.Random(seed).shuffle(rows)
    return rows


def brute(rows, cosine):
    good = []
    for k, (_, x, label) in enumerate(rows):
        ok = label is not None and x and all(y is not None and math.isfinite(y) for y in x) and any(x)
        good.append(np.asarray(x) / max(map(abs, x)) if ok else None)
    unit = [None if x is None else x / np.sqrt((x * x).sum()) for x in good]
    links = {k: {j for j in range(len(rows)) if j != k and unit[k] is not None and unit[j] is not None and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine} for k in range(len(rows))}
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[k][0], len(links[k]), least, rows[k][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize(("part", "few"), [(1024, 12), (16, 12), (1024, 2)])
def test_near_duplicate_vectors(spark, part, few):
    rows = cloud()
    df = spark.createDataFrame([(i, x, label, 1, 2, "clash", 3, 4) for i, x, label in rows], VECTORS).repartition(3)
    out = neardup_vectors.near_duplicates(df, cosine=0.98, recall=1 - 1e-9, part=part, few=few)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, 0.98)


def test_recall_at_the_threshold():
    """Pairs at exactly the threshold's angle share a key as often as the number of tables promises."""
    r = np.random.default_rng(4)
    bits, tables = neardup_vectors.shape(50_000, 0.98)
    a = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    meet = (neardup_vectors.keys(a, bits, tables, 12) == neardup_vectors.keys(b, bits, tables, 12)).any(1)
    assert meet.mean() > 0.985


def test_more_classes_take_more_bits_and_tables():
    shapes = [neardup_vectors.shape(n, 0.98) for n in (1, 500, 10**6, 10**9)]
    assert shapes == sorted(shapes) and shapes[-1][0] < 34 and shapes[-1][1] < 60


def test_near_duplicate_vectors_of_nothing_and_without_labels(spark):
    none = spark.createDataFrame([], VECTORS)
    assert neardup_vectors.near_duplicates(none).count() == 0
    rows = [(k, [1.0, 0.0, float(k)], None) for k in range(3)] + [(9, [2.0, 0.0, 0.0], 4)]
    df = spark.createDataFrame([(i, x, label, 1, 2, "clash", 3, 4) for i, x, label in rows], VECTORS)
    got = {x.vec_id: x.component_id for x in neardup_vectors.near_duplicates(df, label_col=None).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 9: 0}


def multiplied(spark, folder):
    """Frames of eight rows in which rows of files were multiplied or moved after the read, by name."""
    spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(40)), "en", "a", 1) for k in range(4)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(folder)
    read = lambda: spark.read.parquet(folder)
    two = spark.range(2).withColumnRenamed("id", "_k")
    frames = {"exploded": read().withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_k"), "joined": read().crossJoin(F.broadcast(two)).drop("_k"), "united": read().unionAll(read()), "cached": read().unionAll(read()).cache(), "twice": spark.read.parquet(folder, folder)}
    return frames | {"filtered": read().where("doc_id >= 0").select("*").withColumn("n_chars", F.lit(2))}


def test_every_row_of_any_plan_has_a_number(spark, tmp_path):
    for name, frame in multiplied(spark, str(tmp_path / "d")).items():
        want = 4 if name == "filtered" else 8
        assert frame.count() == want and numbered(frame).select(NUM).distinct().count() == want, name


@pytest.mark.parametrize("name", ["exploded", "united"])
def test_operators_on_rows_that_were_multiplied(spark, tmp_path, name):
    frame = multiplied(spark, str(tmp_path / "d"))[name]
    gone = substring_dedup.dedup(frame, width=35).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, gone)) == sorted([(k, 40, 40) for k in range(4)] * 2)
    linked = jaccard.links(frame, width=4, num=85, den=100).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, linked)) == sorted([(k, 37, k) for k in range(4)] * 2)
    assert sorted(r.doc_id for r in jaccard.distinct(frame, width=5, num=80, den=100).select("doc_id").collect()) == [0, 1, 2, 3]
    scored = ngram_lm.score(frame, F.lit(True)).select("doc_id", "n_tokens", "train_tokens").collect()
    assert sorted(map(tuple, scored)) == sorted([(k, 41, 328) for k in range(4)] * 2)


def test_frequent_tokens_are_indexed_by_pairs(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet").select("text").toPandas()["text"]
    sets, _ = jaccard.shingle_sets(pa.array(texts), 4)
    names, many = np.unique(np.concatenate(sets), return_counts=True)
    pairs = singles = 0
    for x in sets:
        held = many[np.searchsorted(names, x)]
        order = np.lexsort((x, held))
        order = order[held[order] > 1]
        often = held[order] >= jaccard.FREQUENT
        every = jaccard.signatures(len(x), len(x) - len(order), x[order], often, 85, 100)
        rare = jaccard.signatures(len(x), len(x) - len(order), x[order][~often], often[~often], 85, 100)
        pairs, singles = pairs + len(every) - len(rare), singles + len(rare)
    assert pairs > 0
    assert singles > 0


def test_looser_spans_never_touch_others():
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["192.168.0.7", "4111 1111 1111 1111", "+44 20 7946 0018", "a@b.example", " x (at) y dot com ", "1.2.3.999", "0049 30 123456", ".", " ", "7", "word "]) for _ in range(r.randrange(1, 25)))
        base = pii.base_spans(text)
        proposals = []
        for kind in ("ip", "card", "phone"):
            proposals += [(m.start(), m.end(), kind) for m in pii.LOOSE[kind].finditer(text)]
        proposals += [(m.start(), m.end(), "email") for m in pii.LOOSE["email"].finditer(text)]
        taken, expected = [s[:2] for s in base], [(*s, True) for s in base]
        for a, b, kind in sorted(proposals, key=lambda s: (s[0], -s[1])):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                expected.append((a, b, kind, False))
        got = pii.candidates(text, base)
        # looser addresses are sought only where the text spells out an "at"
        assert got == [s for s in expected if s[3] or s[2] != "email" or " at " in text or "(at)" in text]


def test_many_spans_in_one_text_take_time_in_proportion():
    text = "call 0049 30 1234567 or 10.20.30.400 and 4111 1111 1111 1112; " * 16000
    began = time.monotonic()
    assert len(pii.candidates(text, pii.base_spans(text))) >= 16000
    assert time.monotonic() - began < 20
