"""The pipeline's stages against what plain loops keep."""

import random
import re

import pytest

import corpus_pipeline
from quirework.llm.queries import ORACLE
from tests.llm.test_ops import jaccard_components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.checkpointed(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        n.append(docs.count())
    assert n[1] >= 0.95 * n[0] and n[4] == n[3] <= n[2] <= n[1]
    texts = [r.text for r in docs.collect()]
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", t) for t in texts)
    leaks = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    held = [" ".join(re.findall(r"\w+", t.lower())) for t in texts]
    assert not any(x in t for x in leaks for t in held)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert mixed.where("copy > 2 or taken <> size * 1 and taken <> size * 2").count() == 0 and mixed.count() > 0


def test_run_keeps_what_brute_force_keeps(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(500)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(make(r.randint(30, 90))) for _ in range(50)]
    for k in range(12):  # near copies, some too far from their text to link
        near = texts[k].split()
        for _ in range(k % 4):
            near[r.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    items = [" ".join(make(n)) for n in (20, 12, 3)]
    texts += [f"{' '.join(make(25))} {x.upper()}. {' '.join(make(25))}" for x in items]
    texts += [f"{' '.join(make(30))} a.b@c.de {' '.join(make(9))}", None, "", "12 34 ..."]
    rows = [(i, t, "aa" if i % 2 else "bb", "xyz"[i % 3], len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = [x for x in rows if re.search("[a-z]", x[1] or "")]
    groups = jaccard_components([x[:2] for x in kept], 5, 80, 100)
    single = [x for x in kept if groups[x[0]][1] == x[0]]
    assert len(kept) - 12 <= len(single) < len(kept)
    clean = [x for x in single if not any(f" {i} " in f" {re.sub('[^a-z0-9]+', ' ', x[1].lower())} " for i in items)]
    assert len(clean) == len(single) - len(items)
    redacted = [(i, t.replace("a.b@c.de", "<EMAIL>"), *rest) for i, t, *rest in clean]
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    base.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", redacted)
    mixed = base.execute(f"SELECT doc_id, size, taken FROM ({ORACLE['op3_mixing']})").fetchall()
    words = {x[0]: x[1] for x in redacted}
    want = sorted((i, c + 1, words[i]) for i, size, taken in mixed for c in range(taken // size))
    assert sorted((x.doc_id, x.copy, x.text) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want and want


# the first sentence of a well-known declaration, or words of no language
FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są obdarzeni rozumem i sumieniem",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van, az emberek ésszel és lelkiismerettel bírván",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
    "xq zzk wvv kkx qqj wxw zqk jjx vvq",
    "4711 ... 0815",
]


def test_language_stage_keeps_learned_languages_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = spark.createDataFrame([(-1 - i, t, None, None, len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(some), sf_dir)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in docs.collect())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, num long, copy string, size string, comp long"


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, long texts, clashing columns; and no rows at all."""
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(60))
    long = " ".join("".join(r.choice("hijklmn") for _ in range(5)) for _ in range(20000))
    rows = [(1, text, "en", "a", len(text), "x", 1, "c", "s", 1), (1, text, "en", "a", len(text), "x", 1, "c", "s", 1), (None, None, None, None, None, None, None, None, None, None), (3, "", "en", None, 0, None, None, None, None, None), (4, long, None, "a", None, "y", 2, "c", "s", 2), (None, text[::-1], None, None, None, None, None, None, None, None)]
    spark.createDataFrame([(1, None), (None, "zz yy xx ww vv uu tt ss rr")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # the long text is in no learned language, the repeated row stays once
    for some, most in ((rows, 2), ([], 0)):
        docs = spark.createDataFrame(some, COLUMNS)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.checkpointed(stage(spark, docs, str(tmp_path)))
            assert docs.columns == spark.createDataFrame([], COLUMNS).columns, name
        assert docs.count() == most
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert out.count() >= 0 and "taken" in out.columns
