"""Queries op1 to op13 over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import decontam, fim, jaccard, langid, mixing, neardup_vectors, ngram_lm, pii, resampling, substring_dedup, topk, toxicity
from quirework.llm._text import bucket, small_batches
from quirework.llm.token_counts import token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_lm.score(table(spark, sf_dir, "documents"), bucket(F.col("doc_id"), 5) != 1)
    return out.select("doc_id", (bucket(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=bucket(F.col("doc_id"), 5) != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit_profiles(docs, where=bucket(F.col("doc_id"), 4) != 2)
    out = langid.identify(docs, profiles)
    return out.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents"), unit="char", seed="1", fim_percent=90, spm_percent=20)
    digests = [F.sha2(x.cast("binary"), 256).alias(k) for k, x in (("output_sha256", F.col("output")), ("restored_sha256", fim.restored(F.col("output"), F.col("form"))))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, runs=1, buckets=10_000, seed="2024")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2:3].isdigit()}


ORACLE = {
    "op1_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS weight FROM g),
c AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, 2 * source_size / CAST(weight AS DOUBLE) AS ratio FROM w),
a AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS whole FROM c),
l AS (SELECT *, (CAST(1.5 AS DOUBLE) * whole - capped) / open AS level FROM a),
t AS (SELECT *, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), 0) * weight) AS target FROM l),
p AS (SELECT source, source_size, n, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS sure FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target - sure * source_size ELSE 0 END AS rest, CASE WHEN source_size > 0 THEN (target - sure * source_size) / source_size ELSE 0 END AS r, CAST(4 AS DOUBLE) * source_size / n AS long FROM p),
u AS (SELECT d.doc_id, d.size, q.*, (CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u, least(greatest(r * least(CAST(1 AS DOUBLE), long / greatest(d.size, 1)), CAST(1e-9 AS DOUBLE)), CAST(1 AS DOUBLE) - CAST(1e-9 AS DOUBLE)) AS pi FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, (u / (1 - u)) / (pi / (1 - pi)) AS odds FROM u),
s AS (SELECT *, least(floor(odds / (1 + odds) * CAST(16777216 AS DOUBLE)), 16777215) AS spot FROM k),
b AS (SELECT source, spot, any_value(rest) AS rest, sum(size) AS words FROM s GROUP BY 1, 2),
e AS (SELECT source, spot, rest, sum(words) OVER (PARTITION BY source ORDER BY spot) AS reach FROM b),
f AS (SELECT source, coalesce(min(spot) FILTER (WHERE reach > rest), 16777216) AS stop, coalesce(max(reach) FILTER (WHERE reach <= rest), 0) AS fits FROM e GROUP BY 1),
m AS (SELECT s.*, f.stop, s.rest - f.fits AS gap FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source),
z AS (SELECT source, min(struct_pack(d := abs(size - gap), s := spot, i := doc_id)).i AS closing FROM m WHERE spot >= stop AND size > 0 AND size < 2 * gap GROUP BY 1)
SELECT m.doc_id, m.size, m.source_size, m.target, CAST(least(m.sure + CASE WHEN m.r > 0 AND (m.spot < m.stop OR (m.size > 0 AND m.doc_id = z.closing)) THEN 1 ELSE 0 END, 2) * m.size AS BIGINT) AS taken FROM m LEFT JOIN z ON m.source IS NOT DISTINCT FROM z.source""",
    "op7_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS k FROM w WHERE len(ws) >= 35),
win AS (SELECT doc_id, k, array_to_string(ws[k:k + 34], ' ') AS s FROM k),
dup AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM win SEMI JOIN dup USING (s)),
one AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
d AS (SELECT doc_id, r, list_sort(list_distinct(CASE WHEN len(ws) >= 4 THEN list_transform(list_zip(ws, ws[2:], ws[3:], ws[4:], true), lambda x: x[1] || ' ' || x[2] || ' ' || x[3] || ' ' || x[4]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM w),
c AS (SELECT s, min(r) AS c, min(doc_id) AS least, len(s) AS n FROM d WHERE len(s) > 0 GROUP BY s),
t AS (SELECT c, n, unnest(s) AS t FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
m AS (SELECT reach.a AS c, min(least) AS far FROM reach JOIN c ON c.c = reach.b GROUP BY 1)
SELECT doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(least(c.least, far), doc_id) AS component_id FROM d LEFT JOIN c ON d.s = c.s LEFT JOIN m USING (c)""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
h AS (SELECT *, CAST(length(text) AS BIGINT) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(hex, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
      CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle, substr(text, high + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_near_duplicate_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r, b.r AS s, b.vec_id AS other FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= CAST(0.98 AS DOUBLE)),
reach AS (SELECT r, s, other FROM l UNION SELECT reach.r, l.s, l.other FROM reach JOIN l ON l.r = reach.s),
n AS (SELECT r, count(*) AS n FROM l GROUP BY 1), m AS (SELECT r, min(other) AS least FROM reach GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, least) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, least) AS kept FROM v LEFT JOIN n USING (r) LEFT JOIN m USING (r)""",
    "op13_importance_resampling": r"""
WITH table_of AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
dw AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL), qw AS (SELECT w, count(*) AS c FROM q GROUP BY 1),
hexed AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM qw)),
bytes AS (SELECT w, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM hexed),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, k: xor(c >> 8, crc[CAST(xor(c, k) & 255 AS BIGINT) + 1])), 4294967295) % 10000 AS bucket FROM bytes, table_of),
s AS (SELECT bucket, sum(c) AS s FROM dw JOIN hashed USING (w) GROUP BY 1), t AS (SELECT bucket, sum(c) AS t FROM qw JOIN hashed USING (w) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM s) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT r, sum(c * gain) AS weight FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY 1),
o AS (SELECT doc_id, len(ws) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (r)),
k AS (SELECT *, CASE WHEN n >= 20 THEN row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) END AS rank, count(*) FILTER (WHERE n >= 20) OVER () AS able FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * able // 100 THEN CAST(rank AS BIGINT) END AS rank FROM k""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
