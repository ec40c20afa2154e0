"""Every query of the engine, with the SQL that says the same.

The tables stand in for the engine's own relations: documents for chapters (a line is a
block, a source a book), events for the usage ledger and state log, conversations for
requests and responses, orders and customers for jobs and users, line items for
segments, pages for XHTML documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.config import Budget
from quirework.functions import calendar as cal
from quirework.functions import money
from quirework.functions import text as t
from quirework.operators import budget, contract, names, segments, state
from quirework.plans import markup_queries, relations
from quirework.schemas import RUNNABLE, TRANSITIONS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: DuckDB's spelling of the white-space class.
WS = t.SPACE
LIMIT, MARGIN = 400, 20.0
GATE = Budget(max_source_tokens_per_request=200, max_output_tokens_per_request=230, max_requests_per_run=20, max_input_per_run=1300, max_output_per_run=1500, max_input_per_day=11500, max_output_per_day=14000, max_input_per_month=320_000, max_output_per_month=400_000, max_cost_per_run=0.013)
PRICES = (3.0, 15.0)


def fill(template: str, x: str) -> str:
    return template.replace("{x}", x)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES = f"""
WITH parts AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
trimmed AS (SELECT doc_id, lang, coalesce(source, '') AS source, line_no, regexp_replace(regexp_replace(line, '^{WS}', ''), '{WS}$', '') AS text FROM parts),
lines AS (SELECT * FROM trimmed WHERE text <> '')"""
TOKENS = "CAST(greatest(1, ceil((length(text) + length('ch' || doc_id) + 50) / 4.0)) AS BIGINT)"
SEGMENTS = LINES + f""",
segs AS (SELECT source AS book, doc_id AS chapter, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) - 1 AS BIGINT) AS order_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS chapter_index, text, {TOKENS} AS tokens FROM lines)"""
PACKED = LINES.replace("WITH parts", "WITH RECURSIVE parts") + f""",
segs AS (SELECT doc_id AS chapter, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS chapter_index, {TOKENS} AS tokens FROM lines),
walk AS (
  SELECT chapter, chapter_index, tokens, CAST(0 AS BIGINT) AS batch, tokens AS have FROM segs WHERE chapter_index = 1
  UNION ALL
  SELECT s.chapter, s.chapter_index, s.tokens, w.batch + CASE WHEN w.have + s.tokens > {segments.target(LIMIT, MARGIN)} THEN 1 ELSE 0 END, CASE WHEN w.have + s.tokens > {segments.target(LIMIT, MARGIN)} THEN s.tokens ELSE w.have + s.tokens END
  FROM walk w JOIN segs s ON s.chapter = w.chapter AND s.chapter_index = w.chapter_index + 1)"""


@query(LINES + " SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, text FROM lines")
def seg_extract_lines(spark, sf_dir):
    return segments.lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")


@query(SEGMENTS + " SELECT book, chapter, order_index, chapter_index FROM segs")
def seg_order_index(spark, sf_dir):
    return segments.segments(table(spark, sf_dir, "documents")).select("book", "chapter", "order_index", "chapter_index")


@query(SEGMENTS + " SELECT chapter, chapter_index, tokens FROM segs")
def seg_tokens(spark, sf_dir):
    return segments.paragraphs(table(spark, sf_dir, "documents")).select("chapter", "chapter_index", "tokens")


@query(
    LINES
    + f""", numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, nfc_normalize(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS n FROM lines)
SELECT doc_id, 'ch' || doc_id || '-p' || CASE WHEN k > 9999 THEN CAST(k AS VARCHAR) ELSE lpad(CAST(k AS VARCHAR), 4, '0') END || '-' || substr(sha256(n), 1, 10) AS id, sha256(n) AS checksum FROM numbered"""
)
def seg_checksum_id(spark, sf_dir):
    s = segments.lines(table(spark, sf_dir, "documents")).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).withColumn("n", t.normalized(F.col("text")))
    return s.select("doc_id", t.segment_id(F.concat(F.lit("ch"), F.col("doc_id").cast("string"), F.lit(".xhtml")), F.col("k"), F.col("n")).alias("id"), t.checksum(F.col("n")).alias("checksum"))


@query(LINES + " SELECT coalesce(d.source, '') AS book, CAST(count(DISTINCT d.doc_id) AS BIGINT) AS chapters, CAST(count(l.doc_id) AS BIGINT) AS paragraphs FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id GROUP BY 1")
def book_chapter_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    blocks = F.size(F.filter(F.transform(F.split("text", "\n"), t.trimmed), lambda x: x != ""))
    return d.groupBy(F.coalesce("source", F.lit("")).alias("book")).agg(F.count("doc_id").alias("chapters"), F.sum(F.when(F.col("text").isNull(), 0).otherwise(blocks)).alias("paragraphs"))


@query(PACKED + " SELECT chapter, chapter_index, tokens, batch FROM walk")
def batch_pack(spark, sf_dir):
    return segments.batches(table(spark, sf_dir, "documents"), LIMIT, MARGIN)


@query(PACKED + " SELECT chapter, batch, CAST(count(*) AS BIGINT) AS segments, CAST(sum(tokens) AS BIGINT) AS tokens FROM walk GROUP BY 1, 2")
def batch_sizes(spark, sf_dir):
    return segments.batches(table(spark, sf_dir, "documents"), LIMIT, MARGIN).groupBy("chapter", "batch").agg(F.count(F.lit(1)).alias("segments"), F.sum("tokens").alias("tokens"))


@query(SEGMENTS + f" SELECT chapter, chapter_index, tokens FROM segs WHERE tokens > {LIMIT}")
def unsafe_paragraphs(spark, sf_dir):
    return segments.paragraphs(table(spark, sf_dir, "documents")).where(F.col("tokens") > LIMIT).select("chapter", "chapter_index", "tokens")


@query(SEGMENTS + f" SELECT book, order_index, tokens FROM segs WHERE tokens > {LIMIT} ORDER BY book, order_index LIMIT 20")
def first20_unsafe(spark, sf_dir):
    s = segments.segments(table(spark, sf_dir, "documents"))
    return s.where(F.col("tokens") > LIMIT).select("book", "order_index", "tokens").orderBy("book", "order_index").limit(20)


@query(
    PACKED
    + """, own AS (SELECT w.*, coalesce(d.source, '') AS book FROM walk w JOIN documents d ON d.doc_id = w.chapter),
agg AS (SELECT book, CAST(sum(tokens) AS BIGINT) AS input_tokens, CAST(count(*) AS BIGINT) AS paragraphs, CAST(count(DISTINCT (chapter, batch)) AS BIGINT) AS calls FROM own GROUP BY 1),
out AS (SELECT *, CAST(ceil(input_tokens * CAST(1.2 AS DOUBLE)) AS BIGINT) AS output_tokens, CAST(greatest(1, ceil(calls / 10.0)) AS BIGINT) AS runs FROM agg)
SELECT book, paragraphs, input_tokens, output_tokens, calls, runs, strftime(DATE '2026-01-01' + CAST(runs - 1 AS INTEGER), '%Y-%m-%d') AS done_daily, CAST(input_tokens AS DOUBLE) / 1e6 * 3e0 + CAST(output_tokens AS DOUBLE) / 1e6 * 15e0 AS cost FROM out"""
)
def estimate_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    b = segments.batches(d, LIMIT, MARGIN).groupBy("chapter").agg(F.sum("tokens").alias("tok"), F.count(F.lit(1)).alias("par"), (F.max("batch") + 1).alias("calls"))
    own = d.select(F.col("doc_id").alias("chapter"), F.coalesce("source", F.lit("")).alias("book"))
    agg = b.join(own, "chapter").groupBy("book").agg(F.sum("par").alias("paragraphs"), F.sum("tok").alias("input_tokens"), F.sum("calls").alias("calls"))
    out = agg.withColumn("output_tokens", money.output_estimate(F.col("input_tokens"))).withColumn("runs", F.greatest(F.lit(1), F.ceil(F.col("calls") / 10)).cast("long"))
    return out.select("book", "paragraphs", "input_tokens", "output_tokens", "calls", "runs", cal.completion_date(F.to_date(F.lit("2026-01-01")), F.col("runs"), F.lit("DAILY")).alias("done_daily"), money.cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(3.0), F.lit(15.0)).alias("cost"))


NEUTRAL = "({x} = '' OR regexp_matches({x}, '^(?i)https?://\\S+$') OR regexp_matches({x}, '^[\\d\\s.,%$€£-]+$') OR NOT regexp_matches({x}, '\\p{L}'))"


@query(LINES + f" SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {fill(NEUTRAL, 'text')} AS neutral FROM lines")
def text_neutral_flag(spark, sf_dir):
    return segments.lines(table(spark, sf_dir, "documents")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), t.language_neutral(F.col("text")).alias("neutral"))


KEY = "sha256(coalesce(lang, 'en') || 'fr' || 'mock' || 'm1' || 'v1' || nfc_normalize(trim(regexp_replace(text, '" + WS + "', ' ', 'g'))))"


def keyed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", t.cache_key(F.coalesce("lang", F.lit("en")), F.lit("fr"), F.lit("mock"), F.lit("m1"), t.normalized(F.col("text"))).alias("cache_key"))


@query(f"SELECT doc_id, {KEY} AS cache_key FROM documents WHERE text IS NOT NULL")
def cache_key(spark, sf_dir):
    return keyed(spark, sf_dir)


CACHE = f"WITH k AS (SELECT doc_id, {KEY} AS cache_key FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT cache_key FROM k WHERE doc_id % 3 = 0)"


@query(CACHE + " SELECT doc_id FROM k WHERE cache_key IN (SELECT cache_key FROM c)")
def cache_hits(spark, sf_dir):
    k = keyed(spark, sf_dir)
    return k.join(k.where("doc_id % 3 = 0").select("cache_key"), "cache_key", "left_semi").select("doc_id")


@query(CACHE + " SELECT doc_id FROM k WHERE cache_key NOT IN (SELECT cache_key FROM c)")
def cache_misses(spark, sf_dir):
    k = keyed(spark, sf_dir)
    return k.join(k.where("doc_id % 3 = 0").select("cache_key"), "cache_key", "left_anti").select("doc_id")


@query("SELECT sha256(text) AS cache_key, CAST(max(doc_id) AS BIGINT) AS doc_id, CAST(count(*) AS BIGINT) AS writes FROM documents WHERE text IS NOT NULL GROUP BY 1")
def cache_last_write(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("cache_key"), "doc_id")
    return state.latest(d, "cache_key", F.col("doc_id"), F.col("doc_id")).select("cache_key", F.col("value").alias("doc_id"), F.col("events").alias("writes"))


TRIM = "regexp_replace(regexp_replace({x}, '^" + WS + "', ''), '" + WS + "$', '')"
RULE = f"CASE WHEN {fill(TRIM, 'b')} = '' THEN 'blank' WHEN {fill(TRIM, 'a')} = {fill(TRIM, 'b')} AND NOT {fill(NEUTRAL, fill(TRIM, 'a'))} THEN 'identical' END"


@query(
    f"""WITH q AS (SELECT conv_id, turn, text AS a FROM conversations WHERE role = 'user'), r0 AS (SELECT conv_id, turn - 1 AS turn, text AS b, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS k FROM conversations WHERE role = 'assistant'),
r AS (SELECT * FROM r0 WHERE k = 1)
SELECT coalesce(q.conv_id, r.conv_id) || ':' || coalesce(q.turn, r.turn) AS id, CASE WHEN q.turn IS NULL THEN 'unexpected' WHEN r.b IS NULL THEN 'missing' WHEN {RULE} IS NOT NULL THEN 'rejected' ELSE 'valid' END AS verdict, CASE WHEN q.turn IS NOT NULL AND r.b IS NOT NULL THEN {RULE} END AS reason
FROM q FULL JOIN r ON q.conv_id = r.conv_id AND q.turn = r.turn
UNION ALL SELECT conv_id || ':' || turn, 'duplicate', NULL FROM r0 WHERE k > 1"""
)
def contract_outcome(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    asked = c.where("role = 'user'").select(name(F.col("turn")).alias("id"), "text")
    given = c.where("role = 'assistant'").select(name(F.col("turn") - 1).alias("id"), F.col("text").alias("ord"), F.col("text").alias("translated"))
    return contract.outcome(asked, given)


@query(f"WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, {RULE} AS reason FROM p WHERE b IS NOT NULL")
def contract_rules(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("b", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return c.select("conv_id", "turn", contract.rule(F.col("text"), F.col("b")).alias("reason"))


def ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("job_id"), F.col("event_type").alias("provider"), F.floor("value").cast("long").alias("tin"), money.output_estimate(F.floor("value").cast("long")).alias("tout"), "ts")


LEDGER = "WITH l AS (SELECT event_id, user_id AS job_id, event_type AS provider, CAST(floor(value) AS BIGINT) AS tin, CAST(ceil(floor(value) * CAST(1.2 AS DOUBLE)) AS BIGINT) AS tout, ts FROM events)"
SUMS = "CAST(coalesce(sum(tin), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tout), 0) AS BIGINT) AS tokens_out"


def summed(rows, key):
    return rows.groupBy(key).agg(F.coalesce(F.sum("tin"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tout"), F.lit(0)).alias("tokens_out"))


@query(LEDGER + f" SELECT strftime(ts, '%Y-%m-%d') AS date_key, {SUMS} FROM l GROUP BY 1")
def usage_by_day(spark, sf_dir):
    return summed(ledger(spark, sf_dir), cal.date_key(F.col("ts")).alias("date_key"))


@query(LEDGER + f" SELECT strftime(ts, '%Y-%m') AS month_key, {SUMS} FROM l GROUP BY 1")
def usage_by_month(spark, sf_dir):
    return summed(ledger(spark, sf_dir), cal.month_key(F.col("ts")).alias("month_key"))


@query(LEDGER + f" SELECT strftime(timezone('America/Toronto', timezone('UTC', ts)), '%Y-%m-%d') AS date_key, {SUMS} FROM l GROUP BY 1")
def usage_tz_day(spark, sf_dir):
    return summed(ledger(spark, sf_dir), cal.date_key(F.col("ts"), "America/Toronto").alias("date_key"))


@query(LEDGER + " SELECT event_id, CAST(coalesce(sum(tin) OVER w, 0) AS BIGINT) AS used_in, CAST(coalesce(sum(tout) OVER w, 0) AS BIGINT) AS used_out FROM l WINDOW w AS (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def budget_running(spark, sf_dir):
    w = Window.partitionBy("job_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return ledger(spark, sf_dir).select("event_id", F.coalesce(F.sum("tin").over(w), F.lit(0)).alias("used_in"), F.coalesce(F.sum("tout").over(w), F.lit(0)).alias("used_out"))


GATED = (
    LEDGER.replace("WITH l", "WITH RECURSIVE l")
    + """, d AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(tin) AS BIGINT) AS di, CAST(sum(tout) AS BIGINT) AS do_ FROM l WHERE event_id % 2 = 1 GROUP BY 1),
m AS (SELECT strftime(ts, '%Y-%m') AS month, CAST(sum(tin) AS BIGINT) AS mi, CAST(sum(tout) AS BIGINT) AS mo FROM l WHERE event_id % 2 = 1 GROUP BY 1),
e AS (SELECT event_id, job_id % 10 AS run, CAST(ts AS DATE) AS day, tin, (row_number() OVER (PARTITION BY job_id % 10, CAST(ts AS DATE) ORDER BY event_id) - 1) // 4 AS batch FROM l WHERE event_id % 2 = 0),
b AS (SELECT run, day, batch, list(tin ORDER BY event_id) AS tok FROM e GROUP BY 1, 2, 3),
w AS (SELECT run, day, list({'b': batch, 'a': 0, 'z': len(tok)} ORDER BY batch) AS q, list(tok ORDER BY batch) AS t, CAST(NULL AS BIGINT) AS batch, CAST(NULL AS INTEGER) AS a, CAST(NULL AS INTEGER) AS z, CAST(NULL AS BIGINT) AS tokens_in, CAST(NULL AS BIGINT) AS tokens_out,
             CAST(NULL AS VARCHAR) AS scope, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS ui, CAST(0 AS BIGINT) AS uo, false AS stopped FROM b GROUP BY 1, 2
      UNION ALL
      SELECT run, day, CASE WHEN scope = 'HALVED' THEN list_concat([{'b': h.b, 'a': h.a, 'z': (h.a + h.z + 1) // 2}, {'b': h.b, 'a': (h.a + h.z + 1) // 2, 'z': h.z}], q[2:]) ELSE q[2:] END, t, h.b, h.a, h.z, tin, tout, scope,
             n + CASE WHEN scope IS NULL THEN 1 ELSE 0 END, ui + CASE WHEN scope IS NULL THEN tin ELSE 0 END, uo + CASE WHEN scope IS NULL THEN tout ELSE 0 END, stopped OR coalesce(scope IN ('RUN', 'DAY', 'MONTH', 'COST'), false)
      FROM (SELECT *, CASE WHEN (tin > 200 OR tout > 230) AND h.z - h.a > 1 THEN 'HALVED' WHEN stopped THEN 'NOT_REACHED' WHEN tin > 200 OR tout > 230 THEN 'REQUEST' WHEN n + 1 > 20 OR ui + tin > 1040 OR uo + tout > 1200 THEN 'RUN' WHEN di + ui + tin > 9200 OR do_ + uo + tout > 11200 THEN 'DAY' WHEN mi + ui + tin > 256000 OR mo + uo + tout > 320000 THEN 'MONTH' WHEN CAST(ui AS DOUBLE) / 1e6 * 3e0 + CAST(uo AS DOUBLE) / 1e6 * 15e0 + (CAST(tin AS DOUBLE) / 1e6 * 3e0 + CAST(tout AS DOUBLE) / 1e6 * 15e0) > 0.013e0 THEN 'COST' END AS scope
            FROM (SELECT *, CAST(ceil(tin * CAST(1.2 AS DOUBLE)) AS BIGINT) AS tout
                  FROM (SELECT w.run, w.day, w.q, w.t, w.n, w.ui, w.uo, w.stopped, w.q[1] AS h, CAST(list_sum(w.t[w.q[1].b + 1][w.q[1].a + 1:w.q[1].z]) AS BIGINT) AS tin, coalesce(di, 0) AS di, coalesce(do_, 0) AS do_, coalesce(mi, 0) AS mi, coalesce(mo, 0) AS mo
                        FROM w LEFT JOIN d ON d.day = w.day LEFT JOIN m ON m.month = strftime(w.day, '%Y-%m') WHERE len(w.q) > 0)))),
r AS (SELECT run, day, batch, CAST(row_number() OVER (PARTITION BY run, day, batch ORDER BY a) - 1 AS INTEGER) AS part, a, z, tokens_in, tokens_out, scope FROM w WHERE batch IS NOT NULL AND scope IS DISTINCT FROM 'HALVED')"""
)


def gated(spark, sf_dir):
    """Runs of a day (even events in batches of four, a job group a run) against what the ledger (odd events) holds of the day and the month."""
    l = ledger(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("month", cal.month_key(F.col("ts")))
    old = l.where("event_id % 2 = 1")
    sums = lambda key: old.groupBy(key).agg(F.sum("tin").alias(f"{key}_in"), F.sum("tout").alias(f"{key}_out"))
    e = l.where("event_id % 2 = 0").withColumn("run", F.col("job_id") % 10)
    e = e.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("run", "day").orderBy("event_id")) - 1) / 4))
    b = e.groupBy("run", "day", "month", "batch").agg(F.array_sort(F.collect_list(F.struct("event_id", "tin"))).alias("e")).select("run", "day", "month", "batch", F.col("e.tin").alias("sizes"))
    return budget.queue(b.join(sums("day"), "day", "left").join(sums("month"), "month", "left"), ["run", "day"], "batch", "sizes", GATE, prices=PRICES)


@query(GATED + " SELECT run, strftime(day, '%Y-%m-%d') AS day, batch, part, a, z, tokens_in, tokens_out, scope FROM r")
def budget_decision(spark, sf_dir):
    return gated(spark, sf_dir).select("run", F.date_format("day", "yyyy-MM-dd").alias("day"), "batch", "part", "a", "z", "tokens_in", "tokens_out", "scope")


STOPS = "('RUN', 'DAY', 'MONTH', 'COST')"


@query(GATED + f" SELECT run, strftime(day, '%Y-%m-%d') AS day, CAST(count(*) FILTER (WHERE scope IS NULL) AS BIGINT) AS admitted, CAST(count(*) FILTER (WHERE scope = 'REQUEST') AS BIGINT) AS failed, min(batch) FILTER (WHERE scope IN {STOPS}) AS stop, min(scope) FILTER (WHERE scope IN {STOPS}) AS scope FROM r GROUP BY 1, 2")
def budget_stop(spark, sf_dir):
    denied = F.col("scope").isin("RUN", "DAY", "MONTH", "COST")
    out = gated(spark, sf_dir).groupBy("run", F.date_format("day", "yyyy-MM-dd").alias("day"))
    return out.agg(F.count_if("admitted").alias("admitted"), F.count_if(F.col("scope") == "REQUEST").alias("failed"), F.min(F.when(denied, F.col("batch"))).alias("stop"), F.min(F.when(denied, F.col("scope"))).alias("scope"))


SPLIT = PACKED + """, b AS (SELECT chapter, batch, list(tokens ORDER BY chapter_index) AS t, list(chapter_index ORDER BY chapter_index) AS c FROM walk GROUP BY 1, 2),
cut AS (SELECT chapter, batch, t, 0 AS a, len(t) AS z FROM b
        UNION ALL
        SELECT chapter, batch, t, CASE side WHEN 0 THEN a ELSE a + CAST(ceil((z - a) / 2.0) AS INTEGER) END, CASE side WHEN 0 THEN a + CAST(ceil((z - a) / 2.0) AS INTEGER) ELSE z END
        FROM cut, (VALUES (0), (1)) AS s(side) WHERE z - a > 1 AND (list_sum(t[a + 1:z]) > 150 OR ceil(list_sum(t[a + 1:z]) * CAST(1.2 AS DOUBLE)) > 170)),
fit AS (SELECT *, NOT (list_sum(t[a + 1:z]) > 150 OR ceil(list_sum(t[a + 1:z]) * CAST(1.2 AS DOUBLE)) > 170) AS good FROM cut),
last AS (SELECT *, CASE WHEN good THEN row_number() OVER (PARTITION BY chapter, batch, good ORDER BY a) - 1 ELSE -1 END AS part FROM fit WHERE good OR z - a = 1)"""


@query(SPLIT + " SELECT b.chapter, b.batch, b.c[x.k] AS chapter_index, CAST(part AS INTEGER) AS part FROM last JOIN b USING (chapter, batch), LATERAL (SELECT unnest(range(last.a + 1, last.z + 1)) AS k) x")
def batch_split(spark, sf_dir):
    """Batches over a request limit, halved until they fit; a segment that does not fit alone has no part."""
    b = segments.batches(table(spark, sf_dir, "documents"), LIMIT, MARGIN)
    whole = b.groupBy("chapter", "batch").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "tokens"))).alias("s"))
    whole = whole.withColumn("parts", budget.requests(F.col("s.tokens"), 150, 170)).select("chapter", "batch", "s", "parts", F.posexplode("parts").alias("k", "p"))
    part = F.when(F.col("p.fits"), F.size(F.filter(F.slice("parts", F.lit(1), F.col("k")), lambda p: p["fits"]))).otherwise(-1)
    return whole.select("chapter", "batch", F.explode(F.slice("s.chapter_index", F.col("p.a") + 1, F.col("p.z") - F.col("p.a"))).alias("chapter_index"), part.alias("part"))


STATUS = "CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'TRANSLATED' END"


def statuses(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_linestatus") == "O", "PENDING").otherwise("TRANSLATED").alias("status"))


COUNTS = f"SELECT l_orderkey AS job_id, CAST(count(*) FILTER (WHERE {STATUS} = 'PENDING') AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE {STATUS} = 'TRANSLATED') AS BIGINT) AS translated, CAST(count(*) FILTER (WHERE {STATUS} = 'FAILED') AS BIGINT) AS failed FROM lineitem GROUP BY 1"


@query(COUNTS)
def status_counts(spark, sf_dir):
    is_ = lambda s: F.count_if(F.col("status") == s)
    return statuses(spark, sf_dir).groupBy("job_id").agg(is_("PENDING").alias("pending"), is_("TRANSLATED").alias("translated"), is_("FAILED").alias("failed"))


@query(f"SELECT o_orderkey AS job_id, CAST(coalesce(pending, 0) AS BIGINT) AS pending, CASE WHEN coalesce(pending + translated + failed, 0) = 0 THEN 0 ELSE CAST(floor(CAST(translated + failed AS DOUBLE) / (pending + translated + failed) * 100 + 0.5) AS BIGINT) END AS percent FROM orders LEFT JOIN ({COUNTS}) c ON c.job_id = o_orderkey")
def job_progress(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"))
    c = o.join(status_counts(spark, sf_dir), "job_id", "left").na.fill(0, ["pending", "translated", "failed"])
    done, all_ = F.col("translated") + F.col("failed"), F.col("pending") + F.col("translated") + F.col("failed")
    return c.select("job_id", "pending", F.when(all_ == 0, 0).otherwise(F.floor(F.try_divide(done, all_) * 100 + 0.5)).cast("long").alias("percent"))


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def orders_with_jobs(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS BIGINT) AS newest FROM orders")
def orders_newest(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("newest"))


JOB_STATES = ["READY", "PAUSED_BUDGET", "PAUSED_RATE_LIMIT", "TRANSLATING", "COMPLETED"]


@query("WITH j AS (SELECT o_orderkey AS id, ['READY', 'PAUSED_BUDGET', 'PAUSED_RATE_LIMIT', 'TRANSLATING', 'COMPLETED'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS status FROM orders) SELECT id, status FROM j WHERE status IN ('READY', 'PAUSED_BUDGET', 'PAUSED_RATE_LIMIT')")
def runnable_jobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    j = o.select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, JOB_STATES)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("status"))
    return j.where(F.col("status").isin(*RUNNABLE))


NAMES = [*TRANSITIONS, "COMPLETED", "FAILED", "CANCELLED"]
MOVES = ", ".join(f"('{a}', '{b}')" for a, bs in TRANSITIONS.items() for b in bs)
STATE_SQL = f"[{', '.join(repr(n) for n in NAMES)}][CAST(event_id % {len(NAMES)} + 1 AS INTEGER)]"


def state_of():
    return F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int"))


@query(f"WITH e AS (SELECT event_id, user_id, {STATE_SQL} AS s FROM events), p AS (SELECT event_id, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS a, s AS b FROM e) SELECT event_id, (a, b) IN ({MOVES}) AS allowed FROM p WHERE a IS NOT NULL")
def transition_allowed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("b", state_of()).withColumn("a", F.lag("b").over(Window.partitionBy("user_id").orderBy("event_id"))).where("a is not null")
    return e.select("event_id", state.allowed(F.col("a"), F.col("b")).alias("allowed"))


JUDGED = f"""WITH RECURSIVE allowed(a, b) AS (VALUES {MOVES}), n AS (SELECT event_id, user_id, ts, {STATE_SQL} AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w AS (SELECT user_id, k, event_id, ts, s AS tried, CAST(NULL AS VARCHAR) AS before, s AS state, true AS ok FROM n WHERE k = 1
      UNION ALL
      SELECT user_id, k, event_id, ts, s, state, CASE WHEN good THEN s ELSE state END, good
      FROM (SELECT n.*, w.state, (w.state, n.s) IN (SELECT (a, b) FROM allowed) AS good FROM w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1))"""


def judged(spark, sf_dir):
    return state.applied(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", state_of().alias("tried")), "user_id", "event_id", "tried")


@query(JUDGED + " SELECT event_id, before, CASE WHEN NOT ok THEN 'INVALID_JOB_TRANSITION' END AS error FROM w")
def transition_log(spark, sf_dir):
    """Users as jobs: every move tried, the state it met, and whether it was refused."""
    return judged(spark, sf_dir).select("event_id", "before", "error")


@query(JUDGED + " SELECT user_id, arg_max(state, k) AS status, 'moved by ' || max(event_id) FILTER (WHERE ok AND event_id % 2 = 0) AS error_message, min(ts) FILTER (WHERE ok) AS created_at, max(ts) FILTER (WHERE ok) AS updated_at, max(ts) FILTER (WHERE ok AND tried = 'TRANSLATING') AS last_run_at, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS refused FROM w GROUP BY 1")
def job_states(spark, sf_dir):
    """Jobs as their moves have left them; every other event brings a message."""
    rows = judged(spark, sf_dir).withColumn("message", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("moved by "), F.col("event_id").cast("string"))))
    return state.jobs(rows, "user_id", "event_id", "tried", "message", "ts")


@query("SELECT user_id, arg_max(event_type, event_id) AS status, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY 1")
def latest_state(spark, sf_dir):
    return state.latest(table(spark, sf_dir, "events"), "user_id", F.col("event_type"), F.col("event_id")).select("user_id", F.col("value").alias("status"), "events")


@query("""WITH RECURSIVE n AS (SELECT event_id, event_type, user_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT event_type, k, event_id, user_id AS holder, ts + INTERVAL 30 MINUTE AS until, true AS granted FROM n WHERE k = 1
      UNION ALL
      SELECT event_type, k, event_id, CASE WHEN refused THEN holder ELSE user_id END, CASE WHEN refused THEN until ELSE ts + INTERVAL 30 MINUTE END, NOT refused
      FROM (SELECT n.*, w.holder, w.until, w.until > n.ts AND w.holder <> n.user_id AS refused FROM w JOIN n ON n.event_type = w.event_type AND n.k = w.k + 1))
SELECT event_id, granted, holder AS held_by FROM w""")
def lease_holder(spark, sf_dir):
    """Event types as locks, users as holders: who is granted the lock, and who has it after each attempt."""
    return state.leases(table(spark, sf_dir, "events"), "event_type", "user_id", "ts", "event_id").select("event_id", "granted", "held_by")


@query("SELECT o_orderkey, CAST(greatest(50, ceil(o_totalprice / 1e5 * 3e0 * 100e0)) AS BIGINT) AS cents FROM orders")
def price_cents(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", money.price_cents(F.col("o_totalprice") / F.lit(1e5)).alias("cents"))


@query("WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS i, CAST(ceil(floor(o_totalprice) * CAST(1.2 AS DOUBLE)) AS BIGINT) AS o FROM orders) SELECT o_orderkey, CAST(ceil(greatest(1, ceil(i / 8000e0)) * 1.5e0) AS BIGINT) + 5 AS max_requests, CAST(ceil(i * 1.5e0) AS BIGINT) + 8000 AS max_input, CAST(ceil(o * 1.5e0) AS BIGINT) + 12000 AS max_output FROM o")
def paid_limits(spark, sf_dir):
    i = F.floor("o_totalprice").cast("long")
    limits = money.paid_limits(F.col("i"), F.col("o"))
    return table(spark, sf_dir, "orders").select("o_orderkey", i.alias("i")).withColumn("o", money.output_estimate(F.col("i"))).select("o_orderkey", *[c.alias(n) for n, c in limits.items()])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0)")
def free_eligible(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    used = o.where("o_orderkey % 20 = 0").groupBy("o_custkey").agg(F.min("o_orderdate").alias("free_translation_used_at"))
    return c.join(used, c.c_custkey == used.o_custkey, "left").where("free_translation_used_at is null").select("c_custkey")


@query("WITH s AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '\\.[^.]+$', ''), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS s FROM pages) SELECT page_id, CASE WHEN s = '' THEN 'chapter' ELSE s END AS slug FROM s")
def slug_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.slug(F.col("url")).alias("slug"))


PART = "list_transform(string_split(url, '/'), lambda p: CASE WHEN regexp_matches(p, '^.+\\.[^.]*$') THEN struct_pack(b := regexp_replace(p, '\\.[^.]*$', ''), e := regexp_extract(p, '(\\.[^.]*)$', 1)) ELSE struct_pack(b := p, e := '') END)"
CLEAN = "regexp_replace(regexp_replace(regexp_replace(x.b, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g')"
SAFE = f"array_to_string(list_transform({PART}, lambda x: CASE WHEN {CLEAN} = '' THEN 'file' ELSE {CLEAN} END || x.e), '/')"


@query(f"SELECT page_id, {SAFE} AS path FROM pages")
def sanitize_ascii(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.safe_path(F.col("url"), ascii_only=True).alias("path"))


@query(f"""WITH RECURSIVE f AS (SELECT page_id % 7 AS book, CASE WHEN page_id % 5 = 0 THEN 'text/' || substr(md5(url), 1, 1) || CASE WHEN page_id % 10 = 0 THEN '-2' ELSE '' END || '.html' ELSE 'text/' || substr(md5(url), 1, 1) || repeat('!', CAST(page_id // 7 AS INTEGER) + 1) || CASE WHEN page_id % 3 = 0 THEN '-2' ELSE '' END || '.html' END AS path, page_id FROM pages),
d AS (SELECT book, path, min(page_id) AS page_id FROM f GROUP BY 1, 2), c AS (SELECT *, regexp_matches(path, '^[A-Za-z0-9._/-]+$') AS safe, {SAFE.replace("url", "path")} AS c FROM d),
q AS (SELECT book, list({{'o': page_id, 'p': path, 'c': c}} ORDER BY page_id) FILTER (NOT safe) AS q, coalesce(list(path) FILTER (safe), []) AS used FROM c GROUP BY 1),
w AS (SELECT book, q, used, q[1].c AS c, 2 AS n, CAST(NULL AS BIGINT) AS page_id, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS new_path FROM q WHERE len(q) > 0
      UNION ALL
      SELECT book, CASE WHEN hit THEN q ELSE q[2:] END, CASE WHEN hit THEN used ELSE list_append(used, c) END, CASE WHEN hit THEN regexp_replace(c, '(\\.[^.]*)$', '-' || n || '\\1') ELSE q[2].c END, CASE WHEN hit THEN n + 1 ELSE 2 END, q[1].o, q[1].p, CASE WHEN NOT hit THEN c END
      FROM (SELECT *, list_contains(used, c) AS hit FROM w WHERE len(q) > 0))
SELECT book, page_id, path, new_path FROM w WHERE new_path IS NOT NULL UNION ALL SELECT book, page_id, path, path FROM c WHERE safe""")
def sanitize_collisions(spark, sf_dir):
    """Pages as files of seven books, many of whose names fall together: every file gets a name of its own."""
    bare = F.col("page_id") % 5 == 0
    marks = F.when(bare, 0).otherwise(F.expr("page_id div 7") + 1).cast("int")
    two = F.when(bare, F.col("page_id") % 10 == 0).otherwise(F.col("page_id") % 3 == 0)
    pages = table(spark, sf_dir, "pages").where("page_id is not null and url is not null")
    # a path has as many marks as there are pages ahead of it in its book, so files are told apart by what paths are made of
    files = pages.groupBy((F.col("page_id") % 7).alias("book"), F.substring(F.md5("url"), 1, 1).alias("letter"), F.greatest(marks, F.lit(0)).alias("marks"), two.alias("two")).agg(F.min("page_id").alias("page_id"))
    path = F.concat(F.lit("text/"), F.col("letter"), F.repeat(F.lit("!"), F.col("marks")), F.when(F.col("two"), "-2").otherwise(""), F.lit(".html"))
    return names.free_names(files, "book", "page_id", "path", path)


@query("SELECT page_id, nullif(regexp_extract('https://drive.example/file/d/' || md5(url) || '/view', '/file/d/([A-Za-z0-9_-]+)', 1), '') AS by_path, nullif(regexp_extract(url, '[?&]id=([A-Za-z0-9_-]+)', 1), '') AS by_name FROM pages")
def drive_id(spark, sf_dir):
    link = F.concat(F.lit("https://drive.example/file/d/"), F.md5("url"), F.lit("/view"))
    return table(spark, sf_dir, "pages").select("page_id", t.drive_id(link).alias("by_path"), t.drive_id(F.regexp_replace("url", "/file/d/", "/")).alias("by_name"))


@query("SELECT page_id, regexp_replace(url || '.EPUB', '(?i)\\.epub$', '-fr-bilingual.epub') AS path FROM pages")
def output_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.output_name(F.concat("url", F.lit(".EPUB")), F.lit("fr")).alias("path"))


@query("SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, '[FR] ' || text AS translated, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM (" + LINES + " SELECT * FROM lines)")
def mock_translation(spark, sf_dir):
    rows = segments.lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.concat(F.lit("[FR] "), F.col("text")).alias("translated"), t.escaped(F.col("text")).alias("escaped"))


MODES = "['MANUAL', 'DAILY', 'WEEKLY'][CAST(o_orderkey % 3 + 1 AS INTEGER)]"


@query(
    f"""WITH o AS (SELECT o_orderkey, {MODES} AS mode, CAST(o_orderkey % 7 AS BIGINT) AS dow, CAST(o_orderkey % 9 + 1 AS BIGINT) AS runs, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, CASE mode WHEN 'DAILY' THEN '5 2 * * *' WHEN 'WEEKLY' THEN '5 2 * * ' || dow END AS cron, CASE mode WHEN 'DAILY' THEN strftime(day + CAST(runs - 1 AS INTEGER), '%Y-%m-%d') WHEN 'WEEKLY' THEN strftime(day + CAST((runs - 1) * 7 AS INTEGER), '%Y-%m-%d') END AS done FROM o"""
)
def schedules(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mode = F.element_at(F.array(F.lit("MANUAL"), F.lit("DAILY"), F.lit("WEEKLY")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = o.select("o_orderkey", mode.alias("mode"), (F.col("o_orderkey") % 7).alias("dow"), (F.col("o_orderkey") % 9 + 1).alias("runs"), F.to_date("o_orderdate").alias("day"))
    return o.select("o_orderkey", cal.cron(F.col("mode"), F.lit("02:05"), F.col("dow")).alias("cron"), cal.completion_date(F.col("day"), F.col("runs"), F.col("mode")).alias("done"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN least(event_id, 30000) ELSE least(1000 * pow(2, event_id % 8), 30000) END AS BIGINT) AS delay FROM events")
def retry_delays(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", cal.backoff((F.col("event_id") % 8).cast("double"), F.when(F.col("event_id") % 5 == 0, F.col("event_id"))).alias("delay"))


@query("SELECT user_id, event_type, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS events FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)) GROUP BY 1, 2, 3")
def contiguous_runs(spark, sf_dir):
    r = segments.islands(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")
    return r.groupBy("user_id", "event_type", F.col("run").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("events"))


@query("SELECT l_orderkey, l_linenumber, 'PART' AS missing FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5) UNION ALL SELECT l_orderkey, l_linenumber, 'SUPPLIER' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def validate_refs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p, s = table(spark, sf_dir, "part").where("p_size > 5"), table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    one = li.join(p, li.l_partkey == p.p_partkey, "left_anti").select("l_orderkey", "l_linenumber", F.lit("PART").alias("missing"))
    two = li.join(s, li.l_suppkey == s.s_suppkey, "left_anti").select("l_orderkey", "l_linenumber", F.lit("SUPPLIER").alias("missing"))
    return one.unionByName(two)


@query("""WITH o AS (SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'cs_' || (o_orderkey * 7 % 100003) END AS session_id, CASE WHEN o_orderstatus = 'O' THEN 'AWAITING_PAYMENT' ELSE 'PAID' END AS status FROM orders),
s AS (SELECT 'cs_' || (o_orderkey * 7 % 100003) AS session_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS reference, o_orderkey % 5 <> 0 AS paid, 'pi_' || o_orderkey AS payment FROM orders),
twice AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE payment LIKE '%1'),
hit AS (SELECT o.order_id, t.session_id, t.payment FROM twice t JOIN o ON o.order_id = t.reference WHERE t.paid AND o.status = 'AWAITING_PAYMENT'
        UNION ALL SELECT o.order_id, t.session_id, t.payment FROM twice t JOIN o ON o.session_id = t.session_id WHERE t.reference IS NULL AND t.paid AND o.status = 'AWAITING_PAYMENT'),
one AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY session_id, payment) AS k FROM hit)
SELECT order_id, session_id, payment FROM one WHERE k = 1""")
def settle_sessions(spark, sf_dir):
    """Sessions delivered once or twice, half of them known only by the order's stored session; only open orders settle, once."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("cs_"), (F.col("o_orderkey") * 7 % 100003).cast("string"))
    known = o.select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderkey") % 4 != 0, name).alias("session_id"), F.when(F.col("o_orderstatus") == "O", "AWAITING_PAYMENT").otherwise("PAID").alias("status"))
    sent = o.select(name.alias("session_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("reference"), (F.col("o_orderkey") % 5 != 0).alias("paid"), F.concat(F.lit("pi_"), F.col("o_orderkey").cast("string")).alias("payment"))
    return state.settled(sent.unionByName(sent.where(F.col("payment").endswith("1"))), known)


@query()
def report_json(spark, sf_dir):
    """One report a job, as JSON; formatting differs between engines, so there is no SQL."""
    return status_counts(spark, sf_dir).select("job_id", F.to_json(F.struct("job_id", "pending", "translated", "failed"), {"pretty": "true"}).alias("report"))


def queries() -> dict[str, Query]:
    return QUERIES | relations.QUERIES | markup_queries.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | relations.SQL
