"""Queries over the stored relations: look-ups, projections, groupings and the logs that stand for updates.

Orders stand for jobs and orders, customers for users, line items for segments, parts for
uploads, events for logs, lines of documents for segments of chapters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import calendar as cal
from quirework.functions import money
from quirework.functions import text as t
from quirework.operators import jobs as runs
from quirework.operators import lookups, providers, segments, state
from quirework.session import shared_folder
from quirework.sources.store import Store, conformed
from quirework.streaming import usage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
STATES = ("READY", "PAUSED_BUDGET", "PAUSED_RATE_LIMIT", "TRANSLATING", "COMPLETED")
STATE = "['READY', 'PAUSED_BUDGET', 'PAUSED_RATE_LIMIT', 'TRANSLATING', 'COMPLETED'][CAST(o_orderkey % 5 + 1 AS INTEGER)]"
SEGMENT = "CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'TRANSLATED' END"
LINE = f"""lines AS (SELECT doc_id AS chapter, coalesce(source, '') AS book, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS chapter_index, text
  FROM (SELECT doc_id, source, k, regexp_replace(regexp_replace(p, '^{t.SPACE}', ''), '{t.SPACE}$', '') AS text FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)) WHERE text <> '')"""
MARK = "['TRANSLATED', 'FAILED', 'PENDING'][CAST(event_id % 3 + 1 AS INTEGER)]"


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names, index):
    return F.element_at(F.array(*map(F.lit, names)), (index + 1).cast("int"))


def jobs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), pick(STATES, F.col("o_orderkey") % 5).alias("status"), F.col("o_orderdate").alias("created_at"))


def stored_segments(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_linestatus") == "O", "PENDING").otherwise("TRANSLATED")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("order_index"), status.alias("status"), F.floor("l_quantity").cast("long").alias("tokens"))


def users(spark, sf_dir):
    name = F.regexp_replace("c_name", "#", "")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(name, F.lit("@Example.org")).alias("email"))


@query(f"SELECT o_orderkey AS id, o_custkey AS user_id, {STATE} AS status FROM orders WHERE o_orderkey IN (7, 32, 999999999)")
def job_lookup(spark, sf_dir):
    """Point look-ups by key; what is not there gives no row."""
    return lookups.by_key(jobs(spark, sf_dir), "id", [7, 32, 999999999]).select("id", "user_id", "status")


@query(f"SELECT o_orderkey AS id, {STATE} AS status FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def job_or_error(spark, sf_dir):
    """The same for a key that must be there; a missing one is an error with a code."""
    first = jobs(spark, sf_dir).agg(F.min("id")).first()[0]
    return lookups.must_have(jobs(spark, sf_dir), "id", [first], "JOB_NOT_FOUND").select("id", "status")


@query("SELECT c_custkey AS id FROM customer WHERE lower(replace(c_name, '#', '') || '@Example.org') = 'customer000000042@example.org'")
def user_by_email(spark, sf_dir):
    return lookups.by_email(users(spark, sf_dir), " CUSTOMER000000042@example.ORG ".strip()).select("id")


@query(f"SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS order_index, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS place FROM lineitem WHERE {SEGMENT} = 'PENDING'")
def segments_by_status(spark, sf_dir):
    """Pending segments of each job in reading order."""
    rows = stored_segments(spark, sf_dir).where("status = 'PENDING'")
    return rows.select("job_id", "order_index", F.row_number().over(Window.partitionBy("job_id").orderBy("order_index")).cast("long").alias("place"))


@query("SELECT o_orderkey AS id, o_custkey AS user_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE replace(c_name, '#', '') = 'Customer000000007'")
def owned_orders(spark, sf_dir):
    """Only the caller's own rows."""
    caller = users(spark, sf_dir).where("email = 'Customer000000007@Example.org'").select(F.col("id").alias("caller"))
    return lookups.owned(jobs(spark, sf_dir), "user_id", caller).select("id", "user_id")


SUMMARY = f"""WITH s AS (SELECT l_orderkey AS job_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE {SEGMENT} = 'TRANSLATED') AS BIGINT) AS completed, CAST(count(*) FILTER (WHERE {SEGMENT} = 'FAILED') AS BIGINT) AS failed FROM lineitem GROUP BY 1)"""


@query(SUMMARY + f" SELECT o_orderkey AS id, o_orderstatus AS order_status, CAST(ceil(o_totalprice * 100e0) AS BIGINT) AS amount_usd_cents, job_id, CASE WHEN job_id IS NOT NULL THEN {STATE} END AS job_status, total, completed, failed FROM orders LEFT JOIN s ON job_id = o_orderkey AND o_orderkey % 3 <> 0")
def order_summary(spark, sf_dir):
    """What a customer sees of an order, with its job if it has one."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = stored_segments(spark, sf_dir).groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), is_("TRANSLATED").alias("completed"), is_("FAILED").alias("failed")).where("job_id % 3 <> 0")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("order_status"), F.ceil(F.col("o_totalprice") * 100.0).cast("long").alias("amount_usd_cents"), pick(STATES, F.col("o_orderkey") % 5).alias("s"))
    out = o.join(counts, o["id"] == counts["job_id"], "left")
    return out.select("id", "order_status", "amount_usd_cents", "job_id", F.when(F.col("job_id").isNotNull(), F.col("s")).alias("job_status"), "total", "completed", "failed")


@query("SELECT l_orderkey AS order_id, l_linenumber AS line, p_name AS original_filename, CAST(p_size AS BIGINT) AS chapter_count FROM lineitem JOIN part ON p_partkey = l_partkey")
def order_upload(spark, sf_dir):
    """Each order with the upload it is for."""
    up = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("original_filename"), F.col("p_size").cast("long").alias("chapter_count"))
    li = table(spark, sf_dir, "lineitem")
    return li.join(up, li["l_partkey"] == up["p_partkey"]).select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), "original_filename", "chapter_count")


@query(f"SELECT id, place FROM (SELECT o_orderkey AS id, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS BIGINT) AS place FROM orders) WHERE place <= 100")
def jobs_newest(spark, sf_dir):
    """The first page of all jobs, newest first."""
    top = jobs(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("id")).limit(100)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).cast("long").alias("place"))


@query(f"WITH {LINE} SELECT chapter, string_agg(chapter_index || ':' || length(text), ',' ORDER BY chapter_index) AS segments FROM lines GROUP BY 1")
def chapter_segments(spark, sf_dir):
    """The segments of a chapter as one list, in order."""
    rows = segments.paragraphs(table(spark, sf_dir, "documents")).select("chapter", "chapter_index", F.length("text").alias("n"))
    own = F.array_sort(F.collect_list(F.struct("chapter_index", "n")))
    return rows.groupBy("chapter").agg(own.alias("s")).select("chapter", F.array_join(F.transform("s", lambda x: F.concat(x["chapter_index"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias("segments"))


@query(f"WITH {LINE}, b AS (SELECT chapter, CAST((chapter_index - 1) // 5 AS BIGINT) AS batch, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY 1, 2) SELECT chapter, batch, chars, CAST(ceil(chars / 4e0) AS BIGINT) AS input_tokens, CAST(ceil(chars / 3.5e0) AS BIGINT) AS output_tokens FROM b")
def batch_characters(spark, sf_dir):
    """Estimates of a batch by its characters alone."""
    rows = segments.paragraphs(table(spark, sf_dir, "documents")).groupBy("chapter", F.floor((F.col("chapter_index") - 1) / 5).alias("batch")).agg(F.sum(t.units(F.col("text"))).alias("chars"))
    return rows.select("chapter", "batch", "chars", *[F.ceil(F.col("chars") / F.lit(k)).cast("long").alias(n) for n, k in (("input_tokens", 4.0), ("output_tokens", 3.5))])


@query(f"WITH {LINE}, a AS (SELECT DISTINCT chapter, CAST(chapter_index AS BIGINT) AS chapter_index FROM lines WHERE chapter_index % 3 = 1) SELECT l.chapter, l.chapter_index, sha256(l.text) AS checksum FROM a JOIN lines l USING (chapter, chapter_index)")
def batch_segments(spark, sf_dir):
    """Ids of a batch joined to the segments they name."""
    s = segments.paragraphs(table(spark, sf_dir, "documents"))
    asked = s.where("chapter_index % 3 = 1").select("chapter", "chapter_index")
    return lookups.named(asked, s, ["chapter", "chapter_index"]).select("chapter", "chapter_index", t.checksum(F.col("text")).alias("checksum"))


@query("""WITH i AS (SELECT l_orderkey, 'PART' AS code, 1 AS k FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) UNION SELECT l_orderkey, 'SUPPLIER', 2 FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
SELECT o_orderkey AS book, count(code) = 0 AS valid, CAST(count(code) AS BIGINT) AS issues, coalesce(string_agg(code, ', ' ORDER BY k), '') AS codes FROM orders LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY 1""")
def issue_codes(spark, sf_dir):
    """Whether a book is valid, and its issue codes in the order of the checks."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    p, s = table(spark, sf_dir, "part").where("p_size > 5"), table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    one = li.join(p, li.l_partkey == p.p_partkey, "left_anti").select(F.col("l_orderkey").alias("book"), F.lit("PART").alias("code"), F.lit(1).alias("at"))
    two = li.join(s, li.l_suppkey == s.s_suppkey, "left_anti").select(F.col("l_orderkey").alias("book"), F.lit("SUPPLIER").alias("code"), F.lit(2).alias("at"))
    books = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book"))
    return lookups.verdicts(books, one.unionByName(two).distinct(), "book")


@query("""WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 2 AS pending, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events),
f AS (SELECT * FROM e WHERE c <= 200), x AS (SELECT a.user_id, min(a.c) AS c FROM f a WHERE a.c > 3 AND (SELECT count(DISTINCT b.pending) FROM f b WHERE b.user_id = a.user_id AND b.c BETWEEN a.c - 3 AND a.c) = 1 GROUP BY 1)
SELECT f.user_id, CAST(coalesce(any_value(x.c), max(f.c)) AS BIGINT) AS cycle, any_value(x.c) IS NOT NULL AS stalled FROM f LEFT JOIN x ON x.user_id = f.user_id GROUP BY 1""")
def stalled_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") % 2).alias("pending"))
    return state.stalled(e, "user_id", "event_id", "pending")


@query(f"SELECT user_id AS segment, arg_max({MARK}, event_id) AS status, CAST(count(*) FILTER (WHERE {MARK} = 'FAILED') AS BIGINT) AS retry_count, CASE WHEN arg_max({MARK}, event_id) = 'FAILED' THEN 'error ' || max(event_id) END AS error_message FROM events GROUP BY 1")
def segment_log(spark, sf_dir):
    """Marks of segments (translated, failed, reset) as a log: the last one counts, failures add up."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "segment")
    return state.segment_states(e, "segment", F.col("event_id"), pick(("TRANSLATED", "FAILED", "PENDING"), F.col("event_id") % 3), F.concat(F.lit("error "), F.col("event_id").cast("string")))


@query(f"WITH {LINE} SELECT chapter, chapter_index, 'PENDING' AS status, CAST(0 AS BIGINT) AS retry_count FROM lines l WHERE NOT EXISTS (SELECT 1 FROM lines o WHERE o.chapter = l.chapter AND o.chapter_index = l.chapter_index AND o.chapter % 2 = 0 AND o.chapter_index = 1)")
def insert_segments(spark, sf_dir):
    """Drafts that are not stored yet, as the rows to append."""
    s = segments.paragraphs(table(spark, sf_dir, "documents")).select("chapter", "chapter_index")
    stored = s.where("chapter % 2 = 0 and chapter_index = 1")
    return lookups.fresh(s, stored, ["chapter", "chapter_index"]).select("chapter", "chapter_index", F.lit("PENDING").alias("status"), F.lit(0).cast("long").alias("retry_count"))


@query("SELECT event_id AS id, user_id AS job_id, event_type AS provider, CAST(floor(value) AS BIGINT) AS input_tokens, CAST(ceil(floor(value) * CAST(1.2 AS DOUBLE)) AS BIGINT) AS output_tokens, strftime(timezone('America/Toronto', timezone('UTC', ts)), '%Y-%m-%d') AS date_key, strftime(timezone('America/Toronto', timezone('UTC', ts)), '%Y-%m') AS month_key, ts AS created_at FROM events")
def ledger_append(spark, sf_dir):
    """Usage as ledger rows, appended to the stored ledger in three batches, one of them twice; a fourth one never commits."""
    e, n = table(spark, sf_dir, "events"), F.floor("value").cast("long")
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), F.col("event_type").alias("provider"), F.lit("m1").alias("model"), n.alias("input_tokens"), money.output_estimate(n).alias("output_tokens"), cal.date_key(F.col("ts"), "America/Toronto").alias("date_key"), cal.month_key(F.col("ts"), "America/Toronto").alias("month_key"), F.col("ts").alias("created_at"))
    kept = Store(spark, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}")
    for k in (0, 1, 2, 1):
        kept.append(f"run-{k}", usage_ledger=rows.where(F.pmod("id", F.lit(3)) == k))
    conformed("usage_ledger", rows).limit(1).write.parquet(f"{kept.root}/usage_ledger/batch=cut-off")
    return kept.read("usage_ledger").select("id", F.col("job_id").cast("long").alias("job_id"), "provider", "input_tokens", "output_tokens", "date_key", "month_key", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


KIND = "['created', 'paid', 'job', 'failed'][CAST(event_id % 4 + 1 AS INTEGER)]"


@query(f"SELECT user_id AS order_id, coalesce(arg_max(CASE {KIND} WHEN 'paid' THEN 'PAID' WHEN 'failed' THEN 'PAYMENT_FAILED' END, event_id) FILTER (WHERE {KIND} IN ('paid', 'failed')), 'AWAITING_PAYMENT') AS status, max(event_id) FILTER (WHERE {KIND} = 'job') AS job_id, max(ts) AS updated_at FROM events GROUP BY 1")
def order_log(spark, sf_dir):
    """Orders from their log: the last payment event decides, the last job is attached, every event touches the row."""
    e = table(spark, sf_dir, "events").withColumn("kind", pick(("created", "paid", "job", "failed"), F.col("event_id") % 4))
    status = F.when(F.col("kind") == "paid", "PAID").when(F.col("kind") == "failed", "PAYMENT_FAILED")
    last = F.max_by(status, F.when(status.isNotNull(), F.col("event_id")))
    return e.groupBy(F.col("user_id").alias("order_id")).agg(F.coalesce(last, F.lit("AWAITING_PAYMENT")).alias("status"), F.max(F.when(F.col("kind") == "job", F.col("event_id"))).alias("job_id"), F.max("ts").alias("updated_at"))


@query("SELECT c_custkey AS id, min(o_orderdate) FILTER (WHERE o_orderkey % 20 = 0) AS free_translation_used_at, 'cus_' || min(o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS stripe_customer_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def user_log(spark, sf_dir):
    """Users from their log: the free translation counts when first used, a customer id is set once and kept."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    own = o.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderkey") % 20 == 0, F.col("o_orderdate"))).alias("free_translation_used_at"), F.min(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey"))).alias("k"))
    return c.join(own, c.c_custkey == own.o_custkey, "left").select(F.col("c_custkey").alias("id"), "free_translation_used_at", F.concat(F.lit("cus_"), F.col("k").cast("string")).alias("stripe_customer_id"))


@query(f"WITH {LINE}, b AS (SELECT chapter, CAST((chapter_index - 1) // 5 AS BIGINT) AS batch, chapter_index, text, CASE WHEN chapter_index % 7 = 0 THEN 'missing' WHEN chapter_index % 5 = 0 THEN 'rejected' ELSE 'valid' END AS verdict FROM lines) SELECT chapter, batch, CAST(count(*) FILTER (WHERE verdict = 'valid') AS BIGINT) AS translated, CAST(count(*) FILTER (WHERE verdict <> 'valid') AS BIGINT) AS failed, CAST(coalesce(sum(length(text)) FILTER (WHERE verdict = 'valid'), 0) AS BIGINT) AS output_chars FROM b GROUP BY 1, 2")
def batch_writes(spark, sf_dir):
    """All that one batch writes: segments translated and failed, and its ledger entry, as one row."""
    s = segments.paragraphs(table(spark, sf_dir, "documents"))
    verdict = F.when(F.col("chapter_index") % 7 == 0, "missing").when(F.col("chapter_index") % 5 == 0, "rejected").otherwise("valid")
    rows = s.select("chapter", F.floor((F.col("chapter_index") - 1) / 5).alias("batch"), verdict.alias("verdict"), "text")
    ok = F.col("verdict") == "valid"
    return rows.groupBy("chapter", "batch").agg(F.count_if(ok).alias("translated"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, t.units(F.col("text")))), F.lit(0)).alias("output_chars"))


@query(f"WITH {LINE}, g AS (SELECT book, count(*) AS n, CAST(sum(greatest(1, ceil((length(text) + length('ch' || chapter) + 50) / 4.0))) AS BIGINT) AS tokens FROM lines GROUP BY 1), c AS (SELECT coalesce(source, '') AS book, count(*) AS chapters FROM documents GROUP BY 1) SELECT c.book, CAST(chapters AS BIGINT) AS chapter_count, CAST(coalesce(n, 0) AS BIGINT) AS paragraph_count, coalesce(tokens, 0) AS source_token_estimate, CAST(ceil(coalesce(tokens, 0) * CAST(1.2 AS DOUBLE)) AS BIGINT) AS estimated_output_tokens FROM c LEFT JOIN g USING (book)")
def upload_facts(spark, sf_dir):
    """What is stored of an upload: inspection and estimate of each book."""
    return lookups.upload_facts(table(spark, sf_dir, "documents"))


@query("SELECT user_id, event_id, lower(event_type) AS flag, ['DAILY', 'WEEKLY', 'MANUAL'][CAST(event_id % 3 + 1 AS INTEGER)] AS mode, ['English', 'French'][CAST(event_id % 2 + 1 AS INTEGER)] AS language FROM events")
def flag_maps(spark, sf_dir):
    """Flags and codes by fixed tables; case does not matter."""
    e = table(spark, sf_dir, "events")
    flag = pick(("Daily", "WEEKLY", "manual"), F.col("event_id") % 3)
    return e.select("user_id", "event_id", F.lower("event_type").alias("flag"), lookups.mode_of(flag).alias("mode"), lookups.language_name(pick(("en", "FR"), F.col("event_id") % 2)).alias("language"))


@query(f"SELECT l_orderkey AS job_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE {SEGMENT} = 'FAILED') AS BIGINT) AS failed, coalesce(string_agg(l_linenumber, ',' ORDER BY l_linenumber) FILTER (WHERE {SEGMENT} = 'FAILED'), '') AS failures FROM lineitem GROUP BY 1")
def report_failures(spark, sf_dir):
    """The failures that a job's report lists."""
    s = stored_segments(spark, sf_dir)
    bad = F.array_sort(F.collect_list(F.when(F.col("status") == "FAILED", F.col("order_index"))))
    return s.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "FAILED").alias("failed"), bad.alias("b")).select("job_id", "total", "failed", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("failures"))


@query(f"WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, CAST(k AS BIGINT) AS k, k IS NULL AS broken FROM e")
def parsed_replies(spark, sf_dir):
    """Replies as JSON, read by a schema: what does not fit is broken, never guessed."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", lookups.parsed(F.col("props"), "k long")["k"].alias("k")).withColumn("broken", F.col("k").isNull())


def faulty():
    """A provider, sent by value: chapters whose replies fail for a while, for good, or come broken, by their number."""

    class Faulty(providers.Mock):
        def translate(self, request):
            batch = request["segments"][0]["id"].split("-")[0]
            chapter = int(batch.split(":")[0])
            self.calls = getattr(self, "calls", {}) | {batch: getattr(self, "calls", {}).get(batch, 0) + 1}
            if chapter % 13 == 6:
                raise providers.AuthFault("the key is refused")
            if self.calls[batch] <= chapter % 6:
                raise providers.RateLimited("too many calls", 45_000 if chapter % 4 == 3 else None)
            return '{"translations": [{"id": "x"}]}' if chapter % 7 == 2 else super().translate(request)

    return lambda settings: Faulty()


WAIT = "CASE WHEN chapter % 4 = 3 THEN 30000 ELSE CAST(floor(1000 * pow(2, k) + 1000 * pow(2, k) * CAST(0.125 AS DOUBLE) * (CAST('0x' || substr(md5(batch || ':' || k), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))) AS BIGINT) END"


@query(f"""WITH {LINE}, b AS (SELECT chapter, chapter || ':' || (chapter_index - 1) // 5 AS batch, count(*) AS n, sum(length(text)) AS chars FROM lines GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN chapter % 13 = 6 THEN 0 ELSE least(chapter % 6, 3) END AS again, CASE WHEN chapter % 13 = 6 THEN 'AUTH_ERROR' WHEN chapter % 6 > 3 THEN 'RATE_LIMIT_ERROR' WHEN chapter % 7 = 2 THEN 'REPLY_INVALID' END AS error FROM b)
SELECT batch, CAST(again + 1 AS INTEGER) AS attempts, CAST(coalesce(list_sum(list_transform(range(again), lambda k: {WAIT})), 0) AS BIGINT) AS waited, error, CASE WHEN error IS NULL THEN CAST(n AS BIGINT) ELSE 0 END AS translated, CASE WHEN error IS NULL THEN CAST(chars + 5 * n AS BIGINT) ELSE 0 END AS chars FROM a""")
def provider_calls(spark, sf_dir):
    """Requests of five paragraphs to a provider that fails by rule: attempts, milliseconds waited, and what its replies hold."""
    rows = segments.paragraphs(table(spark, sf_dir, "documents"))
    batch = F.concat(F.col("chapter").cast("string"), F.lit(":"), F.floor((F.col("chapter_index") - 1) / 5).cast("string"))
    asked = providers.requests(rows.select(batch.alias("batch"), F.concat(batch, F.lit("-"), F.col("chapter_index").cast("string")).alias("id"), "text"), "en", "fr")
    judged = providers.checked(providers.sent(asked, faulty(), sleep=lambda seconds: None))
    good = F.when(F.col("error").isNull(), F.col("translations"))
    chars = F.aggregate(good, F.lit(0).cast("long"), lambda n, x: n + t.units(x["translatedText"]))
    waited = F.aggregate("delays", F.lit(0).cast("long"), lambda n, x: n + x)
    return judged.select("batch", "attempts", waited.alias("waited"), "error", F.coalesce(F.size(good), F.lit(0)).cast("long").alias("translated"), F.coalesce(chars, F.lit(0)).alias("chars"))


@query("""WITH e AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS n, timezone('America/Toronto', timezone('UTC', ts)) AS local FROM events)
SELECT strftime(local, '%Y-%m-%d') AS day, strftime(local, '%Y-%m') AS month, user_id AS job_id, CAST(count(*) AS BIGINT) AS entries, CAST(sum(n) AS BIGINT) AS tokens_in, CAST(sum(ceil(n * CAST(1.2 AS DOUBLE))) AS BIGINT) AS tokens_out FROM e GROUP BY 1, 2, 3""")
def usage_days(spark, sf_dir):
    """The streaming ledger's days over a table in which every third entry comes twice."""
    e, n = table(spark, sf_dir, "events"), F.floor("value").cast("long")
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"), n.alias("tokens_in"), money.output_estimate(n).alias("tokens_out"), F.col("ts").cast("timestamp").alias("ts"))
    return usage.days(rows.unionByName(rows.where("id % 3 = 0")), "America/Toronto")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'FAILED' WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'TRANSLATED' END AS status, CAST(floor(l_quantity) AS BIGINT) AS q FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE status = 'TRANSLATED') AS done, count(*) FILTER (WHERE status = 'FAILED') AS failed, sum(q) AS tin, min(l_linenumber) FILTER (WHERE status = 'FAILED') AS first FROM s GROUP BY 1)
SELECT o_orderkey AS job_id, 'out/' || o_orderkey || '.epub.report.json' AS path, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(done, 0) AS BIGINT) AS translated, CAST(coalesce(failed, 0) AS BIGINT) AS failed, CAST(coalesce(tin, 0) AS BIGINT) AS input_tokens, CAST(coalesce(failed, 0) AS BIGINT) AS failures, first AS first_failure, CASE WHEN o_orderkey % 9 = 0 THEN 'UNRESOLVED_LINK' END AS issue, 17 AS fields FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def report_fields(spark, sf_dir):
    """Whole reports as JSON, read back: counts, the first failure and the first issue of each."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    facts = o.select(F.col("o_orderkey").alias("job_id"), F.concat(F.lit("in/"), key, F.lit(".epub")).alias("input_path"), F.concat(F.lit("out/"), key, F.lit(".epub")).alias("output_path"), *[F.lit(v).alias(k) for k, v in (("source_language", "en"), ("target_language", "fr"), ("display_order", "ENGLISH_FIRST"), ("provider", "mock"), ("model", "mock-1"))], F.col("o_orderdate").cast("string").alias("created_at"), F.col("o_orderdate").cast("string").alias("completed_at"))
    status = F.when(F.col("l_returnflag") == "R", "FAILED").when(F.col("l_linestatus") == "O", "PENDING").otherwise("TRANSLATED")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("string").alias("id"), F.lit("ch").alias("chapter_path"), F.col("l_linenumber").alias("at"), status.alias("status"), F.lit(None).cast("string").alias("error_message"), F.floor("l_quantity").cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    issues = o.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("job_id"), F.lit(1).alias("at"), F.lit("UNRESOLVED_LINK").alias("code"), F.lit("gone").alias("message"))
    made = runs.reports(facts, rows, issues)
    part = lambda p: F.get_json_object("report", f"$.{p}")
    numbers = {"total": "totalSegments", "translated": "translatedSegments", "failed": "failedSegments", "input_tokens": "inputTokens"}
    return made.select("job_id", "path", *[part(v).cast("long").alias(k) for k, v in numbers.items()], F.json_array_length(part("failures")).cast("long").alias("failures"), part("failures[0].id").cast("int").alias("first_failure"), part("validationIssues[0].code").alias("issue"), F.size(F.json_object_keys("report")).alias("fields"))
