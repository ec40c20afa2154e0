"""Golden values of the scalar functions and operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quirework.config import Book, Budget, ConfigError
from quirework.functions import calendar, money, unicode
from quirework.functions import text as t
from quirework.operators import budget, contract, jobs, lookups, markup, segments, state


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(*columns).first()


def packed(tokens, limit, margin=20):
    return lambda spark: one(spark, segments.packs(F.array(*[F.lit(x).cast("long") for x in tokens]), segments.target(limit, margin)))[0]


def test_packing_closes_a_batch_before_it_overflows(spark):
    assert packed([40, 40, 40], 100)(spark) == [0, 0, 1]
    assert packed([500], 100)(spark) == [0]
    assert packed([500, 1, 500], 100)(spark) == [0, 1, 2]


def test_packing_matches_a_loop(spark):
    import random

    r = random.Random(3)
    for _ in range(20):
        tokens, most = [r.randint(1, 60) for _ in range(r.randint(0, 30))], r.randint(1, 100)
        want, no, have = [], 0, 0
        for x in tokens:
            if have and have + x > most:
                no, have = no + 1, 0
            have += x
            want.append(no)
        rows = spark.createDataFrame([(tokens,)], "t array<long>")
        assert rows.select(segments.packs(F.col("t"), most)).first()[0] == want


def test_tokens(spark):
    lengths = one(spark, *[t.estimated_tokens(F.lit(x)) for x in ("", "abcd", "a" * 400, "😀" * 4)])
    assert list(lengths) == [1, 1, 100, 2]
    assert one(spark, t.estimated_tokens(F.lit("x" * 1860), F.lit("i" * 36)))[0] == 487


def test_text(spark):
    assert one(spark, t.normalized(F.lit("  a\u00a0\tb e\u0301 ")))[0] == "a b \u00e9"
    assert one(spark, t.slug(F.lit("OEBPS/Text/Ch 1.xhtml")))[0] == "oebps-text-ch-1"
    assert one(spark, t.slug(F.lit("___.html")))[0] == "chapter"
    assert one(spark, t.segment_id(F.lit("a.x"), F.lit(12345), F.lit("x")))[0].startswith("a-p12345-")
    assert one(spark, t.safe_path(F.lit("Garden & Moon (draft 2)!.xhtml")))[0] == "Garden_Moon_draft_2.xhtml"
    assert one(spark, t.safe_path(F.lit("é/ü.txt")))[0] == "e/u.txt"
    assert [one(spark, t.language_neutral(F.lit(x)))[0] for x in ("", "42", "http://a.b/c", "$5.00", "word", "—")] == [True, True, True, True, False, True]


def test_normal_forms_equal_unicodedata(spark):
    import random
    import unicodedata

    r = random.Random(6)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    acting = [c for c in every if unicodedata.normalize("NFD", c) != c or unicodedata.combining(c)]
    jamo = [chr(c) for c in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3))]
    pool = acting + [c for c in acting if unicodedata.combining(c)] * 3 + list("aeE n") * 200 + jamo * 10
    texts = [*every, *("".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(20000)), *(unicodedata.normalize("NFD", c) + r.choice(pool) for c in acting), None, ""]
    frame = spark.createDataFrame([(x, x and unicodedata.normalize("NFC", x)) for x in texts], "t string, want string").select("t", "want", unicode.nfc(F.col("t")).alias("got"))
    assert frame.where("not (got <=> want)").count() == 0


def test_safe_paths_equal_the_archive_writer(spark):
    import random

    from quirework.sources import epub

    r = random.Random(7)
    signs = list("abZ09._-/ (#é½ﬁ①．／Å한漢😀´ñ") + ["e\u0301", "\u0301", "\u212b"]
    paths = ["".join(r.choice(signs) for _ in range(r.randint(1, 14))) for _ in range(3000)]
    frame = spark.createDataFrame([(p, "/".join(map(epub.safe_part, p.split("/")))) for p in paths], "p string, want string")
    wrong = frame.select("p", "want", t.safe_path(F.col("p")).alias("got")).where("not (got <=> want)")
    assert wrong.collect() == []


def test_cache_keys_stay_in_the_jvm(spark):
    key = t.cache_key(*[F.lit(x) for x in ("en", "fr", "mock", "m")], t.normalized(F.col("x")))
    plan = spark.createDataFrame([("é",)], ["x"]).select(key.alias("k"), t.safe_path(F.col("x")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "from_json" not in plan


def test_money(spark):
    assert one(spark, money.cost(F.lit(1e6), F.lit(1e6), F.lit(3.0), F.lit(15.0)))[0] == 18
    assert one(spark, money.cost(F.lit(1e6), F.lit(1e6), F.lit(None).cast("double"), F.lit(15.0)))[0] is None
    assert one(spark, money.price_cents(F.lit(2.0)))[0] == 600
    assert one(spark, money.price_cents(F.lit(0.0)))[0] == 50
    with pytest.raises(Exception, match="PRICING_NOT_CONFIGURED"):
        one(spark, money.price_cents(F.lit(None).cast("double")))


def test_calendar(spark):
    at = F.lit(dt.datetime(2026, 7, 29, 1, 30)).cast("timestamp_ntz")
    assert one(spark, calendar.date_key(at, "America/Los_Angeles"))[0] == "2026-07-28"
    modes = [("DAILY", "02:30"), ("WEEKLY", "14:00"), ("MANUAL", "00:00")]
    assert [one(spark, calendar.cron(F.lit(m), F.lit(x), F.lit(3)))[0] for m, x in modes] == ["30 2 * * *", "0 14 * * 3", None]


def test_gate(spark):
    config = Budget(max_input_per_day=100, margin_percent=50.0)
    used = {k: F.lit(0) for k in ("requests", "run_in", "run_out", "day_in", "day_out", "month_in", "month_out")}
    decide = lambda tin, **more: one(spark, budget.decision(config, F.lit(tin), F.lit(0), used | {k: F.lit(v) for k, v in more.items()}))[0]
    assert decide(20, day_in=40) == "DAY"
    assert decide(10, day_in=40) is None
    assert decide(9000) == "REQUEST"
    assert decide(1, requests=10) == "RUN"


def test_contract(spark):
    asked = spark.createDataFrame([("s1", "Hello"), ("s2", "World"), ("s3", "same"), ("s4", '<x-inline data-id="inline-1">a</x-inline>'), ("s5", "x")], ["id", "text"])
    given = spark.createDataFrame([("s1", 0, "Bonjour"), ("s1", 1, "again"), ("s1", 6, "once more"), ("ghost", 2, "boo"), ("s3", 3, "same"), ("s4", 4, "a lost"), ("s5", 5, "\u00a0")], ["id", "ord", "translated"])
    rows = contract.outcome(asked, given).collect()
    got = {(r.id, r.verdict): r.reason for r in rows}
    assert [r.verdict for r in rows if r.id == "s1"].count("duplicate") == 2
    assert got == {("s1", "valid"): None, ("s1", "duplicate"): None, ("ghost", "unexpected"): None, ("s2", "missing"): None, ("s3", "rejected"): "identical", ("s4", "rejected"): "placeholder", ("s5", "rejected"): "blank"}


def test_states(spark):
    ok = lambda a, b: one(spark, state.allowed(F.lit(a), F.lit(b)))[0]
    assert ok("READY", "TRANSLATING") and not ok("FAILED", "TRANSLATING") and not ok("COMPLETED", "READY") and not ok("nonsense", "READY")


def test_offsets_of_a_large_group(spark):
    rows = spark.range(20000).selectExpr("'a' AS g", "id AS o", "id % 3 AS n")
    got = segments.with_offsets(rows, "g", "o", "n", "before").orderBy("o").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.n


def test_run_uses_the_cache_and_the_contract(spark):
    segs = spark.createDataFrame([("a", "one"), ("b", "two")], ["id", "text"])
    empty = spark.createDataFrame([], "cache_key string, translated_text string, created_at timestamp")
    first = jobs.run(segs, empty, jobs.MockTranslator(), "en", "fr")
    rows = {r.id: r for r in first.collect()}
    assert rows["a"].translated == "[FR] one" and not rows["a"].from_cache
    cache = first.where("id = 'a'").select("cache_key", F.lit("un").alias("translated_text"), F.current_timestamp().alias("created_at"))
    again = jobs.run(segs, cache, jobs.MockTranslator(), "en", "fr")
    assert {r.id: (r.translated, r.from_cache) for r in again.collect()} == {"a": ("un", True), "b": ("[FR] two", False)}
    t_ = jobs.totals(again).first()
    assert (t_.processed, t_.cache_hits, t_.failed) == (2, 1, 0)


def test_config():
    with pytest.raises(ConfigError):
        Book("en", "en")
    with pytest.raises(ConfigError):
        Book(time="24:00")
    with pytest.raises(ConfigError):
        Book(display_order="SOURCE_FIRST")
    first = lambda b: markup.english_first(b.source_language, b.target_language, b.display_order)
    assert first(Book()) and not first(Book("fr", "en")) and first(Book("fr", "en", "FRENCH_FIRST"))


def test_leases_pass_only_when_granted(spark):
    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    rows = [("k", "a", at(0), 1), ("k", "b", at(20), 2), ("k", "c", at(35), 3), ("k", "a", at(40), 4), ("k", "c", at(50), 5), ("k", "a", at(80), 6), ("j", "b", at(0), 7)]
    got = state.leases(spark.createDataFrame(rows, "key string, who string, at timestamp_ntz, n int"), "key", "who", "at", "n").collect()
    assert {r.n: (r.granted, r.held_by) for r in got} == {1: (True, "a"), 2: (False, "a"), 3: (True, "c"), 4: (False, "c"), 5: (True, "c"), 6: (True, "a"), 7: (True, "b")}


def test_budgets_add_the_ledger_to_the_run(spark):
    config = Budget(max_input_per_day=1000, max_output_per_day=10**6, max_cost_per_day=0.05, margin_percent=0.0)
    rows = [("r", k, [60, 40], 750, 0, 0.0) for k in range(4)] + [("s", k, [100], 0, 0, 0.0475) for k in range(3)] + [("t", 0, [9000], 0, 0, 0.0), ("t", 1, [1], 0, 0, 0.0), (None, 0, [1], None, None, None)]
    frame = spark.createDataFrame(rows, "run string, n long, sizes array<long>, day_in int, day_out int, cost_day double")
    got = budget.queue(frame, "run", "n", "sizes", config, prices=(3.0, 15.0)).collect()
    assert {(r.run, r.n): r.scope for r in got} == {("r", 0): None, ("r", 1): None, ("r", 2): "DAY", ("r", 3): "NOT_REACHED", ("s", 0): None, ("s", 1): "COST", ("s", 2): "NOT_REACHED", ("t", 0): "REQUEST", ("t", 1): None, (None, 0): None}


def test_halves_use_up_the_run(spark):
    """Two batches that must be halved: the second one's first half is the third request, of which the run allows three."""
    config = Budget(max_source_tokens_per_request=100, max_requests_per_run=3, margin_percent=0.0)
    frame = spark.createDataFrame([("r", 0, [60, 60]), ("r", 1, [60, 300, 60, 60]), ("r", 2, [1])], "run string, n long, sizes array<long>")
    got = [(r.n, r.part, r.a, r.z, r.scope) for r in budget.queue(frame, "run", "n", "sizes", config).orderBy("n", "part").collect()]
    assert got == [(0, 0, 0, 1, None), (0, 1, 1, 2, None), (1, 0, 0, 1, None), (1, 1, 1, 2, "REQUEST"), (1, 2, 2, 3, "RUN"), (1, 3, 3, 4, "NOT_REACHED"), (2, 0, 0, 1, "NOT_REACHED")]


def queued(batches, most_in, most_out, requests, run_in):
    """The queue as a loop: halves go to its front."""
    waiting, out, n, used, stopped = [(k, 0, len(s)) for k, s in enumerate(batches) if s], [], 0, 0, False
    while waiting:
        k, a, z = waiting.pop(0)
        total = sum(batches[k][a:z])
        large = total > most_in or -(-total * 6 // 5) > most_out
        if large and z - a > 1:
            middle = a + (z - a + 1) // 2
            waiting = [(k, a, middle), (k, middle, z), *waiting]
            continue
        scope = "NOT_REACHED" if stopped else "REQUEST" if large else "RUN" if n + 1 > requests or used + total > run_in else None
        stopped = stopped or scope == "RUN"
        n, used = (n + 1, used + total) if scope is None else (n, used)
        out.append((k, a, z, scope))
    return out


def test_queues_match_a_loop(spark, monkeypatch):
    import random

    monkeypatch.setattr(segments, "BUCKET", 5)
    r, runs = random.Random(8), {}
    for run in range(30):
        runs[run] = [[r.randint(0, 70) for _ in range(r.choice([0, 1, 2, 5, 9]))] for _ in range(r.randint(1, 40))]
    frame = spark.createDataFrame([(run, k, s) for run, b in runs.items() for k, s in enumerate(b)], "run int, n long, sizes array<long>")
    config = Budget(max_source_tokens_per_request=90, max_output_tokens_per_request=100, max_requests_per_run=25, max_input_per_run=900, margin_percent=0.0)
    got = sorted((x.run, x.n, x.a, x.z, x.scope or "") for x in budget.queue(frame, "run", "n", "sizes", config).collect())
    assert got == sorted((run, k, a, z, scope or "") for run, b in runs.items() for k, a, z, scope in queued(b, 90, 100, 25, 900))


def test_a_queue_is_no_task_of_its_own(spark):
    """The run's total comes in two levels: no window of the plan is partitioned by the run alone but the one over bucket totals."""
    frame = spark.range(20000).selectExpr("'hot' AS run", "id AS n", "array(1L, 2L) AS sizes")
    got = budget.queue(frame, "run", "n", "sizes", Budget(max_requests_per_run=15000, max_input_per_run=10**9, max_output_per_run=10**9, max_input_per_day=10**9, max_output_per_day=10**9, margin_percent=0.0))
    assert got.where("admitted").count() == 15000 and got.where("scope = 'RUN'").first().n == 15000


def test_batches_are_halved_until_they_fit(spark):
    cut = lambda sizes: [(p.a, p.z, p.fits) for p in one(spark, budget.requests(F.array(*[F.lit(x).cast("long") for x in sizes]), 100, 1000))[0]]
    assert cut([60, 30, 60, 30, 101]) == [(0, 2, True), (2, 3, True), (3, 4, True), (4, 5, False)]
    assert cut([10, 20]) == [(0, 2, True)] and cut([500]) == [(0, 1, False)] and cut([]) == []


def judged(spark, statuses):
    rows = spark.createDataFrame([(1, k, s) for k, s in enumerate(statuses)], "job int, n int, status string")
    return [(r.before, r.error is None) for r in state.applied(rows, "job", "n", "status").orderBy("n").collect()]


def test_a_refused_move_leaves_the_state(spark):
    assert judged(spark, ["CREATED", "READY", "EXTRACTING", "SEGMENTING", "nonsense", None, "FAILED"]) == [(None, True), ("CREATED", False), ("CREATED", True), ("EXTRACTING", True), ("SEGMENTING", False), ("SEGMENTING", False), ("SEGMENTING", True)]
    assert judged(spark, ["nonsense", "CREATED"]) == [(None, False), (None, True)]


def moves_of_one_hot_job():
    import random

    r = random.Random(4)
    rows = [(k, "hot" if k % 3 else f"j{r.randint(0, 5)}", r.choice([*state.STATES, *state.STATES[:4], "odd"])) for k in range(9000)]
    at, out = {}, {}
    for n, job, to in rows:
        good = to in state.STATES and (job not in at or to in state.TRANSITIONS.get(at[job], ()))
        out[n] = (at.get(job), good)
        at |= {job: to} if good else {}
    return rows, out


def test_moves_match_a_loop_and_a_stream_that_restarts(spark, tmp_path):
    from quirework.streaming import moves

    rows, want = moves_of_one_hot_job()
    told = lambda frame: {r.n: (r.before, r.error is None) for r in frame.select("n", "before", "error").collect()}
    schema = "n long, job string, status string"
    assert told(state.applied(spark.createDataFrame(rows, schema), "job", "n", "status")) == want
    spark.conf.set(*moves.PROVIDER)
    for k in range(3):
        spark.createDataFrame(rows[3000 * k : 3000 * k + 3000], schema).repartition(2).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        moves.applied(stream, "job", "n", "status").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    spark.conf.unset(moves.PROVIDER[0])
    assert told(spark.read.parquet(str(tmp_path / "out"))) == want


def test_jobs_from_their_moves(spark):
    at = lambda m: dt.datetime(2026, 1, 1, 0, m)
    rows = [(0, "CREATED", None, at(0)), (1, "EXTRACTING", "slow", at(1)), (2, "READY", "refused", at(2)), (3, "SEGMENTING", None, at(3)), (4, "READY", None, at(4)), (5, "TRANSLATING", None, at(5)), (6, "CREATED", None, at(6))]
    moves_ = spark.createDataFrame([("j", *r) for r in rows], "job string, n int, status string, message string, at timestamp_ntz")
    got = state.jobs(state.applied(moves_, "job", "n", "status"), "job", "n", "status", "message", "at").first()
    assert tuple(got) == ("j", "TRANSLATING", "slow", at(0), at(5), at(5), 2)


def test_segments_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x"), (1, "c", "x"), (1, "c", "x"), (None, "d", "x"), (2, "e\n\nf", "x"), (2, None, "y"), (3, "g", None)], "doc_id long, text string, source string")
    rows = segments.segments(docs).collect()
    assert sorted((r.order_index, r.chapter is None, r.chapter) for r in rows if r.book == "x") == [(0, False, 1), (1, False, 1), (2, False, 1), (3, False, 1), (4, False, 2), (5, False, 2), (6, True, None)]
    at = {r.text: r.order_index for r in rows if r.book == "x"}
    assert at["b"] == at["a"] + 1 and (at["e"], at["f"], at["d"]) == (4, 5, 6)
    assert sorted(r.text for r in segments.paragraphs(docs).collect()) == sorted("abccdefg")


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    assert lookups.must_have(rows, "id", [2], "JOB_NOT_FOUND").first().x == "b"
    with pytest.raises(lookups.NotFound) as e:
        lookups.must_have(rows, "id", [2, 3], "JOB_NOT_FOUND")
    assert e.value.code == "JOB_NOT_FOUND" and "3" in str(e.value)
    assert one(spark, lookups.mode_of(F.lit("Weekly")), lookups.mode_of(F.lit("never")), lookups.parsed(F.lit("{broken"), "k long")["k"])[:] == ("WEEKLY", None, None)
