"""Calls, retries, checked replies, settings, and the ledger as a stream."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quirework import config
from quirework.operators import contract, providers
from quirework.streaming import usage


def flaky():
    """A factory, sent by value: fails as often as the first segment's text says, for the reason it names."""

    class Flaky(providers.Mock):
        def __init__(self):
            self.calls = {}

        def translate(self, request):
            first = request["segments"][0]["text"]
            kind, times = first.split()[:2]
            self.calls[first] = self.calls.get(first, 0) + 1
            if self.calls[first] <= int(times):
                raise {"rate": providers.RateLimited("wait"), "asked": providers.RateLimited("wait", 77_000), "fault": providers.ProviderFault("down"), "bad": providers.ProviderFault("no", retryable=False), "auth": providers.AuthFault("key")}[kind]
            return super().translate(request)

    return lambda settings: Flaky()


def sent(spark, texts):
    rows = spark.createDataFrame([(f"b{k}", f"s{k}.{j}", t) for k, own in enumerate(texts) for j, t in enumerate(own)], "batch string, id string, text string")
    return rows, providers.checked(providers.sent(providers.requests(rows, "en", "fr").repartition(2), flaky(), sleep=lambda s: None))


def test_retries(spark):
    rows, out = sent(spark, [["rate 2", "x"], ["asked 1"], ["fault 9"], ["bad 1"], ["auth 1"], ["fault 3"], ["ok 0", None]])
    got = {r.batch: r for r in out.collect()}
    assert {b: (r.attempts, r.error) for b, r in got.items()} == {"b0": (3, None), "b1": (2, None), "b2": (4, "PROVIDER_ERROR"), "b3": (1, "PROVIDER_ERROR"), "b4": (1, "AUTH_ERROR"), "b5": (4, None), "b6": (1, None)}
    assert got["b1"].delays == [30_000] and got["b6"].delays == []
    assert got["b5"].delays == [providers.delay("b5", k) for k in range(3)] and all(1000 * 2**k <= d < 1125 * 2**k for k, d in enumerate(got["b5"].delays))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    made = {(r.batch, r.id): r.translated for r in providers.translations(out).collect()}
    assert made == {("b0", "s0.0"): "[FR] rate 2", ("b0", "s0.1"): "[FR] x", ("b1", "s1.0"): "[FR] asked 1", ("b5", "s5.0"): "[FR] fault 3", ("b6", "s6.0"): "[FR] ok 0", ("b6", "s6.1"): "[FR] "}
    verdicts = {r.id: r.verdict for r in contract.outcome(rows.select("id", F.coalesce("text", F.lit("")).alias("text")), providers.translations(out)).collect()}
    assert verdicts["s0.1"] == "valid" and verdicts["s2.0"] == "missing"


def test_replies_are_checked(spark):
    replies = ['{"translations":[]}', "nonsense", "{}", '{"translations":{}}', '{"translations":[{"id":"a"}]}', '{"translations":[{"id":"a","translatedText":null}]}', '{"translations":[null]}', '{"translations":[{"id":"a","translatedText":"b","more":1}]}', None]
    frame = spark.createDataFrame([(str(k), r, None, None, 1, []) for k, r in enumerate(replies)], providers.SENT)
    assert [r.error for r in providers.checked(frame).orderBy("batch").collect()] == [None, *["REPLY_INVALID"] * 6, None, "REPLY_INVALID"]


def test_no_delay_is_beyond_its_eighth():
    for k in range(12):
        capped = min(1000 * 2**k, 30_000)
        assert capped <= providers.delay("x", k) < capped * 1.125
    assert providers.delay("x", 0, 5) == 5 and len({providers.delay(str(b), 0) for b in range(50)}) > 40


def test_providers_are_chosen_by_configuration(monkeypatch):
    assert isinstance(providers.chosen("mock", {})({}), providers.Mock)
    with pytest.raises(ValueError, match="no provider"):
        providers.chosen("other", {})
    monkeypatch.setitem(providers.FACTORIES, "keyed", (lambda settings: providers.Mock(), ("API_KEY",)))
    with pytest.raises(providers.AuthFault, match="API_KEY"):
        providers.chosen("keyed", {"API_KEY": ""})
    assert providers.chosen("keyed", {"API_KEY": "k"})
    items = providers.TOOL["input_schema"]["properties"]["translations"]["items"]
    assert all(f"{k} string" in providers.REPLY for k in items["required"]) and json.dumps(providers.TOOL)


def test_settings():
    s = config.settings({})
    assert s.budget == config.Budget() and (s.provider, s.price_in, s.retries) == ("mock", None, 3)
    s = config.settings({"MAX_REQUESTS_PER_RUN": "7", "MAX_COST_PER_RUN_USD": "1.5", "MAX_COST_PER_DAY_USD": "", "TOKEN_SAFETY_MARGIN_PERCENT": "90", "SCHEDULE_DAY_OF_WEEK": "WED"})
    assert (s.budget.max_requests_per_run, s.budget.max_cost_per_run, s.budget.max_cost_per_day, s.budget.margin_percent, s.weekday) == (7, 1.5, None, 90.0, "WED")
    for wrong in ({"MAX_REQUESTS_PER_RUN": "-1"}, {"MAX_REQUESTS_PER_RUN": "1.5"}, {"MAX_COST_PER_RUN_USD": "0"}, {"TOKEN_SAFETY_MARGIN_PERCENT": "91"}, {"SCHEDULE_TIME": "24:00"}, {"SCHEDULE_MODE": "daily"}, {"REQUEST_DELAY_MS": "soon"}, {"LLM_PROVIDER": ""}):
        with pytest.raises(config.ConfigError, match=next(iter(wrong))):
            config.settings(wrong)


ENTRY = "id long, job_id string, tokens_in long, tokens_out long, ts timestamp"


def test_days_of_a_stream_with_late_and_repeated_entries(spark, tmp_path):
    at = lambda d, h, m=0: dt.datetime(2026, 3, d, h, m, tzinfo=dt.timezone.utc)
    # 5:00 UTC is midnight in Toronto until the 8th
    drops = [
        [(1, "a", 10, 1, at(2, 4, 30)), (2, "a", 20, 2, at(2, 6)), (3, "b", 5, 5, at(2, 12))],
        [(2, "a", 20, 2, at(2, 6)), (4, "a", 7, 7, at(3, 4, 50)), (5, "b", 1, 1, at(3, 5, 20))],
        [(6, "b", 100, 100, at(3, 4, 40)), (7, "a", 3, 3, at(3, 23)), (4, "a", 7, 7, at(3, 4, 50))],
        [(8, "a", 1000, 1000, at(2, 13)), (9, "b", 2, 2, at(5, 12)), (7, "a", 3, 3, at(3, 23))],
        [(10, "c", 1, 1, at(9, 12))],
    ]
    for k, rows in enumerate(drops):
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(ENTRY).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        usage.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "America/Toronto", "1 hour")
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    # entry 6 is late but in time, entry 8 comes when its day is closed
    want = [("2026-03-01", "2026-03", "a", 1, 10, 1), ("2026-03-02", "2026-03", "a", 2, 27, 9), ("2026-03-02", "2026-03", "b", 2, 105, 105), ("2026-03-03", "2026-03", "a", 1, 3, 3), ("2026-03-03", "2026-03", "b", 1, 1, 1), ("2026-03-05", "2026-03", "b", 1, 2, 2)]
    assert got == want
    table = spark.createDataFrame([r for rows in drops for r in rows if r[0] not in (8, 10)], ENTRY)
    assert sorted(map(tuple, usage.days(table, "America/Toronto").collect())) == want
