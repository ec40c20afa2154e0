"""Calls to a translation provider as a stage of its own: a request in, a reply and what it took out.

A provider is the one plug-in: an object made on the executor by a registered factory.  A row is one
request (a batch of segments as JSON), so an Arrow batch of requests is called row by row, and a
row holds what a request limit allows.  A call that fails for a reason that may pass is tried
again after a delay, doubling and with up to an eighth more; how much more is a hash of the request and the attempt, so a
task that runs again waits as long and gives the same rows.  Replies are checked against
their schema before anything is taken from them; ids are matched, never places.

A task that is run again calls the provider again; what is kept of it is appended once (``sources.store``).
"""

from __future__ import annotations

import hashlib
import json
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delays in milliseconds, the names of languages in a request, the fields of a reply.
BASE, MOST, RETRIES = 1000, 30_000, 3
LANGUAGES = {"en": "English", "fr": "French"}
REPLY = "translations array<struct<id string, translatedText string>>"
#: The same as a tool's input schema, for providers that take one.
TOOL = {"name": "submit_translations", "input_schema": {"type": "object", "properties": {"translations": {"type": "array", "items": {"type": "object", "properties": {"id": {"type": "string"}, "translatedText": {"type": "string"}}, "required": ["id", "translatedText"]}}}, "required": ["translations"]}}
SENT = "batch string, reply string, error string, message string, attempts int, delays array<bigint>"


class Fault(Exception):
    """A call failed; ``code`` is stable."""

    code, retryable, retry_after = "PROVIDER_ERROR", False, None


class AuthFault(Fault):
    """The key is missing or refused: never tried again."""

    code = "AUTH_ERROR"


class RateLimited(Fault):
    """Too many calls: always tried again, after what the provider asks for (milliseconds) if it does."""

    code, retryable = "RATE_LIMIT_ERROR", True

    def __init__(self, message: str = "", retry_after: int | None = None):
        super().__init__(message)
        self.retry_after = retry_after


class ProviderFault(Fault):
    """Any other failure; it says whether it may pass."""

    def __init__(self, message: str = "", retryable: bool = True):
        super().__init__(message)
        self.retryable = retryable


class Provider(ABC):
    provider, model = "abstract", "none"

    @abstractmethod
    def translate(self, request: dict) -> str:
        """The reply, as JSON, to {sourceLanguage, targetLanguage, segments: [{id, text}]}."""


class Mock(Provider):
    """Offline and deterministic: the text behind the target language's tag."""

    provider, model = "mock", "mock-1"

    def translate(self, request: dict) -> str:
        tag = next((k for k, v in LANGUAGES.items() if v == request["targetLanguage"]), request["targetLanguage"])
        return json.dumps({"translations": [{"id": s["id"], "translatedText": f"[{tag.upper()}] {s['text']}"} for s in request["segments"]]}, ensure_ascii=False)


Factory = Callable[[Mapping[str, str]], Provider]
FACTORIES: dict[str, tuple[Factory, tuple[str, ...]]] = {"mock": (lambda settings: Mock(), ())}


def chosen(name: str, settings: Mapping[str, str]) -> Factory:
    """The factory of a provider, by configuration alone; a key that it needs and that is not set is an AuthFault."""
    if name not in FACTORIES:
        raise ValueError(f"no provider {name!r}; there are {', '.join(sorted(FACTORIES))}")
    factory, needs = FACTORIES[name]
    for key in needs:
        if not settings.get(key):
            raise AuthFault(f"{key} is not set")
    return factory


def share(batch: str, attempt: int) -> float:
    """Between 0 and 1, the same for a request's attempt in every run of its task."""
    return int(hashlib.md5(f"{batch}:{attempt}".encode()).hexdigest()[:8], 16) / 2**32


def delay(batch: str, attempt: int, retry_after: int | None = None, base: int = BASE, most: int = MOST) -> int:
    """Milliseconds before the next attempt: what the provider asks for, or doubling with up to an eighth more."""
    if retry_after is not None:
        return min(retry_after, most)
    capped = min(base * 2**attempt, most)
    return int(capped + capped * 0.125 * share(batch, attempt))


def called(batch: str, call: Callable[[], str], retries: int, sleep: Callable[[float], None]) -> tuple[str | None, Fault | None, list[int]]:
    """(reply, fault, delays) of a call and its repetitions."""
    delays: list[int] = []
    while True:
        try:
            return call(), None, delays
        except Fault as fault:
            if not fault.retryable or len(delays) >= retries:
                return None, fault, delays
            delays.append(delay(batch, len(delays), fault.retry_after))
            sleep(delays[-1] / 1000)


def requests(segments: DataFrame, source: str, target: str) -> DataFrame:
    """(batch, ids, request) of segments (batch, id, text), in order of ids; a batch without segments has no row, and no call."""
    rows = segments.groupBy(F.col("batch").cast("string").alias("batch")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text")))).alias("s"))
    name = lambda x: F.lit(LANGUAGES.get(x, x))
    return rows.select("batch", F.col("s.id").alias("ids"), F.to_json(F.struct(name(source).alias("sourceLanguage"), name(target).alias("targetLanguage"), F.col("s").alias("segments"))).alias("request"))


def sent(asked: DataFrame, factory: Factory, settings: Mapping[str, str] | None = None, *, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(batch, reply, error, message, attempts, delays): one row a request."""
    settings = dict(settings or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory(settings)
        for rows in batches:
            out = []
            for batch, request in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                reply, fault, delays = called(batch, lambda: provider.translate(json.loads(request)), retries, sleep)  # noqa: B023
                out.append((batch, reply, fault and fault.code, fault and str(fault), len(delays) + 1, delays))
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["batch", "reply", "error", "message", "attempts", "delays"])

    return asked.select("batch", "request").mapInArrow(run, SENT)


def checked(replies: DataFrame) -> DataFrame:
    """Adds ``translations`` (null where there are none to take) and makes a reply that its schema refuses an error, REPLY_INVALID."""

    def strict(reply: Column) -> Column:
        """The list, if the reply is an object with one and every item has both texts as strings."""
        found = F.from_json(reply, REPLY)["translations"]
        quoted = F.from_json(reply, "translations array<map<string,string>>")["translations"]
        whole = found.isNotNull() & F.forall(found, lambda x: x.isNotNull() & x["id"].isNotNull() & x["translatedText"].isNotNull()) & (F.size(found) == F.size(quoted))
        return F.when(whole, found)

    out = replies.withColumn("translations", strict(F.col("reply")))
    broken = F.col("error").isNull() & F.col("translations").isNull()
    return out.withColumn("error", F.when(broken, "REPLY_INVALID").otherwise(F.col("error")))


def translations(judged: DataFrame) -> DataFrame:
    """(batch, id, ord, translated) of checked replies: what ``contract.outcome`` holds against the segments."""
    return judged.where("error is null").select("batch", F.posexplode("translations").alias("ord", "x")).select("batch", "x.id", "ord", F.col("x.translatedText").alias("translated"))
