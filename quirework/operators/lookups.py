"""Look-ups, ownership, projections and other plain relational steps of the stored relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import money
from quirework.operators import segments

# Names of the languages and schedule modes.
LANGUAGES = {"en": "English", "fr": "French"}
MODES = {"manual": "MANUAL", "daily": "DAILY", "weekly": "WEEKLY"}


class NotFound(LookupError):
    """A row that must be there is not; ``code`` tells which kind."""

    def __init__(self, code: str, keys: list):
        super().__init__(f"{code}: {keys}")
        self.code = code


def by_key(rows: DataFrame, key: str, values: list) -> DataFrame:
    return rows.where(F.col(key).isin(values))


def must_have(rows: DataFrame, key: str, values: list, code: str) -> DataFrame:
    """The rows of a few keys, or NotFound with the keys that are missing."""
    found = by_key(rows, key, values)
    have = {r[0] for r in found.select(key).distinct().collect()}
    if missing := [v for v in values if v not in have]:
        raise NotFound(code, missing)
    return found


def by_email(users: DataFrame, email: str, column: str = "email") -> DataFrame:
    return users.where(F.lower(column) == email.lower())


def owned(rows: DataFrame, owner: str, callers: DataFrame) -> DataFrame:
    """Rows whose owner is among the callers (one column)."""
    return rows.join(callers, rows[owner] == callers[callers.columns[0]], "left_semi")


def named(asked: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return asked.join(rows, keys)


def fresh(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those whose key is not stored."""
    return rows.join(stored.select(*keys), keys, "left_anti")


def verdicts(books: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """(key, valid, issues, codes): one row a book; codes in the order ``at``, valid if there are none."""
    own = issues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("x"))
    codes = F.array_join(F.col("x.code"), ", ")
    return books.join(own, key, "left").select(key, F.col("x").isNull().alias("valid"), F.when(F.col("x").isNull(), 0).otherwise(F.size("x")).cast("long").alias("issues"), F.coalesce(codes, F.lit("")).alias("codes"))


def upload_facts(docs: DataFrame) -> DataFrame:
    """(book, chapter_count, paragraph_count, source_token_estimate, estimated_output_tokens)."""
    chapters = docs.groupBy(F.coalesce("source", F.lit("")).alias("book")).agg(F.count(F.lit(1)).alias("chapter_count"))
    own = segments.segments(docs).groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    tokens = F.coalesce("t", F.lit(0))
    return chapters.join(own, "book", "left").select("book", "chapter_count", F.coalesce("n", F.lit(0)).alias("paragraph_count"), tokens.alias("source_token_estimate"), money.output_estimate(tokens).alias("estimated_output_tokens"))


def looked_up(value: Column, names: dict[str, str]) -> Column:
    """By a small fixed table, without regard to case; null where it has no such name."""
    return F.try_element_at(F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]), F.lower(value))


def mode_of(flag: Column) -> Column:
    return looked_up(flag, MODES)


def language_name(code: Column) -> Column:
    return looked_up(code, LANGUAGES)


def parsed(text: Column, schema: str) -> Column:
    """A JSON text by its schema; null fields where it does not fit."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})
