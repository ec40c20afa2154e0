"""Calendar keys, schedules, leases and delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(instant: Column, zone: str = "UTC") -> Column:
    """yyyy-MM-dd of a UTC instant (without zone) in a zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant), "yyyy-MM-dd")


def month_key(instant: Column, zone: str = "UTC") -> Column:
    return F.substring(date_key(instant, zone), 1, 7)


def completion_date(day: Column, runs: Column, mode: Column) -> Column:
    step = F.when(mode == "DAILY", 1).when(mode == "WEEKLY", 7)
    return F.date_format(F.date_add(day, ((runs - 1) * step).cast("int")), "yyyy-MM-dd")


def cron(mode: Column, time: Column, weekday: Column) -> Column:
    hour, minute = (F.split(time, ":")[k].cast("int").cast("string") for k in (0, 1))
    return F.when(mode == "DAILY", F.concat_ws(" ", minute, hour, F.lit("* * *"))).when(mode == "WEEKLY", F.concat_ws(" ", minute, hour, F.lit("* *"), weekday.cast("string")))


def backoff(attempt: Column, retry_after: Column, base: int = 1000, most: int = 30000) -> Column:
    """Milliseconds before jitter: what the provider asks for, else doubling; never above the most."""
    return F.when(retry_after.isNotNull(), F.least(retry_after, F.lit(most))).otherwise(F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))).cast("long")

