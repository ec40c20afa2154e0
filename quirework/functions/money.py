"""Costs, prices and limits; an unset price leaves the cost unknown, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / F.lit(1e6) * price_in + tokens_out / F.lit(1e6) * price_out


def price_cents(cost_usd: Column, markup: float = 3.0, least: int = 50) -> Column:
    """What a customer pays; work without a price is an error, never the minimum."""
    cents = F.greatest(F.lit(least).cast("long"), F.ceil(cost_usd * F.lit(float(markup)) * F.lit(100.0)).cast("long"))
    return F.when(cost_usd.isNull(), F.raise_error(F.lit("PRICING_NOT_CONFIGURED")).cast("long")).otherwise(cents)


def output_estimate(tokens_in: Column) -> Column:
    return F.ceil(tokens_in * F.lit(1.2)).cast("long")


def paid_limits(tokens_in: Column, tokens_out: Column, cap_in: int = 8000, cap_out: int = 12000) -> dict[str, Column]:
    calls = F.greatest(F.lit(1).cast("long"), F.ceil(tokens_in / F.lit(float(cap_in))))
    grown = lambda x: F.ceil(x * F.lit(1.5)).cast("long")
    return {"max_requests": grown(calls) + 5, "max_input": grown(tokens_in) + cap_in, "max_output": grown(tokens_out) + cap_out}


def effective_limit(limit: Column | int, margin: float) -> Column:
    return F.floor((F.lit(limit) if isinstance(limit, int) else limit) * F.lit(1 - margin / 100.0)).cast("long")
