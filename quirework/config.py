"""Settings with their defaults and checks."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass

# Fixed values.
LANGUAGES, DISPLAY_ORDERS = ("en", "fr"), ("ENGLISH_FIRST", "FRENCH_FIRST")


class ConfigError(ValueError):
    """A setting is outside what is allowed; ``code`` is stable."""

    code = "INVALID_CONFIG"


@dataclass(frozen=True)
class Budget:
    """Token and cost limits (the defaults are fixed values); the margin shaves all but the request limits."""

    max_source_tokens_per_request: int = 8000
    max_output_tokens_per_request: int = 12000
    max_requests_per_run: int = 10
    max_input_per_run: int = 100_000
    max_output_per_run: int = 140_000
    max_input_per_day: int = 100_000
    max_output_per_day: int = 140_000
    max_input_per_month: int = 2_000_000
    max_output_per_month: int = 2_800_000
    margin_percent: float = 20.0
    max_cost_per_run: float | None = None
    max_cost_per_day: float | None = None
    max_cost_per_month: float | None = None


# Named run budgets: requests, input tokens and output tokens a run.
PRESETS = {"SAFE_DAILY": (5, 50_000, 70_000), "BALANCED_DAILY": (10, 100_000, 140_000), "WEEKLY": (25, 250_000, 350_000)}


@dataclass(frozen=True)
class Book:
    """What to translate, how to show it, and when."""

    source_language: str = "en"
    target_language: str = "fr"
    display_order: str = "ENGLISH_FIRST"
    granularity: str = "PARAGRAPH"
    schedule: str = "MANUAL"
    time: str = "02:00"

    def __post_init__(self):
        if self.source_language not in LANGUAGES or self.target_language not in LANGUAGES:
            raise ConfigError(f"languages are {', '.join(LANGUAGES)}")
        if self.source_language == self.target_language:
            raise ConfigError("source and target language are the same")
        if self.display_order not in DISPLAY_ORDERS or self.granularity != "PARAGRAPH":
            raise ConfigError("unknown display order or granularity")
        if self.schedule not in ("MANUAL", "DAILY", "WEEKLY") or not re.fullmatch(TIMES, self.time):
            raise ConfigError("unknown schedule, or a time that isn't HH:mm")


# The variables of a Budget's limits; other settings with their defaults.
VARIABLES = {
    "max_source_tokens_per_request": "MAX_SOURCE_TOKENS_PER_REQUEST",
    "max_output_tokens_per_request": "MAX_ESTIMATED_OUTPUT_TOKENS_PER_REQUEST",
    "max_requests_per_run": "MAX_REQUESTS_PER_RUN",
    "max_input_per_run": "MAX_INPUT_TOKENS_PER_RUN",
    "max_output_per_run": "MAX_OUTPUT_TOKENS_PER_RUN",
    "max_input_per_day": "MAX_INPUT_TOKENS_PER_DAY",
    "max_output_per_day": "MAX_OUTPUT_TOKENS_PER_DAY",
    "max_input_per_month": "MAX_INPUT_TOKENS_PER_MONTH",
    "max_output_per_month": "MAX_OUTPUT_TOKENS_PER_MONTH",
    "margin_percent": "TOKEN_SAFETY_MARGIN_PERCENT",
    "max_cost_per_run": "MAX_COST_PER_RUN_USD",
    "max_cost_per_day": "MAX_COST_PER_DAY_USD",
    "max_cost_per_month": "MAX_COST_PER_MONTH_USD",
}
TIMES, WEEKDAYS = r"([01]\d|2[0-3]):[0-5]\d", ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")


@dataclass(frozen=True)
class Settings:
    """What the environment says: provider, schedule, budget, prices, retries."""

    budget: Budget
    provider: str = "mock"
    schedule: str = "MANUAL"
    time: str = "02:00"
    zone: str = "America/Toronto"
    weekday: str = "SUN"
    retries: int = 3
    delay_ms: int = 1500
    price_in: float | None = None
    price_out: float | None = None
    markup: float = 3.0
    least_cents: int = 50


def settings(environ: Mapping[str, str]) -> Settings:
    """Settings from variables: coerced, defaulted and checked; a ConfigError names the first variable that is wrong."""

    def number(name: str, default, whole: bool = False, above: float | None = None, most: float = math.inf):
        text = environ.get(name)
        if text is None or (default is None and text == ""):
            return default
        try:
            value = float(text) if text.strip() else 0.0
        except ValueError:
            raise ConfigError(f"{name} is no number") from None
        low = value > 0 if above is not None else value >= 0
        if not (low and value <= most and math.isfinite(value)) or (whole and value != int(value)):
            raise ConfigError(f"{name} is out of range")
        return int(value) if whole else value

    def choice(name: str, default: str, allowed: tuple[str, ...] | str) -> str:
        value = environ.get(name, default)
        if not (re.fullmatch(allowed, value) if isinstance(allowed, str) else value in allowed):
            raise ConfigError(f"{name} is not allowed")
        return value

    limits = {}
    for name, variable in VARIABLES.items():
        default = getattr(Budget, name)
        if default is None:
            limits[name] = number(variable, None, above=0)
        else:
            limits[name] = number(variable, default, whole=isinstance(default, int), most=90 if name == "margin_percent" else math.inf)
    return Settings(
        budget=Budget(**limits), provider=choice("LLM_PROVIDER", "mock", r".+"), schedule=choice("SCHEDULE_MODE", "MANUAL", ("MANUAL", "DAILY", "WEEKLY")), time=choice("SCHEDULE_TIME", "02:00", TIMES), zone=choice("SCHEDULE_TIMEZONE", "America/Toronto", r".+"),
        weekday=choice("SCHEDULE_DAY_OF_WEEK", "SUN", WEEKDAYS), retries=number("MAX_RETRIES_PER_SEGMENT", 3, whole=True), delay_ms=number("REQUEST_DELAY_MS", 1500, whole=True), price_in=number("MODEL_INPUT_PRICE_PER_MILLION_TOKENS_USD", None, above=0),
        price_out=number("MODEL_OUTPUT_PRICE_PER_MILLION_TOKENS_USD", None, above=0), markup=number("PLATFORM_MARKUP_MULTIPLIER", 3.0, above=0), least_cents=number("PLATFORM_MINIMUM_CHARGE_USD_CENTS", 50, whole=True),
    )
