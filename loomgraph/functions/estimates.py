"""Cost and time estimates of a build with a hosted model."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dollars for a million tokens of prompt and completion.
PRICES = {"gpt-4o": (5.0, 15.0), "gpt-4o-mini": (0.150, 0.600)}
CALLS_PER_TOKEN = 2.5
WORKERS = 2


def cost(tokens: int, model: str) -> float:
    if model not in PRICES:
        raise ValueError(f"no price is known for {model}")
    prompt, completion = PRICES[model]
    millions = tokens / 1e6
    return round((millions * prompt + millions * completion / 4) * CALLS_PER_TOKEN, 4)


def cost_column(tokens: Column, model: str) -> Column:
    prompt, completion = PRICES[model]
    millions = tokens / F.lit(1e6)
    return F.round((millions * prompt + millions * completion / 4) * CALLS_PER_TOKEN, 4)


def seconds(chunks: int, model: str) -> int:
    each = 4 if model == "gpt-4o" else 2
    reading = each if chunks <= WORKERS else math.ceil(chunks / WORKERS) * each
    return reading + 2 * chunks * each


def time_text(chunks: int, model: str) -> str:
    """Seconds up to a minute, minutes with three decimals beyond."""
    s = seconds(chunks, model)
    if s <= 60:
        return f"{s} seconds"
    minutes = round(s / 60, 3)
    return f"{minutes} minute" + "s" * (minutes > 1)


def seconds_column(chunks: Column, model: str) -> Column:
    each = 4 if model == "gpt-4o" else 2
    reading = F.when(chunks <= WORKERS, F.lit(each)).otherwise(F.ceil(chunks / WORKERS) * each)
    return (reading + 2 * chunks * each).cast("long")
