"""Context-window arithmetic of one model call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR_STEPS = 20


def rebuilt_context(creation: Column, read: Column, min_tokens: int, min_pct: int) -> Column:
    """A call that wrote nearly everything it cached: its thread started over."""
    return (creation >= min_tokens) & (creation * 100 >= (creation + read) * min_pct)


def context_fill() -> Column:
    return (
        F.col("cache_read_tokens")
        + F.col("cache_creation_tokens")
        + F.col("input_tokens")
        + F.col("output_tokens")
    )


def context_added() -> Column:
    return F.col("cache_creation_tokens") + F.col("input_tokens") + F.col("output_tokens")


def opening_context() -> Column:
    return F.col("cache_read_tokens") + F.col("cache_creation_tokens") + F.col("input_tokens")


def bar_step(tokens: Column, window: Column) -> Column:
    """A token count as one of twenty steps of its window, halves to even, full at the top."""
    return F.least(F.bround(tokens / window * F.lit(BAR_STEPS)), F.lit(float(BAR_STEPS))).cast("int")
