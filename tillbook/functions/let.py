"""Bind an intermediate value once inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated a single time per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cases(*branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """First matching branch wins."""
    condition, result = branches[0]
    chain = F.when(condition, result)
    for condition, result in branches[1:]:
        chain = chain.when(condition, result)
    return chain if otherwise is None else chain.otherwise(otherwise)
