"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value computed once per row, also where ``build`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def settle(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a computed column that later steps read as it is. Inputs of Python functions need this: the planner
    would otherwise move the expression into the call, and it does not plan calls around nested lambdas."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def stretches(sizes: Sequence[int], rows: int, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of stretches of a batch's rows: at most ``rows`` each, and of a total size of at most ``most`` unless it
    is a single row. An Arrow batch holds up to 64 MB, which are many times more as Python objects."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (i - start >= rows or total + size > most):
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
