"""Small helpers shared by the column functions."""

from __future__ import annotations

from typing import Callable, Union

from pyspark.sql import Column, functions as F

Col = Union[str, Column]


def as_col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]
