"""Values used several times in one Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once and written once, so that nesting doesn't repeat it."""
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))


def lets(values: list[Column], use: Callable[..., Column]) -> Column:
    """use(*values), each of them bound; they must be of one type."""
    return F.get(F.transform(F.array(F.array(*values)), lambda held: use(*(F.get(held, F.lit(i)) for i in range(len(values))))), F.lit(0))
