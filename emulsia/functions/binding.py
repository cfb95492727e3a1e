"""A value that an expression uses more than once, computed once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value as the variable of a lambda: a column that is written twice is computed twice in folds and branches."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
