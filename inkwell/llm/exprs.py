"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once per row, also where body uses it inside a lambda.

    The optimiser may copy a column's expression to every place that names the column; a lambda's
    variable it can't.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
