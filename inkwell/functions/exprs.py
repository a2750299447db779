"""Building blocks for expressions over texts and arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for each row: the optimiser can't copy a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern (or one of its groups) in a text; none in a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), F.lit(group + 1))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def last(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def found(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null without a match."""
    return first(matches(text, pattern, group))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def words(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))
