"""Aliases and snapping by token, worked out by hand from the reference's rules."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import lookup

ALIASES = {"MD": "M.D.", "Dirctor": "Director", "M.D.": "wrong", "Nagpr": "Nagpur City"}


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("CMD, (MD)  MD;\nDirctor\u3000x", "CMD, (M.D.) M.D.; Director x"), ("-- MD", "-- M.D."), ("", ""), (None, None)],
)
def test_aliases_by_token(spark, text, expected):
    assert one(spark, lookup.apply_aliases(F.col("t"), ALIASES), text) == expected


def test_no_aliases(spark):
    assert one(spark, lookup.apply_aliases(F.col("t"), {}), " a  b ") == "a b"


def test_snapped_tokens(spark):
    got = lookup.snap_tokens(F.col("t"), ("Pune", "Nagpur", "City"), ALIASES)
    assert one(spark, got, "CMD Nagpor,  Poona Nagpr Cita") == "CMD Nagpur Poona Nagpur City Cita"
    assert one(spark, lookup.snap_tokens(F.col("t"), ("Pune", "Nagpur", "City"), ALIASES, 0.7), "Cita") == "City"


def test_aliases_as_substrings(spark):
    assert one(spark, lookup.aliased(F.col("t"), {"MD": "M.D.", "M.D.": "doctor"}), "CMD MD") == "Cdoctor doctor"
