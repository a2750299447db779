"""Phone numbers that line breaks divide."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import contacts


@pytest.mark.parametrize(
    ("text", "phones", "pincodes"),
    [
        ("Mob: 98765\n43210", ["9876543210"], []),
        ("98765\n43210, Pune 411 001", ["9876543210"], ["411001"]),
        ("9\n8\n7\n6\n5\n4\n3\n2\n1\n0", ["9876543210"], []),
        ("+1\n212\n555\n0123", ["+1\n212\n555\n0123"], []),
        ("12 ink 34 ink 56", [], []),
    ],
)
def test_numbers_over_lines(spark, text, phones, pincodes):
    got = contacts.contact_fields(spark.createDataFrame([(text,)], ["text"])).collect()[0]
    assert (got["phones"], got["pincodes"]) == (phones, pincodes)
    assert [x["number"] for x in got["labelled_phones"]] == phones
