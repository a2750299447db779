"""Kinds of lines, by values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import lines


@pytest.mark.parametrize(
    ("function", "yes", "no"),
    [
        (lines.is_section, ["Our Services:", "we offer"], ["Service with a smile", None]),
        (lines.is_contact, ["Mob 12", "9822012345", "a@b"], ["Ravi Kumar", None]),
        (lines.is_address_fragment, ["ravi gnal corn", "E-mail"], ["Ravi Kumar", None]),
        (lines.is_status_bar, ["10:42 12KB/s", "VoLTE 4G"], ["Plot 4", None]),
        (lines.is_garbled, ["CEOY9909€,", "a!b!c!"], ["M.G. Road, Pune - 4", None]),
        (lines.is_catalogue, ["• Pipes", "* Valves"], ["• Shop 4, MG Road", "Pipes", None]),
        (lines.is_goods_list, ["Pipes, valves, wires", "Dealers in steel", "Saris, shirts etc."], ["Pipes & valves, wires, etc.", "Ravi Kumar", None]),
        (lines.is_title_case_name, ["Ravi Kumar", "T. S. Rao Patil"], ["Ravi", "Ravi Traders", "ravi kumar", "Best Vision", "A. B.", "Ravi, Kumar", None]),
        (lines.wants_devanagari, ["", None, "संचालक", "MG Road", "+91 98"], ["a@b.co", "John Doe, CEO of a firm in the far west", "12345"]),
    ],
)
def test_kinds(spark, function, yes, no):
    df = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "t string, e boolean")
    assert [(r["t"], r["x"]) for r in df.select("t", "e", function(F.col("t")).alias("x")).collect()] == [(t, True) for t in yes] + [(t, False) for t in no]


def test_recognised_lines(spark):
    rows = [("~|*", 0.9, 10, 10, False), ("ab", 0.2, 10, 10, False), ("LOGO", 0.9, 500, 500, False), ("Ravi Kumar", 0.5, 100, 10, True)]
    df = spark.createDataFrame(rows, "t string, c double, w int, h int, e boolean")
    got = [r[0] for r in df.select(lines.is_text_line(F.col("t"), F.col("c"), F.col("w"), F.col("h"), F.lit(1000), F.lit(1000))).collect()]
    assert got == [False, False, False, True]


def test_better_pass(spark):
    df = spark.createDataFrame([("Sanchalak", "संचालक"), ("", "long enough text"), ("Ravi Kumar, Pune", "Ravi")], "a string, b string")
    assert [r[0] for r in df.select(lines.devanagari_is_better(F.col("a"), F.col("b"))).collect()] == [True, True, False]
