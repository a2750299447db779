"""Lines of cards, by values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import layout


def of(spark, function, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(function(F.col("t"))).collect()[0][0]


@pytest.mark.parametrize(("text", "expected"), [("Ravi's Kitchenware", True), ("ABC Traders", True), ("Co Pilot", False), ("Shah & Co", True), ("Ravi Kumar", False), ("X PVT. LTD. Pune", True), (None, False), ("", False)])
def test_company_words(spark, text, expected):
    assert of(spark, layout.has_company_word, text) is expected


@pytest.mark.parametrize(("text", "expected"), [("॥ श्री ॥", True), ("Om Sai Ram", True), ("Om Sai Traders", False), ("Om the great and the good", False), ("जय माता दी", True), (None, False)])
def test_invocations(spark, text, expected):
    assert of(spark, layout.is_invocation, text) is expected


def test_lists_and_salutations(spark):
    assert of(spark, layout.services, "Dealers in pipes, - valves; x | cables etc.") == ["pipes", " valves", "cables"]
    assert of(spark, layout.salutation, "Dr. A. Rao") == "Dr."
    assert of(spark, layout.salutation, "Dravid") is None
    assert of(spark, layout.is_slogan, "Trusted since 1950") is True
    assert of(spark, layout.is_numeric, "tel 98220") is True
    assert of(spark, layout.is_artifact, "~|*") is True


LINES = "array<struct<text:string,left:int,top:int,right:int,bottom:int>>"


def test_columns(spark):
    lines = [("a", 0, 0, 100, 20), ("b", 500, 5, 600, 25), ("c", 10, 30, 110, 50)]
    assert of(spark, layout.columns_of, lines, LINES) == [0, 1, 0]
    assert of(spark, layout.columns_of, [], LINES) == []


def test_company_by_height_and_words(spark):
    lines = [("॥ श्री ॥", 0, 0, 100, 90), ("Mr. Big", 0, 100, 100, 170), ("KIRAN ENTERPRISES", 0, 180, 100, 210), ("98220 12345", 0, 400, 100, 480)]
    assert of(spark, layout.company_line, lines, LINES) == "KIRAN ENTERPRISES"
    assert of(spark, layout.company_line, [], LINES) is None
