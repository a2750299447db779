"""Merged pages and the response contract, by values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import cards


def page(doc, no, company=None, persons=(), phones=(), emails=(), address=(), services=(), text="t"):
    own = [{"name": n, "role": r, "phones": list(p), "email": None} for n, r, p in persons]
    return (doc, no, company, None, own, list(phones), list(emails), [], list(address), list(services), None, None, text)


SCHEMA = f"doc_id int, page_no int, {cards.CARD}"


@pytest.mark.parametrize(("name", "expected"), [("Ravi Kumar", True), ("R2 D2 C3 PO", False), ("Pipes, Valves", False), ("Scan me", False), ("ab", False), (None, False), ("• Ravi", False), ("Our Services:", False)])
def test_persons(spark, name, expected):
    assert spark.createDataFrame([(name,)], "n string").select(cards.is_person(F.col("n"))).collect()[0][0] is expected


def test_pages(spark):
    pages = [
        page(1, 2, "Second", [("Loose Word", None, ())], text="b"),
        page(1, 1, " ", [("Ravi Kumar", "Director", ()), ("ravi kumar", "CEO", ())], ["98", "99"], ["a@b.co"], services=["x"], text="a"),
        page(2, 1, "Only", text="z"),
    ]
    got = {r["doc_id"]: r for r in cards.merge_pages(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert got[1]["company"] == "Second" and [p["name"] for p in got[1]["persons"]] == ["Ravi Kumar"]
    assert got[1]["services"] == ["x", "Loose Word"] and got[1]["phones"] == ["98", "99"]
    assert got[1]["raw_text"] == "--- Page 1 ---\na\n\n--- Page 2 ---\nb" and got[2]["raw_text"] == "z"


def test_contract(spark):
    full = page(1, 1, "TechNova Solutions", [("Asha Rao", "Director", ())], ["98", "99"], ["a@b.co"], ["12 MG Road", "Mumbai, Maharashtra 400001"])
    empty = page(2, 1)
    named = page(3, 1, "Dr. Rao", [("Dr. Rao", None, ())], ["98"])
    got = {r["doc_id"]: r for r in cards.response(spark.createDataFrame([full, empty, named], SCHEMA)).collect()}
    one = got[1]
    assert (one["data"]["city"], one["data"]["state"], one["data"]["second_phone"], one["data"]["category"]) == ("Mumbai", "Maharashtra", "99", "General Business")
    assert one["needs_review"] == [] and one["status"] == "completed" and one["overall"] == 0.95
    assert got[2]["overall"] == 0.5 and got[2]["needs_review"] == list(cards.REVIEWED) and got[2]["status"] == "needs_review"
    assert got[3]["data"]["company"] == "" and got[3]["data"]["full_name"] == "Dr. Rao"


def test_failed_scan(spark):
    df = spark.createDataFrame([page(1, 1)], SCHEMA).withColumn("error", F.lit("no page"))
    row = cards.response(df).collect()[0]
    assert (row["success"], row["code"], row["data"]) == (False, "SCAN_FAILED", None)
