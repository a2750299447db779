"""Values worked out by hand for the operators."""

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import bills, classify, contacts, evaluate, fuse, lookup


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("a +91 98765 43210\nb 919123456780\nc 09822334455\nd 8765432109\ne 76543-21098", ["9876543210", "9123456780", "9822334455", "8765432109", "7654321098", "09822334455"]),
        ("Mob: +91 98220 12345 / 98220 54321", ["9822012345", "9822054321"]),
        ("98220 11111 / 22222", ["9822011111", "9822022222"]),
        ("Tel: 020-25678901, Fax: 022 28765432", ["020-25678901", "022 28765432"]),
        ("M.G. Road, Pune - 411001, Maharashtra", []),
        ("call +1 212 555 0123", ["+1 212 555 0123"]),
        ("मो ९८२२०१२३४५", ["9822012345"]),
        ("", []),
    ],
)
def test_phones(spark, text, expected):
    assert one(spark, contacts.phones(F.col("t")), t=text) == expected


def test_nulls_give_empty_arrays(spark):
    df = spark.createDataFrame([(1, None)], "id int, text string")
    row = contacts.contact_fields(df).collect()[0]
    assert all(row[c] == [] for c in ("phones", "labelled_phones", "emails", "websites", "gstins", "pincodes"))


def test_labels(spark):
    got = one(spark, contacts.labelled_phones(F.col("t")), t="98220 12345\nMob: 98220 12345\nDhantoli, Nagpur | 98220 54321\n98220 77777 (res)")
    assert [(x["number"], x["label"]) for x in got] == [("9822012345", "Mobile"), ("9822054321", "Nagpur"), ("9822077777", "Residence")]


def test_repairs(spark):
    assert one(spark, contacts.emails(F.col("t")), t="j o h n @g m a i l.com or Sales©firm.in or a.b@gmai1.com") == ["john@gmail.com", "sales@firm.in", "a.b@gmail.com"]


def test_pin_in_a_phone_number(spark):
    assert one(spark, contacts.pincodes(F.col("t")), t="9841101199 Pune 411011, Thane 400 601") == ["400601"]


def test_tax_id_check(spark):
    assert one(spark, T.gstin_check(F.col("t")), t="27AAPFU0939F1ZV") is True
    assert one(spark, T.gstin_check(F.col("t")), t="27AAPFU0939F1ZW") is False


def test_similarity(spark):
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a="abcd", b="abxd") == 0.75
    assert one(spark, T.character_error(F.col("a"), F.col("b")), a="ab", b="wxyz") == 1.0


def test_classifier(spark):
    assert one(spark, classify.document_type(F.col("t")), t="Tax Invoice for you") == "bill"
    assert one(spark, classify.document_type(F.col("t")), t="Patient receipt") == "bill"
    assert one(spark, classify.document_type(F.col("t")), t="Receipts, Director") == "card"
    assert one(spark, classify.document_type(F.col("t")), t=" ") == "card"


def test_bill_of_a_text(spark):
    df = spark.createDataFrame([("Total Estimated Cost: $3,450.00\nTotal Amount Owed: $2,200.00\nGOOD FAITH ESTIMATE",)], ["text"])
    row = bills.bill_fields(df).collect()[0]
    assert (row["document_type"], row["subtotal"], row["amount_due"]) == ("GOOD FAITH ESTIMATE", 3450.0, 2200.0)


def line(text, left, top, right):
    return {"text": text, "left": left, "top": top, "right": right, "bottom": top + 20}


def test_table_without_heading():
    got = bills.line_items([line("Paper", 20, 100, 90), line("₹1,850.00", 300, 102, 380), line("Total", 20, 200, 90), line("9", 300, 200, 380)])
    assert got == [{"description": "Paper", "code": None, "billed": 1850.0, "paid": None, "responsibility": None}]


def test_table_of_five_columns():
    heads = [line(t, x, 100, x + 90) for t, x in (("PROCEDURE", 20), ("CODE", 270), ("BILLED", 400), ("PAID", 520), ("PATIENT", 660))]
    cells = [line(t, x, 140, x + 90) for t, x in (("Visit", 20), ("99213", 270), ("$150.00", 400), ("$100.00", 520), ("$50.00", 660))]
    assert bills.line_items([*heads, *cells, line("Total Due", 20, 230, 110)]) == [{"description": "Visit", "code": "99213", "billed": 150.0, "paid": 100.0, "responsibility": 50.0}]


def test_bill_pages(spark):
    rows = [(1, 2, "INVOICE", None, None, None, 2.0, 9.0, []), (1, 1, "", "A-1", None, None, 1.0, None, [])]
    df = spark.createDataFrame(rows, f"doc_id int, page_no int, document_type string, invoice_number string, invoice_date string, due_date string, subtotal double, amount_due double, items {bills.ITEMS}")
    row = bills.merge_pages(df).collect()[0]
    assert (row["document_type"], row["invoice_number"], row["subtotal"], row["amount_due"], row["items"]) == ("INVOICE", "A-1", 2.0, 9.0, [])


def test_matching_takes_each_gold_value_once(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "a", "c"])], "g array<string>, p array<string>")
    assert df.select(evaluate.matched(F.col("g"), F.col("p"), False)).collect()[0][0] == 1


def test_evidence(spark):
    assert one(spark, evaluate.has_evidence(F.col("v"), F.col("t"), "digits"), v="98220", t="tel 9 8 2 2 0") is True
    assert one(spark, evaluate.has_evidence(F.col("v"), F.col("t"), "text"), v="Sharma Stores", t="SHARNA ST0RES pune") is True
    assert one(spark, evaluate.has_evidence(F.col("v"), F.col("t"), "text"), v="Sharma Stores", t="unrelated words") is False


def test_fusion(spark):
    a = [line("Rajesh", 0, 0, 100), line("9822012345", 0, 50, 100)]
    b = [line("राजेश", 0, 2, 100), line("पुणे", 0, 200, 100)]
    df = spark.createDataFrame([(a, b)], f"a array<{fuse.BLOCK}>, b array<{fuse.BLOCK}>")
    got = df.select(fuse.fused_blocks(F.col("a"), F.col("b")).alias("x")).collect()[0]["x"]
    assert [x["text"] for x in got] == ["राजेश", "9822012345", "पुणे"]


def test_lookups(spark):
    assert one(spark, lookup.script_family(F.col("t")), t=" EN ") == "latin"
    assert one(spark, lookup.script_family(F.col("t")), t="zh-Hans") == "devanagari"
    assert one(spark, lookup.first_place(F.col("t")), t="12, old road, navi mumbai") == "Mumbai"
    assert one(spark, lookup.snap(F.col("t"), ("Pune", "Nagpur"), 0.7), t="Nagpor") == "Nagpur"
    assert one(spark, lookup.snap(F.col("t"), ("Pune", "Nagpur"), 0.9), t="Nagpor") == "Nagpor"
