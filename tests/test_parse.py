"""Layouts of cards, by hand."""

import pytest
from pyspark.sql import functions as F

from inkwell.operators import evaluate, names, offline, pages, parse
from inkwell.sources import records
from inkwell.streaming import jobs


def block(*lines):
    """A block of lines (text, left, top, right, bottom)."""
    box = (min(x[1] for x in lines), min(x[2] for x in lines), max(x[3] for x in lines), max(x[4] for x in lines))
    return ("\n".join(x[0] for x in lines), *box, list(lines))


def layout_of(spark, blocks, **parameters):
    df = spark.createDataFrame([(1, blocks)], f"id int, blocks array<{parse.BLOCK}>")
    return parse.with_layout(df, **parameters).collect()[0]["layout"]


def test_a_card_in_blocks(spark):
    got = layout_of(spark, [
        block(("KIRAN ENTERPRISES", 50, 30, 500, 95)),
        block(("Quality Products, Trusted Service", 50, 110, 400, 130)),
        block(("Kiran Deshmukh", 50, 160, 280, 182), ("Proprietor", 50, 186, 200, 206)),
        block(("Shop 12, Swargate Commercial Complex", 50, 250, 480, 272), ("Tilak Road, Pune - 411030", 50, 276, 380, 298)),
        block(("Mob: +91 98220 99999", 50, 330, 300, 352), ("Email: kiran@kiranenterprises.in", 50, 356, 420, 378)),
    ])
    assert got["company"] == "KIRAN ENTERPRISES" and got["tagline"] == "Quality Products, Trusted Service"
    assert [tuple(p) for p in got["persons"]] == [("Kiran Deshmukh", "Proprietor")]
    assert got["addresses"] == ["Shop 12, Swargate Commercial Complex", "Tilak Road, Pune - 411030"]


def test_tall_number_is_no_company(spark):
    got = layout_of(spark, [block(("+91 98220 12345 / 98220 54321", 50, 300, 500, 380)), block(("Software Solutions", 50, 90, 300, 110)), block(("ROUND INK LABS", 50, 20, 450, 80))])
    assert got["company"] == "ROUND INK LABS"


def test_two_scripts_with_a_prayer(spark):
    got = layout_of(spark, [
        block(("॥ परमात्मा एक ॥", 300, 10, 500, 35)), block(("Mr. Rajesh T. Bokade", 20, 20, 250, 45)), block(("राजस मार्केटींग अॅन्ड सेल्स प्रा. लि.", 40, 100, 750, 160)),
        block(("एक नई सोच जो आपकी जिंदगी बदल दे.....", 100, 175, 700, 205)), block(("ऑफीस पत्ता : ६६ न्यु डायमंड नगर, खरबी रोड, नागपूर. M. No: 8888120511", 20, 220, 780, 250)), block(("Res Add : 90, न्यु डायमंड नगर, खरबी रोड, नागपूर.", 20, 260, 780, 290)),
    ])
    assert got["company"] == "राजस मार्केटींग अॅन्ड सेल्स प्रा. लि." and got["tagline"] == "एक नई सोच जो आपकी जिंदगी बदल दे....."
    assert [p["name"] for p in got["persons"]] == ["Mr. Rajesh T. Bokade"]
    assert len(got["addresses"]) == 2 and "नागपूर" in got["addresses"][0] and "8888120511" not in got["addresses"][0]


def test_columns_keep_their_roles(spark):
    got = layout_of(spark, [block(("Adv. Sneha Kulkarni", 50, 100, 300, 120)), block(("Dr. Rohit Mehra", 700, 100, 950, 120)), block(("Managing Partner & Legal Counsel", 50, 125, 350, 145)), block(("Chief Surgeon & Consultant", 700, 125, 960, 145))])
    # One line of role is also the best block for a company's name, and is taken by it.
    assert {p["name"] for p in got["persons"]} == {"Adv. Sneha Kulkarni", "Dr. Rohit Mehra"}


def test_no_blocks(spark):
    df = spark.createDataFrame([(1, None), (2, [])], f"id int, blocks array<{parse.BLOCK}>")
    for r in parse.with_layout(df).collect():
        assert r["layout"]["company"] is None and r["layout"]["persons"] == [] and r["layout"]["addresses"] == []
    texts = spark.createDataFrame([(1, None, None), (2, "", None), (3, "--- Page 1 ---\nKiran Enterprises", None)], f"id int, text string, blocks array<{parse.BLOCK}>")
    got = {r["id"]: r for r in parse.business_cards(texts).collect()}
    assert got[1]["company"] is None and got[2]["phones"] == [] and got[3]["company"] == "Kiran Enterprises" and got[3]["text"] == "Kiran Enterprises"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(("text", "expected"), [("Plot 4, M. No: 9822012345", "Plot 4"), ("Dhantoli, Nagpur | 98220 54321", "Dhantoli, Nagpur"), ("Shop 2, a.b@gmail.com", "Shop 2"), ("Main Road -", "Main Road")])
def test_address_is_cleaned(spark, text, expected):
    assert one(spark, names.clean_address(F.col("t")), t=text) == expected


def test_prayer_beside_a_name(spark):
    assert one(spark, names.without_prayer(F.col("t")), t="!! श्री जानूबाई देवी प्रसन्न !! Ramesh Patil") == "Ramesh Patil"


def test_inline_roles(spark):
    def got(t):
        x = one(spark, names.inline_person(F.col("t")), t=t)
        return x and tuple(x)

    assert got("Vikram Singhania (Proprietor)") == ("Vikram Singhania", "Proprietor")
    assert got("Rajesh Sharma - CEO") == ("Rajesh Sharma", "CEO") and got("Asha Rao, Partner") == ("Asha Rao", "Partner")
    assert got("Vikram Singhania") is None and got("12345 - CEO") is None


def test_offline_codes():
    got = offline.fields("Kiran\nRef 543210\nX\nY\nZ\nShop 9, Nagar Road - 411030\nPin 400001")
    assert got["pincode"] == "411030"
    assert offline.fields("a 411030", valid_pincodes=frozenset({"400001"}))["pincode"] is None
    assert offline.fields("") == {"phones": [], "landlines": [], "emails": [], "websites": [], "gstin": None, "pincode": None, "residual": ""}


def test_uri_schemes(spark):
    assert one(spark, pages.checked_uri(F.col("u")), u="FILE:///a.png") == "FILE:///a.png"
    with pytest.raises(Exception, match="unsupported scheme"):
        one(spark, pages.checked_uri(F.col("u")), u="https://x/a.png")


def test_pdf_by_type_or_name(spark):
    rows = spark.createDataFrame([("application/PDF", "a"), (None, "b.PDF?x=1"), ("image/png", "c.png"), (None, None)], "m string, u string")
    assert [r["x"] for r in rows.select(pages.is_pdf(F.col("m"), F.col("u")).alias("x")).collect()] == [True, True, False, False]


def test_download(spark):
    row = spark.createDataFrame([(3 << 20, 12 << 20, 1 << 20, 0.5), (3 << 20, 12 << 20, 1 << 20, 0.4)], "d bigint, t bigint, b bigint, s double")
    got = [tuple(r["x"]) for r in row.select(pages.download(*map(F.col, "dtbs")).alias("x")).collect()]
    assert got == [(3.0, 12.0, 25.0, 4.0, 2), (3.0, 12.0, 25.0, None, None)]


def test_polling():
    states = iter(["processing", "processing", "completed"])
    assert jobs.poll(lambda: next(states), pause=lambda s: None) == "completed"
    with pytest.raises(RuntimeError):
        jobs.poll(lambda: "failed")
    with pytest.raises(TimeoutError):
        jobs.poll(lambda: "processing", limit_s=0.0, pause=lambda s: None)


def test_listeners_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string").write.parquet(f"{tmp_path}/in")
    seen = []

    def broken(batch, number):
        raise ValueError("no")

    stream = spark.readStream.schema("id int, s string").parquet(f"{tmp_path}/in")
    query = jobs.listen(stream, [broken, lambda batch, number: seen.append(batch.count())], f"{tmp_path}/c", availableNow=True)
    query.awaitTermination(60)
    assert sum(seen) == 2 and query.exception() is None


def test_ranks_without_interpolation(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 4, 2, 3, 3)] + [("b", 7), ("b", None)], "g string, v int")
    got = {r["g"]: r["value"] for r in records.ranks(rows, ["g"], "v", 0.5).collect()}
    assert got == {"a": 3, "b": 7}
    assert {r["value"] for r in records.ranks(rows, ["g"], "v", 1.0).collect()} == {5, 7}


def test_first_failing(spark):
    rows = spark.range(20).withColumn("bad", F.col("id") % 3 == 0)
    assert [r["id"] for r in evaluate.first_failing(rows, F.col("bad"), "id").collect()] == [0, 3, 6, 9, 12]
