"""Smaller operators, by hand."""

from pyspark.sql import functions as F

from inkwell.operators import bills, healing, model, offline, pages, semantic
from inkwell.sources import records
from inkwell.streaming import jobs


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).collect()[0]["x"]


def test_issuer(spark):
    blocks = [("TAX INVOICE", 0, 0, 100, 40), ("Ink House\nPune", 0, 50, 100, 80), ("small", 0, 90, 100, 95), ("Large but low", 0, 900, 100, 1000)]
    kind = "b array<struct<text:string,left:int,top:int,right:int,bottom:int>>"
    assert one(spark, bills.issuer(F.col("b")), kind, blocks) == "Ink House"


def test_keep_rates(spark):
    rows = spark.createDataFrame([(0.0, "a", "a b"), (0.0, "c", "a b"), (0.5, "a", None)], "severity double, value string, text string")
    got = {r["severity"]: (r["n"], r["kept"]) for r in records.keep_rates(rows, "severity", {"kept": F.coalesce(F.contains("text", F.col("value")), F.lit(False))}).collect()}
    assert got == {0.0: (2, 0.5), 0.5: (1, 0.0)}


def test_phone_styles(spark):
    rows = spark.range(400).select(healing.phone_style(F.lit("9822012345"), F.col("id")).alias("x")).collect()
    assert {r["x"] for r in rows} == {"9822012345", "98220 12345", "+91 98220-12345", "09822012345", "9822 012 345"}


def test_person_takes_phones(spark):
    kind = "p array<struct<name:string,role:string,phones:array<string>>>, n string, f array<string>"
    column = healing.with_person(F.col("p"), F.col("n"), F.col("f"))
    assert [tuple(x) for x in one(spark, column, kind, [("Asha Rao", "CEO", ["1"])], "ASHA RAO", ["1", "2"])] == [("Asha Rao", "CEO", ["1", "2"])]
    assert [tuple(x) for x in one(spark, column, kind, [], "Asha Rao", ["2"])] == [("Asha Rao", "Owner", ["2"])]


def test_job_ids_and_quota(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "i int, s string").select(jobs.job_id("i", "s").alias("x")).collect()
    assert rows[0]["x"] == rows[1]["x"] != rows[2]["x"]
    assert [tuple(r) for r in jobs.quota(spark).collect()] == [(999_999, True)]


def test_nulls_are_written(spark):
    assert one(spark, pages.written("a", "b"), "a string, b int", None, 1) == '{"a":null,"b":1}'


def test_sources_of_predictions(spark):
    gold = spark.createDataFrame([("1", "ask")], "id string, prompt string")
    given = spark.createDataFrame([("1", "x")], "id string, prediction string")
    assert model.predictions(gold, "pred", given=given).collect()[0]["prediction"] == "x"
    assert model.predictions(gold, "model", infer=lambda p, g: '{"companyName": "' + p + '"}').collect()[0]["prediction"]["companyName"] == "ask"
    assert model.predictions(gold, "rules", rules=lambda g: g.withColumn("prediction", F.lit("r"))).collect()[0]["prediction"] == "r"


def test_repaired_json():
    assert model.repaired_json('x {"a": [1, 2,], "b": "c') == '{"a": [1, 2], "b": "c"}'
    assert model.repaired_json("```json\n{\"a\": 1}\n``` bye") == '{"a": 1}'
    assert model.repaired_json(None) is None and model.repaired_json("no") is None


def test_rules_win(spark):
    rules = "struct<phones:array<string>,landlines:array<string>,emails:array<string>,websites:array<string>,gstin:string,pincode:string>"
    answer = "struct<company:string,tagline:string,services:array<string>,persons:array<struct<name:string,role:string>>,address_lines:array<string>,pincode:string>"
    df = spark.createDataFrame([((["1"], [], [], [], None, "411001"), ("Firm", None, None, [("A", "B")], ["x"], "999999"))], f"r {rules}, m {answer}")
    got = offline.merged(df, "r", "m").collect()[0]["merged"]
    assert got["pincode"] == "411001" and got["phones"] == ["1"] and got["company"] == "Firm" and got["services"] == []
    card = {"company": F.lit("Kiran Tradrs"), "persons": F.array(F.struct(F.lit("A").alias("name"), F.lit("Directer").alias("role"))), "address_lines": F.array(F.lit("Tilak Raod, Pune"))}
    fixed = offline.repaired(card, ("Traders",), ("Director",), ("Road", "Pune"), {})
    row = spark.range(1).select(*(v.alias(k) for k, v in fixed.items())).collect()[0]
    assert row["company"] == "Kiran Traders" and row["persons"][0]["role"] == "Director" and row["address_lines"][0].startswith("Tilak ")


def test_null_cards(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "~~\n--")], "id int, text string")
    for r in semantic.universal_cards(df).collect():
        assert r["company"] is None and r["persons"] == [] and r["services"] == [] and r["phones"] == []


def test_short_trades_are_words(spark):
    rows = [(1, "Minni Tools\nVinni Kaspate\nManaging Director"), (2, "Holiday Inn\nTilak Road, Pune"), (3, "Green\nGyms\nAsha Rao : 9822012345")]
    got = {r["id"]: (r["company"], [p["name"] for p in r["persons"]]) for r in semantic.universal_cards(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {1: (None, ["Vinni Kaspate"]), 2: ("Holiday Inn", []), 3: ("Green Gyms", ["Asha Rao"])}


def test_made_cards(spark):
    from inkwell.sources import synthesis

    rows = synthesis.corpus(spark, 200).collect()
    again = synthesis.corpus(spark, 200).repartition(7).collect()
    assert sorted(rows, key=lambda r: r["id"]) == sorted(again, key=lambda r: r["id"])
    clean = [r for r in rows if r["severity"] == 0.0]
    assert clean and all(r["json"] == r["clean_truth"] for r in clean)
    for r in rows:
        assert all(e in r["noisy_ocr"] for e in r["json"]["emails"])
    kept = lambda s: sum(bool(r["json"]["phoneNumbers"]) for r in rows if r["severity"] == s) / sum(r["severity"] == s for r in rows)
    assert kept(0.0) == 1.0 > kept(0.55)


def test_second_thoughts(spark):
    from inkwell.operators import parse, refine

    rows = [(1, "Surya\nMotors\nAsha Rao : 9822012345\nDhantoli, Nagpur | 98220 54321\nRetailer of spare parts"), (2, "Kiran Enterprises\nRamesh Patil\nProprietor\nwww.kiranent.in\nTilak Road, Pune - 411030"), (3, None)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("blocks", F.lit(None).cast(f"array<{parse.BLOCK}>"))
    got = {r["id"]: r for r in refine.refined_cards(df).collect()}
    assert got[1]["company"] == "Surya Motors" and got[1]["tagline"] == "Retailer of spare parts" and got[1]["addresses"] == ["Dhantoli, Nagpur"]
    assert [tuple(p) for p in got[1]["persons"]] == [("Asha Rao", None)] and ("9822054321", "Nagpur") in [tuple(x) for x in got[1]["labelled_phones"]]
    assert got[2]["company"] == "Kiran Enterprises" and [tuple(p) for p in got[2]["persons"]] == [("Ramesh Patil", "Proprietor")]
    assert got[3]["company"] is None and got[3]["persons"] == [] and got[3]["addresses"] == []
