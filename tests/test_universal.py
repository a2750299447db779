"""The universal dialect and record files, by values worked out by hand."""

import json

from pyspark.sql import functions as F

from inkwell.operators import universal
from inkwell.sources import records


def test_stages_claim_spans():
    got = universal.deterministic("a@b.co c.in\n27AAPFU0939F1ZV 27AAPFU0939F1ZW GST 27AAPFU0939F1ZX\n09822334455 9822334455 020 2567890 0123-456789\n110001 411001")
    assert got["emails"] == ["a@b.co"] and got["websites"] == ["c.in"] and got["gstin"] == "27AAPFU0939F1ZX"
    assert got["phones"] == ["9822334455"] and got["landlines"] == ["020-2567890", "0123-456789"] and got["pincode"] == "411001"
    assert "27AAPFU0939F1ZW" in got["residual"] and "110001" not in got["residual"]


def test_digits_of_scripts():
    assert universal.deterministic("मो ९८२२०१२३४५")["phones"] == ["9822012345"]
    assert universal.normal("e\u0301\u200b") == "é"


def test_branches(spark):
    text = "Sitabuldi, Nagpur | 98220 12345\nRes: 4 Lake View\nUSA: 5th Street, Boston\n9:41 Near bank"
    rows = spark.createDataFrame([(text,)], ["t"]).select(F.explode(universal.addresses(F.col("t"))).alias("a")).select("a.*").collect()
    assert [(r["type"], r["label"], r["address"], r["phone"]) for r in rows] == [("branch", "Sitabuldi", "Sitabuldi, Nagpur", "98220 12345"), ("residence", "Residence", "4 Lake View", None), ("general", "USA", "5th Street, Boston", None)]


def test_city_and_state(spark):
    df = spark.createDataFrame([("12 Park, new delhi",), ("Pune, MAHARASHTRA",), (None,)], "t string")
    got = [tuple(r["x"]) for r in df.select(universal.city_and_state(F.col("t")).alias("x")).collect()]
    assert got == [("Delhi", "Delhi"), ("Pune", "Maharashtra"), ("", "")]


def test_record_files(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(x) for x in ({"id": "1", "prediction": 'so: {"companyName": "A"} ok'}, {"id": "2", "prediction": "none"}, {"id": "3", "prediction": {"companyName": "B"}})))
    got = {r["id"]: r["prediction"] and r["prediction"]["companyName"] for r in records.read_predictions(spark, f"file://{tmp_path}/p.jsonl").collect()}
    assert got == {"1": "A", "2": None, "3": "B"}
    rows = spark.range(2000).withColumn("id", F.col("id").cast("string"))
    share = records.split(rows, "id", 0.1).where("is_validation").count()
    assert 140 < share < 260
    records.write_split(rows, f"file://{tmp_path}/out", "id", 0.1)
    assert spark.read.json(f"file://{tmp_path}/out").count() == 2000
    (tmp_path / "d.txt").write_text("a\n\nb\n")
    assert [(r["position"], r["entry"]) for r in records.dictionary(spark, f"file://{tmp_path}/d.txt").orderBy("position").collect()] == [(0, ""), (1, "a"), (2, "b"), (3, " ")]


def test_nearest_rank(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 4, 2)], "x int")
    assert df.agg(records.nearest_rank(F.col("x"), 0.5), records.nearest_rank(F.col("x"), 0.95)).collect()[0][:] == (4, 5)
