"""Made cards with recognition noise, and labels that the noisy text still shows.

Every choice is a hash of the row's number, the seed and the choice's name, so a row is the same
whatever the partitioning, and a run is as large as ``rows`` says.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.exprs import digits
from inkwell.functions.text import similarity, skeleton
from inkwell.operators.healing import phone_style

FIRST = ("Asha", "Ramesh", "Sunil", "Meera", "Vijay", "Anita", "Kiran", "Prakash", "राजेश", "सुनीता", "अनिल", "कविता")
LAST = ("Patil", "Deshmukh", "Kulkarni", "Joshi", "Shinde", "Rao", "Mehta", "Pawar", "जोशी", "पाटील", "शिंदे", "देशमुख")
BRANDS = ("Shree", "Om", "Surya", "Ganga", "Nava", "Royal", "साई", "समर्थ")
TRADES = ("Motors", "Traders", "Electronics", "Furniture", "Enterprises", "ट्रेडर्स", "मोटर्स", "ज्वेलर्स")
ROLES = ("Proprietor", "Director", "Manager", "Partner", "संचालक", "मालक")
GOODS = ("Pipes", "Valves", "Pumps", "Cables", "Tools", "दुरुस्ती", "स्पेअर्स")
STREETS = ("Tilak Road", "Main Road", "Station Road", "लक्ष्मी रोड", "शिवाजी चौक")
CITIES = (("Pune", "4110"), ("Nagpur", "4400"), ("Nashik", "4220"), ("Thane", "4006"))
TIERS = (0.0, 0.10, 0.28, 0.55)
#: Likeness that a line has to keep for a value to stay a label, and a person's name on its own.
LIKE, LIKE_NAME = 0.55, 0.35
#: Signs that recognition takes for one another.
CONFUSED = {"0": "O", "O": "0", "1": "l", "l": "1", "5": "S", "S": "5", "8": "B", "B": "8", "व": "ब", "ब": "व", "ी": "ि", "ि": "ी", "े": "ै", "ो": "ौ"}


def _hash(name: str, seed: int) -> Column:
    return F.xxhash64(F.col("id"), F.lit(seed), F.lit(name))


def _pick(values: tuple[str, ...], name: str, seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(_hash(name, seed), F.lit(len(values))) + 1).cast("int"))


def _number(length: int, name: str, seed: int) -> Column:
    return F.lpad(F.pmod(_hash(name, seed), F.lit(10**length)).cast("string"), length, "0")


def truth(spark: SparkSession, rows: int, seed: int = 1337) -> DataFrame:
    """(id, severity, card, lines): cards as they were meant, and their lines (kind, text)."""
    n = spark.range(rows)
    brand, trade = _pick(BRANDS, "brand", seed), _pick(TRADES, "trade", seed)
    place = F.element_at(F.array(*(F.struct(F.lit(c).alias("city"), F.lit(p).alias("pin")) for c, p in CITIES)), (F.pmod(_hash("city", seed), F.lit(len(CITIES))) + 1).cast("int"))
    pin = F.concat(place["pin"], _number(2, "pin", seed))
    handle = F.concat(F.lit("shop"), _number(4, "handle", seed))
    made = n.select(
        "id", F.element_at(F.array(*map(F.lit, TIERS)), (F.pmod(_hash("tier", seed), F.lit(len(TIERS))) + 1).cast("int")).alias("severity"),
        F.concat_ws(" ", brand, trade).alias("companyName"), F.concat_ws(" ", _pick(FIRST, "first", seed), _pick(LAST, "last", seed)).alias("name"), _pick(ROLES, "role", seed).alias("role"),
        F.concat(F.lit("9"), _number(9, "phone", seed)).alias("phone"), F.concat(handle, F.lit("@gmail.com")).alias("email"), F.concat(F.lit("www."), handle, F.lit(".in")).alias("website"),
        F.array_distinct(F.array(_pick(GOODS, "good 1", seed), _pick(GOODS, "good 2", seed), _pick(GOODS, "good 3", seed))).alias("providedServices"),
        F.concat(F.lit("Shop "), _number(2, "shop", seed), F.lit(", "), _pick(STREETS, "street", seed), F.lit(", "), place["city"], F.lit(" - "), pin).alias("address"), pin.alias("pincode"),
    )
    card = F.struct("companyName", F.array(F.struct("name", "role")).alias("contactPersons"), F.array("phone").alias("phoneNumbers"), F.array("email").alias("emails"), F.array("website").alias("websites"), "providedServices", F.array("address").alias("addressLines"), "pincode")
    shown = phone_style(F.col("phone"), F.col("id"))
    lines = [("company", F.col("companyName")), ("person", F.concat_ws(" - ", "name", "role")), ("service", F.array_join("providedServices", ", ")), ("phone", F.concat(F.lit("Mob: "), shown)), ("email", F.col("email")), ("website", F.col("website")), ("address", F.col("address"))]
    return made.select("id", "severity", card.alias("card"), F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in lines)).alias("lines"))


def blurred(text: str, severity: float, rng: random.Random) -> str:
    """signs taken for others, left out, or set apart, more of them with the severity."""
    out = []
    for c in text:
        x = rng.random()
        if x < 0.18 * severity and c in CONFUSED:
            c = CONFUSED[c]
        elif x < 0.05 * severity and not c.isspace():
            c = ""
        elif x > 1 - 0.03 * severity:
            c += " "
        out.append(c)
    return "".join(out)


def with_noise(cards: DataFrame, seed: int = 1337) -> DataFrame:
    """cards with ``noisy`` (kind, text of the lines left, in their new order) and ``noisy_ocr``; e-mail and site lines are never blurred."""

    def noisy(row_id: int, severity: float, lines: list[dict]) -> list[dict]:
        rng = random.Random(f"{seed}:{row_id}")
        left = [{"kind": x["kind"], "text": x["text"] if x["kind"] in ("email", "website") else blurred(x["text"], severity, rng)} for x in lines if rng.random() >= 0.18 * severity]
        if len(left) > 2 and rng.random() < 0.5 * severity:
            rest = left[1:]
            rng.shuffle(rest)
            left = [left[0], *rest]
        if len(left) > 3 and rng.random() < 0.5 * severity:
            at = rng.randrange(len(left) - 1)
            left[at : at + 2] = [{"kind": left[at]["kind"], "text": f"{left[at]['text']} {left[at + 1]['text']}"}]
        return left

    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [noisy(*x) for x in zip(b["id"].to_pylist(), b["severity"].to_pylist(), b["lines"].to_pylist(), strict=True)]
            yield b.append_column("noisy", pa.array(found, kind))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cards.schema), "noisy array<struct<kind:string,text:string>>"])
    return cards.mapInArrow(run, schema).withColumn("noisy_ocr", F.array_join(F.transform("noisy", lambda x: x["text"]), "\n"))


def relabelled(cards: DataFrame) -> DataFrame:
    """Cards with ``json``: of each value what the noisy text still shows, by the likeness of its best line or by its digits."""
    lines = F.transform("noisy", lambda x: x["text"])
    own = digits(F.col("noisy_ocr"))

    def like(value: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(lines, lambda x: F.when(F.contains(skeleton(x), skeleton(value)), F.lit(1.0)).otherwise(similarity(skeleton(x), skeleton(value))))), F.lit(0.0))

    def kept(values: Column, test) -> Column:
        return F.filter(values, test)

    c = F.col("card")
    people = kept(c["contactPersons"], lambda p: (like(p["name"]) > LIKE_NAME) | (like(F.concat(p["name"], p["role"])) >= LIKE))
    exact = lambda v: F.contains(F.col("noisy_ocr"), v)
    return cards.withColumn("json", F.struct(
        F.when(like(c["companyName"]) >= LIKE, c["companyName"]).alias("companyName"), people.alias("contactPersons"), kept(c["phoneNumbers"], lambda v: F.contains(own, v)).alias("phoneNumbers"), kept(c["emails"], exact).alias("emails"),
        kept(c["websites"], exact).alias("websites"), kept(c["providedServices"], lambda v: like(v) >= LIKE).alias("providedServices"), kept(c["addressLines"], lambda v: like(v) >= LIKE).alias("addressLines"), F.when(F.contains(own, c["pincode"]), c["pincode"]).alias("pincode"),
    ))


def corpus(spark: SparkSession, rows: int, seed: int = 1337) -> DataFrame:
    """(id, severity, noisy_ocr, json, clean_truth)."""
    out = relabelled(with_noise(truth(spark, rows, seed), seed))
    return out.select("id", "severity", "noisy_ocr", "json", F.col("card").alias("clean_truth"))
