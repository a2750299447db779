"""Texts and layouts built from the relational tables, with answers that the tables hold (for queries and tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import table


def suppliers(spark, sf_dir: str) -> DataFrame:
    """The table, dealt to all cores: it's one row group, and each of its rows becomes a card."""
    return table(spark, sf_dir, "supplier").repartition(spark.sparkContext.defaultParallelism)


def cards(spark, sf_dir: str) -> DataFrame:
    """A card for each supplier: id, text, and the values that it was built from."""
    s = suppliers(spark, sf_dir)
    key = F.col("s_suppkey")
    mobile = F.concat(F.lit("9"), F.lpad((key * 7919 % 1_000_000_000).cast("string"), 9, "0"))
    land = F.concat(F.lit("2"), F.lpad((key * 104_729 % 10_000_000).cast("string"), 7, "0"))
    number = F.lpad(key.cast("string"), 8, "0")
    pin = F.concat(F.lit("411"), F.lpad((key % 1000).cast("string"), 3, "0"))
    code = F.concat(F.lit("27AAPFU"), F.lpad((key % 10_000).cast("string"), 4, "0"), F.lit("F1ZV"))
    built = s.select(key.alias("id"), F.col("s_name").alias("company"), mobile.alias("mobile"), land.alias("land"), number.alias("number"), pin.alias("pin"), code.alias("code"), F.element_at(F.array(*map(F.lit, ("Pune", "Nagpur", "Thane", "Surat", "Elsewhere"))), (key % 5 + 1).cast("int")).alias("city"))
    lines = [
        F.col("company"), F.lit("Proprietor"), F.concat(F.lit("Mob: +91 "), F.left("mobile", F.lit(5)), F.lit(" "), F.right("mobile", F.lit(5))), F.concat(F.lit("Tel (off): 020-"), F.col("land")),
        F.concat(F.lit("Email: Sales"), F.col("number"), F.lit("@GMAI1.com")), F.concat(F.lit("www.shop"), F.col("number"), F.lit(".in/")), F.concat(F.lit("GSTIN "), F.col("code")), F.concat(F.lit("Plot, "), F.col("city"), F.lit(" - "), F.col("pin")),
    ]
    return built.withColumn("text", F.concat_ws("\n", *lines))


def bills(spark, sf_dir: str) -> DataFrame:
    """A bill for each order that has items: id, text and lines in a table of four columns."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def cell(text, left: int, right: int, top):
        return F.struct(text.cast("string").alias("text"), F.lit(left).alias("left"), top.cast("int").alias("top"), F.lit(right).alias("right"), (top + 20).cast("int").alias("bottom"))

    priced = items.select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", F.format_number("l_extendedprice", 2).alias("billed"), F.format_number(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("paid")).alias("i"))
    grouped = priced.groupBy("id").agg(F.array_sort(F.collect_list("i")).alias("i"))
    rows = F.flatten(F.transform("i", lambda x, k: F.array(
        cell(F.concat(F.lit("Part "), x["l_partkey"].cast("string")), 20, 250, 140 + 40 * k), cell(F.concat(F.lit("C"), x["l_linenumber"].cast("string")), 270, 350, 140 + 40 * k),
        cell(F.concat(F.lit("$"), x["billed"]), 400, 500, 140 + 40 * k), cell(F.concat(F.lit("$"), x["paid"]), 520, 640, 140 + 40 * k),
    )))
    head = F.array(*(cell(F.lit(t), a, b, F.lit(100)) for t, a, b in (("DESCRIPTION", 20, 250), ("CODE", 270, 350), ("BILLED", 400, 500), ("INSURANCE PAID", 520, 640))))
    end = F.array(cell(F.lit("TOTAL: 1"), 20, 250, 140 + 40 * F.size("i")))
    joined = orders.join(grouped, orders["o_orderkey"] == grouped["id"])
    text = F.concat_ws("\n", F.lit("TAX INVOICE"), F.concat(F.lit("Invoice No: INV-"), F.col("id").cast("string")), F.concat(F.lit("Invoice Date: "), F.date_format("o_orderdate", "dd/MM/yyyy")), F.concat(F.lit("Due Date: "), F.date_format(F.date_add("o_orderdate", 30), "dd/MM/yyyy")), F.lit("Subtotal: $0.50"), F.concat(F.lit("Amount Due: $"), F.format_number("o_totalprice", 2)))
    return joined.select("id", text.alias("text"), F.concat(head, rows, end).alias("lines"))


def word(key):
    """A word of letters that a number spells: each digit is a letter."""
    return F.initcap(F.translate(F.lpad(key.cast("string"), 5, "0"), "0123456789", "kalominuve"))


def laid_out_cards(spark, sf_dir: str) -> DataFrame:
    """A card for each supplier in one of four layouts, with text, and what each field should be.

    0: company, person, role, slogan, address, contacts. 1: the same, person with a salutation first and no role.
    2: services in a list, role and name on one line, two lines of address. 3: no person, no slogan.
    """
    s = suppliers(spark, sf_dir)
    key = F.col("s_suppkey")
    kind = key % 4
    company = F.concat(word(key), F.lit(" Enterprises"))
    person = F.concat(word(key * 7 + 11), F.lit(" "), word(key * 3 + 5))
    pin = F.concat(F.lit("4110"), F.lpad((key % 100).cast("string"), 2, "0"))
    place = F.concat(F.lit("Shop "), (key % 90).cast("string"), F.lit(", Tilak Road, Pune - "), pin)
    mobile = F.concat(F.lit("98"), F.lpad((key * 7919 % 100_000_000).cast("string"), 8, "0"))
    contact = [F.concat(F.lit("Mob: "), mobile), F.concat(F.lit("Email: info@"), F.lower(word(key)), F.lit(".in"))]
    motto = F.lit("Quality you can see")
    lines = (
        F.when(kind == 0, F.array(company, person, F.lit("Managing Director"), motto, place, *contact))
        .when(kind == 1, F.array(F.concat(F.lit("Dr. "), person), company, motto, place, *contact))
        .when(kind == 2, F.array(company, F.concat(person, F.lit(" - Proprietor")), F.lit("Pipes, Valves, Pumps etc."), F.lit("Plot 4, Industrial Area"), place, *contact))
        .otherwise(F.array(company, place, *contact))
    )
    return s.select(key.alias("id"), F.array_join(lines, "\n").alias("text"))
