"""Record files and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CARD = "struct<companyName:string,tagline:string,providedServices:array<string>,contactPersons:array<struct<name:string,role:string>>,phoneNumbers:array<string>,emails:array<string>,websites:array<string>,addressLines:array<string>,pincode:string,gstin:string>"
GOLD = f"id string, lang string, severity double, text string, noisy_ocr string, json {CARD}, clean_truth {CARD}"
PREDICTION = "id string, prediction string"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows from JSON lines, with a declared schema, so the files are read once."""
    return spark.read.schema(GOLD).json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions, as objects or as JSON in a string; one that isn't JSON is null."""
    rows = spark.read.schema(PREDICTION).json(path)
    outer = F.regexp_extract("prediction", r"(?s)\{.*\}", 0)
    return rows.select("id", F.from_json(F.when(outer != "", outer), CARD).alias("prediction"))


def split(rows: DataFrame, key: str, validation: float, seed: int = 1337) -> DataFrame:
    """Rows with ``is_validation``, for about that share of keys; a row's part depends on its key and the seed alone, so nothing is sorted."""
    buckets = 1 << 20
    return rows.withColumn("is_validation", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)) < int(buckets * validation))


def write_split(rows: DataFrame, path: str, key: str, validation: float, seed: int = 1337) -> None:
    """JSON lines in path/is_validation=true and =false, written in one pass."""
    split(rows, key, validation, seed).write.partitionBy("is_validation").json(path)


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(position, entry): a blank at 0, then the file's lines that aren't empty, and a space last. Dictionaries are small; the window is by file."""
    lines = spark.read.text(path).where("value != ''").select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("entry"))
    numbered = lines.withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("at"))).select("file", "position", "entry")
    ends = numbered.groupBy("file").agg(F.max("position").alias("n"))
    first = ends.select("file", F.lit(0).alias("position"), F.lit("").alias("entry"))
    last = ends.select("file", (F.col("n") + 1).alias("position"), F.lit(" ").alias("entry"))
    return first.unionByName(numbered).unionByName(last)


def nearest_rank(value: Column, p: float) -> Column:
    """A20 as an aggregate, for groups whose values fit in a row; ranks() is for any."""
    # percentile_disc is one rank off at whole p * n.
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.least(F.floor(p * F.size(ordered)), F.size(ordered) - 1).cast("int"))


def ranks(rows: DataFrame, by: list[str], value: str, p: float, name: str = "value") -> DataFrame:
    """By group, the element at min(floor(p * n), n - 1) of the sorted values, without interpolation.

    Values are counted first, so a group's window is over its different values. Null values don't count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v"))
    total = F.sum("_n").over(Window.partitionBy(*by))
    ranked = counts.select(*by, "_v", upto.alias("_upto"), total.alias("_all"))
    return ranked.where(F.col("_upto") > F.least(F.floor(p * F.col("_all")), F.col("_all") - 1)).groupBy(*by).agg(F.min("_v").alias(name))


def keep_rates(rows: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """The share of rows that each flag holds for, by a column."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c.cast("double")).alias(name) for name, c in flags.items()))
