"""Benchmark decontamination: short test items inside long documents. DataFrame functions only.

Items are partitioned by the size of their shingle sets (powers of two). A partition with at most u
shingles keeps, for each item, the floor(u * (100 - percent) / 100) + 1 smallest hashes of its set,
its bottom-k MinHash sketch. A document that holds at least ``percent`` of an item's shingles can't
miss that many of them, so it holds one of the sketch: the search misses nothing, however long the
document. The sketches are an index, a table of (hash, size class, item). Documents' shingles meet it
by hash, which gives candidates; these are verified by exact containment, as counts of the hashes
that the full sets of both have in common.

The index is sent to every task up to BROADCAST_HASHES rows, which are counted first, so that texts
neither move nor are repeated; beyond, shingles are dealt by their hash, and a hash that very many
documents hold is split by the join. The full sets meet only those documents that are candidates.

Shingles are five words between white space, in lower case; of fewer words, the whole sequence. So an
item of fewer than five words is found only in a document of the same words, as the SQL says.

Edge cases: null or empty documents hold nothing; null or empty items are in nothing; null ids are
kept as null; documents of any length are read whole; a share of exactly ``percent`` counts; repeated
documents each count, repeated items give repeated pairs; empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import scratch
from inkwell.llm.exprs import let

WORDS = 5
PERCENT = 80
BLOCK_SHINGLES = 100_000
#: Rows that may be sent to every task: hashes of the index, and candidates; beyond, they are joined.
BROADCAST_HASHES = 2_000_000
SPACE = " \t\n\x0b\f\r"
FOUND = "array<struct<item_id:bigint,shared:int,n:int>>"


def shingles(text: Column) -> Column:
    """The distinct shingle hashes of a text; an empty array without words."""
    words = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(SPACE)), "[ \\t\\n\\x0B\\f\\r]+")

    def sets(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS))))
        whole = F.array(F.xxhash64(F.lit("whole"), F.concat_ws(" ", w)))
        return F.when(F.size(w) >= WORDS, F.array_distinct(runs)).when(F.length(F.get(w, F.lit(0))) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(words, sets)


def sketched(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item_id, n, the size class, the full set and the sketch of each item that has shingles."""
    held = items.select(F.col("item_id").cast("bigint").alias("item_id"), shingles(F.col("text")).alias("full")).where("size(full) > 0")
    held = held.withColumn("n", F.size("full"))
    most = F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("int")
    k = F.floor(most * (100 - percent) / 100).cast("int") + 1
    return held.select("item_id", "n", most.alias("size_class"), "full", F.slice(F.array_sort("full"), F.lit(1), F.least(k, F.col("n"))).alias("sketch"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_HASHES else df


def pairs(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, item_id, shared, n: the items that each different text holds; text_key is xxhash64 of the text."""
    held = scratch.save(sketched(items, percent).withColumn("item", F.monotonically_increasing_id()), "items")
    index = held.select("size_class", "item", F.explode("sketch").alias("h"))
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    met = given.select("doc_id", "text_key", F.explode(shingles(F.col("text"))).alias("h")).join(_small(index), "h")
    met = scratch.save(met.select("doc_id", "text_key", "item").distinct(), "candidates")
    texts = met.select("doc_id", "text_key").distinct()
    same = (F.col("d.text_key") == F.col("c.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))
    found = given.alias("d").join(_small(texts).alias("c"), same).select("d.*").dropDuplicates(["doc_id", "text_key"])
    # A document's hashes are distinct, so each shared one is a row.
    own = found.select("doc_id", "text_key", F.explode(shingles(F.col("text"))).alias("h"))
    wanted = met.join(_small(held.select("item", "item_id", "n", F.explode("full").alias("h"))), "item")
    same = (F.col("o.h") == F.col("w.h")) & (F.col("o.text_key") == F.col("w.text_key")) & F.col("o.doc_id").eqNullSafe(F.col("w.doc_id"))
    shared = own.alias("o").join(wanted.alias("w"), same).select("w.*").groupBy("doc_id", "text_key", "item", "item_id", "n").agg(F.count("*").cast("int").alias("shared"))
    out = scratch.save(shared.where(100 * F.col("shared") >= percent * F.col("n")).select("doc_id", "text_key", "item_id", "shared", "n"), "leaks")
    scratch.drop(held, met)
    return out


def contained(items: DataFrame, percent: int = PERCENT) -> Column:
    """For a row with ``text``: an array of (item_id, shared, n) for the items that it holds.

    The column form of pairs(), for a stated set of items of BLOCK_SHINGLES shingles at most, which become
    constants of the plan.
    """
    held = scratch.save(sketched(items, percent), "items")
    total = held.agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
    if total > BLOCK_SHINGLES:
        raise ValueError(f"{total} shingles are too many for a column; use pairs()")
    none = F.array().cast(FOUND)
    if not total:
        return none
    x = held.agg(F.to_json(F.collect_list(F.struct("item_id", "n", "full", "sketch"))).alias("table"), F.to_json(F.array_distinct(F.flatten(F.collect_list("sketch")))).alias("keys")).collect()[0]
    table = F.from_json(F.lit(x["table"]), "array<struct<item_id:bigint,n:int,full:array<bigint>,sketch:array<bigint>>>")
    keys = F.from_json(F.lit(x["keys"]), "array<bigint>")

    def verify(sh: Column) -> Column:
        def of(met: Column) -> Column:
            near = F.filter(table, lambda x: F.arrays_overlap(x["sketch"], met))
            shared = F.transform(near, lambda x: F.struct(x["item_id"].alias("item_id"), F.size(F.array_intersect(x["full"], sh)).alias("shared"), x["n"].alias("n")))
            return F.when(F.size(met) > 0, F.filter(shared, lambda x: 100 * x["shared"] >= percent * x["n"])).otherwise(none)

        return let(F.array_intersect(sh, keys), of)

    return let(shingles(F.col("text")), verify)


def keep(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no item, with the columns of docs."""
    leaks = pairs(docs, items, percent).select("doc_id", "text_key").distinct()
    same = (F.xxhash64("d.text") == F.col("l.text_key")) & F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("l.doc_id"))
    return docs.alias("d").join(_small(leaks).alias("l"), same, "left_anti").select(*(f"d.`{c}`" for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the pairs of a document and an item that it holds, over all documents and items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    # Repeated rows each have their pairs.
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    same = (F.col("d.text_key") == F.col("f.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
    out = given.alias("d").join(_small(found).alias("f"), same)
    return out.select("d.doc_id", "f.item_id", F.col("f.shared").cast("bigint").alias("n_shared"), F.col("f.n").cast("bigint").alias("n_shingles"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT r, doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE ['whole ' || array_to_string(w, ' ')] END) AS s FROM d WHERE len(w) > 0),
bs AS (SELECT DISTINCT r, item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE ['whole ' || array_to_string(w, ' ')] END) AS s FROM b WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM bs GROUP BY r)
SELECT doc_id, item_id, count(*) AS n_shared, max(n.n) AS n_shingles
FROM ds JOIN bs USING (s) JOIN n ON n.r = bs.r
GROUP BY ds.r, doc_id, bs.r, item_id HAVING 100 * count(*) >= 80 * max(n.n)
"""
