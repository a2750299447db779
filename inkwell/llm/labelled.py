"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import scratch

#: About so many labelled rows are learnt from, however many there are.
SAMPLE_ROWS = 24_000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y, part): documents of a hash sample of the labelled rows that aren't held out.

    A row is held out if crc32(doc_id as text) mod 5 is 0. part is 0 to 3 by a hash of the id. Nulls
    in the id or the label are left out; of repeated labels of an id the largest counts.
    """
    keep = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    keep = keep.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = keep.count()
    if total > rows:
        keep = keep.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * rows / total))
    # The sample's size is bounded, so its ids can be broadcast whatever the corpus holds.
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(keep), "doc_id")
    return scratch.save(found.select(F.coalesce("text", F.lit("")).alias("text"), "y", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).cast("int").alias("part")), "sample")
