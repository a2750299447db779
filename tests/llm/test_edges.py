"""Nulls, empty and odd texts, repeated rows, empty tables and extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from inkwell.llm import decontaminate, html, media, neardup, packing, pii, quality, secrets, suffixes, toxicity
from inkwell.llm import labelled

LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
ROWS = [
    (0, "one two three four five six", "src0"), (1, None, None), (2, "", "src1"), (3, "a b", "src1"), (3, "a b", "src1"), (None, "password=abcdef123 1.2.3.4", None),
    (4, LONG, "src2"), (5, "x" * 250, "src2"), (6, "\x00 \x1c é 😀 <|endoftext|> +1 (234) 555-0100 a@b.co", "src3"), (7, "\n\t \r", "src3"),
]
EXTRA = ["key", "term", "found", "rid", "nid", "at", "quality_score", "host"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, source string")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(EXTRA))).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(8)] + [(None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "one two three four five six"), (2, None), (3, ""), (None, "q r s t u v w")], "item_id bigint, text string")


def operators(docs, labels, items):
    def model():
        return quality.fit(labelled.sample(docs, labels, "quality"))

    return {
        "quality": lambda: quality.score(docs, model()),
        "secrets": lambda: secrets.find(docs),
        "redact": lambda: secrets.redact(docs),
        "contained": lambda: docs.withColumn("x", decontaminate.contained(items)),
        "neardup": lambda: neardup.near_duplicates(docs),
        "pii": lambda: pii.find(docs),
        "packing": lambda: packing.pack(docs).where("start = 0"),
        "suffixes": lambda: suffixes.dedup(docs),
        "toxicity": lambda: toxicity.score(docs, toxicity.fit(labelled.sample(docs, labels, "toxic"))),
    }


NAMES = ["quality", "secrets", "redact", "contained", "neardup", "pii", "packing", "suffixes", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(docs, labels, items, name):
    got = operators(docs, labels, items)[name]().select("doc_id").collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in ROWS), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(docs, labels, items, name):
    assert operators(docs.limit(0), labels.limit(0), items.limit(0))[name]().collect() == []


def test_pages(spark):
    rows = [(1, None, None), (2, "http://h.example/1", ""), (2, "http://h.example/1", ""), (None, "x", "<p>a &amp; b<p>c <b>d</b>"), (3, "http://h.example/2", "<div" * 2000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("tokens", F.lit(1)).withColumn("host", F.lit("h"))
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    assert got == {(1, "", 0), (2, "", 0), (None, "a & b\nc d", 9), (3, "", 0)}
    assert html.extract(df.limit(0)).collect() == []


def test_media(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/a"
    listed = media.store(docs, folder).collect()
    assert sum(r["members"] for r in listed) == len(ROWS)
    got = media.features(media.read(spark, folder, range_bytes=5000)).collect()
    expected = sorted((len((t or "").encode()), media.payload_of(t or "")[-32:].hex()) for _, t, _ in ROWS)
    assert sorted(r["n_bytes"] for r in got) == [n for n, _ in expected]
    empty = f"file://{tmp_path}/b"
    assert media.store(docs.limit(0), empty).collect() == []
    assert media.features(media.read(spark, empty)).collect() == []
