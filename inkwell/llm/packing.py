"""Harmonic packing of tokenised documents into sequences of at most CAPACITY tokens.

A document is cut into pieces whose lengths are reciprocal parts of the capacity: first whole
sequences, then, while more than ``TAIL`` tokens are left, the largest floor(capacity / k) that
fits, and the rest as it is. Class n holds the pieces of n tokens; each of its bins takes a fixed
number of pieces, k = capacity // n, so a bin wastes less than one piece of the class.

Each task tokenises its documents and numbers its pieces within a class. The counts of pieces by
task and class (tasks x at most ~80 classes) give each task its first number, so all tasks fill bins
independently and, all told, a class has at most one bin that isn't full. The pieces of those last
bins (fewer than 5,000 in all, whatever the input) are packed first-fit by falling length.

Edge cases: null or empty text is one piece that holds the closing id; a null doc_id is kept as
null; texts of any length are tokenised whole; of pieces of equal length the one numbered first goes
first; repeated rows are packed once each; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import scratch
from inkwell.llm.batches import slices, texts

CAPACITY = 1024
TAIL = 64
END_ID = 0
#: The vocabulary of byte_bpe_50k.json as ranks; its ids are the same, and merging by ranks takes a third of the time.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The vocabulary itself, for its added tokens, which the ranks don't hold.
ADDED = "byte_bpe_50k.json"

#: A run of white space from which on a text is cut.
LONG_RUN = 100_000
#: The pattern's white space (Unicode's White_Space), which isn't that of Python's patterns.
SPACES = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LONG_RUN},}}")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Text to the bytes of its ids (little-endian unsigned 32-bit).

    Names of added tokens are found first, the longest of those that begin at a place, and the texts
    between them are read on their own.

    The pattern can't match a run of about a million white-space characters, so texts are cut at long
    runs. Such a run is one piece, without its last character where a word follows; that one is read
    with the word, as the pattern does.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(vocabulary_path(ADDED), encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on their neighbours")
        self.added = {a["content"]: a["id"] for a in added}
        self.names = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.names.finditer(text):
            out += self._ordinary(text[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return np.array(out + self._ordinary(text[at:]) if at else self._ordinary(text), "<u4").tobytes()

    def _ordinary(self, text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return self.encoding.encode_ordinary(text)
        out, at = [], 0
        for m in SPACES.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.encoding.encode_ordinary(text[at : m.start()])
            out += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return out + self.encoding.encode_ordinary(text[at:])


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """Lengths of the pieces of n tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > tail:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return out + [n] * (n > 0)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, number bigint"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int32()), ("number", pa.int64())])

def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, tail: int = TAIL) -> DataFrame:
    """A row for each piece, numbered within its task and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, task, numbers = Vocabulary(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in slices(batches):
            columns: list[list[int | None]] = [[] for _ in SCHEMA]
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
                ids = vocabulary.ids(text) + END_ID.to_bytes(4, "little")
                start = 0
                for n in cuts(len(ids) // 4, capacity, tail):
                    for column, x in zip(columns, (doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, task, numbers[n]), strict=True):
                        column.append(x)
                    start += n
                    numbers[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _last_bins(capacity: int):
    """Packs the pieces that fill no bin of their class; there are fewer than the classes' bins can hold."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (-r["length"], r["number"]))
        used: list[int] = []
        for r in rows:
            at = next((i for i, n in enumerate(used) if n + r["length"] <= capacity), len(used))
            if at == len(used):
                used.append(0)
            r["sequence_id"], r["offset"] = r["base"] + at, used[at]
            used[at] += r["length"]
        if rows:
            names = ["length", "number", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in names], names)

    return fit


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, tail: int = TAIL) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    Sequence ids are gapless from 0 within a run: those of class n come before those of n - 1, and the
    mixed ones of the last bins come last.
    """
    cut = scratch.save(pieces(docs, path or vocabulary_path(), capacity, tail), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = scratch.save(counts.select("task", "length", before.alias("before"), "n"), "piece-counts")
    # A row for each class: capacity of them at most.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    classes, base = [], 0
    for length in sorted(totals, reverse=True):
        full = totals[length] // (capacity // length)
        classes.append((length, capacity // length, full, base))
        base += full
    spark = docs.sparkSession
    # Bounded by the number of classes, so it's small enough to broadcast at any size of the input.
    table = F.broadcast(spark.createDataFrame(classes, "length bigint, k bigint, full bigint, base bigint"))
    ranked = cut.join(counts.drop("n"), ["task", "length"]).select(*cut.columns, (F.col("number") + F.col("before")).alias("rank")).drop("number", "task").join(table, "length")
    in_class = F.col("rank") < F.col("full") * F.col("k")
    head = ranked.where(in_class).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.floor(F.col("rank") / F.col("k"))).alias("sequence_id"), (F.col("rank") % F.col("k") * F.col("length")).alias("offset"))
    rest = ranked.where(~in_class)
    mixed = rest.select("length", F.col("rank").alias("number"), F.lit(base).cast("bigint").alias("base")).repartition(1).mapInArrow(_last_bins(capacity), "length bigint, number bigint, sequence_id bigint, offset bigint")
    rest = rest.join(F.broadcast(mixed.withColumnRenamed("number", "rank")), ["length", "rank"]).select(*head.columns)
    return head.unionByName(rest)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
