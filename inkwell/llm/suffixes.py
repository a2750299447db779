"""Exact substring dedup: every byte goes that a LENGTH-byte string covers which also starts earlier.

The suffixes of all texts are compared on their first LENGTH bytes, by a difference cover and one
bucket at a time.

Cover sample. COVER is a difference cover modulo MODULUS: for any two positions i and j there is a
shift d < MODULUS for which i + d and j + d are both sample positions (position in its document,
modulo MODULUS, in COVER). So if the strings at i and j are equal, two samples at the same shift
agree on the WINDOW = LENGTH - MODULUS + 1 bytes from them, and nothing but the samples has to be
sorted to bring equal strings together: 8 positions in 57.

Ranks. Samples are sorted by window and then by rank, hashes of all bytes that a string through the
sample can hold (MODULUS - 1 before it, LENGTH from it on). A tie that goes on over all of these is a
long tie: the strings through two samples of equal rank are equal one by one, so all but the first
sample's are gone, MODULUS strings at a time and without a look at any of them. A window of one rank
only is done with. Of the others, two samples can have equal strings through them only if they agree
on HALF bytes more on one side; samples that do stay open on that side.

Suffixes. Only the strings through open samples are sorted themselves, each position once, and all
but the first of equal ones are gone. These lie at the ends of repeated passages.

Buckets. Samples and strings are dealt by the leading bits of their hashes in passes, and these in
small buckets. One pass at a time is read off the texts, dealt, resolved and freed, so disk holds a
part of the suffixes at a time, whatever the input. A task sorts one bucket at a time, in runs of
RUN rows: of a run only the first of each rank (or string) is kept for the next one. Buckets grow in
number with the texts; a window that very many ranks share, of which a task would hold too many, has
them all handed on as open, which costs their strings a look and loses nothing. Samples and strings
are dealt DEALT at a time, without those that repeat among these, so what a third of all documents
repeat is dealt once for some megabytes of text.

Texts don't move, but those of documents with open samples (to read their strings) and with removed
bytes (to cut them), which are picked out by their keys first. Windows, ranks and strings are told
apart by 128 bits of hash: 64 and 64, of two independent polynomials over the bytes.

Edge cases: null or empty text, or one shorter than LENGTH bytes, loses nothing. Very long texts are
read in units; positions are 32-bit unsigned. Where doc_ids are null or repeat, rows are ordered by
doc_id (null last), and rows of one doc_id in an order of their own; each row gets its row. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import scratch
from inkwell.llm.batches import slices

LENGTH = 100
#: A perfect difference set: each difference modulo 57 but 0 occurs once.
MODULUS = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
WINDOW = LENGTH - MODULUS + 1
#: Bytes that a pair of samples has to agree on before or after the window.
HALF = (LENGTH - WINDOW) // 2
#: A multiple of MODULUS, so that a unit's positions keep their residues.
UNIT_BYTES = MODULUS * 4_600
#: Passes over the texts for samples and for strings; powers of two.
SAMPLE_PASSES, STRING_PASSES = 4, 2
#: Rows of a bucket that are meant to be there, and the least number of buckets in a pass.
BUCKET_ROWS, LEAST_BUCKETS = 1 << 19, 1 << 10
#: Rows that a task sorts at once, and ranks of one window that it keeps if it has to keep too many.
RUN, WINDOW_RANKS = 1 << 20, 64
#: Samples or strings that a task deals together.
DEALT = 1 << 18
#: Keys of documents that may be sent to every task to pick out texts; beyond, texts are joined with them.
BROADCAST_KEYS = 8_000_000
#: Positions that a task gathers by document before it hands them on.
GATHERED = 1 << 19

_U = np.uint64
_RNG = np.random.default_rng(20_101)
_TABLES = _RNG.integers(0, 1 << 64, (2, 256), _U)
_BASES = (0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93 | 3)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
#: Sample positions of a unit.
_SAMPLES = (np.arange(0, UNIT_BYTES, MODULUS, dtype=np.int64)[:, None] + np.array(COVER)).ravel()


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xA0761D6478BD642F)
    x ^= x >> _U(32)
    return x


class Hasher:
    """Hashes of substrings: differences of prefix sums of byte values times powers of a base."""

    def __init__(self) -> None:
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, UNIT_BYTES + 4096)
            steps = [np.full(self.size, b, _U) for b in (*_BASES, *_INVERSES)]
            for s in steps:
                s[0] = 1
                np.multiply.accumulate(s, out=s)
            self.up, self.down = steps[:2], steps[2:]
            self.room, self.sums = np.empty(self.size, _U), np.zeros((2, self.size), _U)

    def of(self, data: np.ndarray) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
        """A function of (which polynomial, starts, ends) that gives the hashes of data[start:end], until of() is called again."""
        n = len(data)
        self._grow(n + 1)
        known: set[int] = set()

        def hashes(which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
            s = self.sums[which]
            if which not in known:
                known.add(which)
                room = self.room[:n]
                np.take(_TABLES[which], data, out=room, mode="clip")
                np.multiply(room, self.up[which][:n], out=room)
                np.cumsum(room, out=s[1 : n + 1])
            out = s[end]
            out -= s[start]
            out *= self.down[which][start]
            return _mixed(out)

        return hashes


class Unit:
    """Parts of texts, one after another: of each the key, where it begins in its text and in the unit, the text's length, and its own range."""

    def __init__(self, parts: list[tuple]) -> None:
        """parts: key, bytes, offset of these in the text, length of the text, first and last position that is the part's own, and what else belongs to it."""
        self.parts = parts
        self.keys = np.array([p[0] for p in parts], np.int64)
        self.offsets = np.array([p[2] for p in parts], np.int64)
        self.lengths = np.array([p[3] for p in parts], np.int64)
        sizes = np.array([len(p[1]) for p in parts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.data = np.concatenate([p[1] for p in parts])


def _bytes(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each text of a column without nulls, as views."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return [data[s:e] for s, e in zip(ends, ends[1:], strict=False)]


def units(batches: Iterator[pa.RecordBatch], extra: tuple[str, ...] = ()) -> Iterator[Unit]:
    """Units of rows with key and text (no nulls); a part has the bytes around its own range that strings through its samples hold."""
    parts, size = [], 0
    for b in slices(batches):
        others = [b[c].to_pylist() for c in extra]
        for i, (key, data) in enumerate(zip(b["key"].to_pylist(), _bytes(b["text"]), strict=True)):
            n = len(data)
            for at in range(0, n if n >= LENGTH else 0, UNIT_BYTES):
                begin, end = max(0, at - MODULUS), min(n, at + UNIT_BYTES + LENGTH)
                parts.append((key, data[begin:end], begin, n, at, min(n, at + UNIT_BYTES), *(c[i] for c in others)))
                size += end - begin
                if size >= UNIT_BYTES:
                    yield Unit(parts)
                    parts, size = [], 0
    if parts:
        yield Unit(parts)


def _again(columns: list[np.ndarray], key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows are not the first, by key and pos, of those that agree in the columns."""
    order = np.argsort(columns[0])
    first = columns[0][order]
    same = first[1:] == first[:-1]
    out = np.zeros(len(key), bool)
    some = order[np.append(same, False) | np.append(False, same)]
    if len(some):
        some = some[np.lexsort((pos[some], key[some], *(c[some] for c in reversed(columns))))]
        equal = np.logical_and.reduce([c[some][1:] == c[some][:-1] for c in columns])
        out[some[1:][equal]] = True
    return out


#: What is dealt: rows of a bucket as arrays side by side: two hashes, the document's key, the position in it, and of samples two hashes
#: of 16 bits, of the HALF bytes before and after the window. Without hashes: rows that are gone.
DEALT_ROWS = "bucket int, h binary, r binary, key binary, pos binary, near binary"
_COLUMNS = {"h": np.uint64, "r": np.uint64, "key": np.int64, "pos": np.uint32, "near": np.uint32}
#: Positions by document, as little-endian unsigned 32-bit numbers: samples that are gone, or open on a side, and strings that are gone.
FOUND = "key bigint, gone binary, before binary, after binary, strings binary"
KINDS = ("gone", "before", "after", "strings")
_FOUND = pa.schema([("key", pa.int64()), *((k, pa.binary()) for k in KINDS)])


class _Gather:
    """Positions by kind and document, handed on in rows of FOUND."""

    def __init__(self) -> None:
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, kind: str, key: np.ndarray, pos: np.ndarray) -> None:
        if len(key):
            self.rows.append((np.full(len(key), KINDS.index(kind), np.int8), key, pos))
            self.size += len(key)

    def full(self) -> bool:
        return self.size >= GATHERED

    def out(self) -> pa.RecordBatch:
        kind, key, pos = (np.concatenate(c) for c in zip(*self.rows, strict=True)) if self.rows else (np.empty(0, t) for t in (np.int8, np.int64, np.uint32))
        self.rows, self.size = [], 0
        order = np.lexsort((pos, kind, key))
        kind, key, pos = kind[order], key[order], pos[order].astype("<u4")
        at = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))) if len(key) else np.empty(0, np.int64), len(key)).tolist()
        blobs: dict[int, list] = {}
        for s, e in zip(at, at[1:], strict=False):
            blobs.setdefault(int(key[s]), [None] * len(KINDS))[kind[s]] = pos[s:e].tobytes()
        return pa.RecordBatch.from_arrays([pa.array(list(blobs), pa.int64()), *(pa.array([x[k] for x in blobs.values()], pa.binary()) for k in range(len(KINDS)))], schema=_FOUND)


def _blobs(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """The parts of an array between the places in ``at``, as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


class _Dealer:
    """Rows of units, DEALT of them together and without repeats among these, in rows of DEALT_ROWS."""

    def __init__(self, passes: int, buckets: int) -> None:
        self.shift, self.buckets = _U(64 - (passes.bit_length() - 1) - (buckets.bit_length() - 1)), buckets
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.size = self.turn = 0

    def add(self, h: np.ndarray, r: np.ndarray, key: np.ndarray, pos: np.ndarray, near: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        pos = pos.astype(np.uint32)
        self.rows.append((h, r, key, pos) if near is None else (h, r, key, pos, near))
        self.size += len(h)
        if self.size >= DEALT:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        rows = [np.concatenate(c) for c in zip(*self.rows, strict=True)]
        self.rows, self.size = [], 0
        names = ["bucket", *_COLUMNS]
        again = _again(rows[:2], rows[2], rows[3])
        if again.any():
            key, pos = rows[2][again], rows[3][again]
            rows = [x[~again] for x in rows]
            at, none = np.array([0, len(key)]), pa.array([None], pa.binary())
            # Any bucket will do; they take turns.
            self.turn = (self.turn * 31 + int(key[0]) + 17) % self.buckets
            yield pa.RecordBatch.from_arrays([pa.array([self.turn], pa.int32()), none, none, _blobs(key, at), _blobs(pos, at), none], names)
        bucket = ((rows[0] >> self.shift) & _U(self.buckets - 1)).astype(np.uint16 if self.buckets <= 1 << 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order].astype(np.int32)
        at = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        blobs = [_blobs(x[order], at) for x in rows]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]]), *blobs, *[pa.nulls(len(at) - 1, pa.binary())] * (5 - len(blobs))], names)


def _in_pass(number: int, passes: int) -> Callable[[np.ndarray], np.ndarray]:
    bits = passes.bit_length() - 1
    return lambda h: np.flatnonzero(h >> _U(64 - bits) == _U(number)) if bits else np.arange(len(h))


def _samples(number: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cover samples of a pass, by window and rank."""
    within = _in_pass(number, SAMPLE_PASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, dealer = Hasher(), _Dealer(SAMPLE_PASSES, buckets)
        for unit in units(batches):
            hashes = hasher.of(unit.data)
            counts = np.searchsorted(_SAMPLES, [min(p[5], p[3] - WINDOW + 1) - p[4] for p in unit.parts]).tolist()
            at = np.concatenate([_SAMPLES[:n] + (p[4] - p[2] + s) for n, p, s in zip(counts, unit.parts, unit.starts.tolist(), strict=True)])
            h = hashes(0, at, at + WINDOW)
            own = within(h)
            h, at, part = h[own], at[own], np.repeat(np.arange(len(counts)), counts)[own]
            pos = at - unit.starts[part] + unit.offsets[part]
            left, right = np.minimum(pos, MODULUS - 1), np.minimum(unit.lengths[part] - pos, LENGTH)
            r = hashes(1, at - left, at + right) + (left * 128 + right).astype(_U) * _U(_BASES[0])
            near = hashes(1, at - np.minimum(left, HALF), at) >> _U(48) << _U(16)
            near |= hashes(1, at + WINDOW, at + np.minimum(right, WINDOW + HALF)) >> _U(48)
            yield from dealer.add(h, r, unit.keys[part], pos, near.astype(np.uint32))
        yield from dealer.out()

    return run


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals in order, put together where they overlap or touch; empty ones are left out."""
    some = end > start
    order = np.argsort(start[some], kind="stable")
    start, end = start[some][order], end[some][order]
    if not len(start):
        return start, end
    end = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return start[new], end[np.append(new[1:], len(start)) - 1]


def _numbers(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)


def _open_strings(unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Starts, in the unit, of strings through open samples that aren't gone by a sample's rank; and their parts."""
    ranges: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}
    for (_, _, offset, length, own, end, before, after, gone), s in zip(unit.parts, unit.starts.tolist(), strict=True):
        low, high = own - offset + s, min(end, length - LENGTH + 1) - offset + s
        for blobs, first, last, opened in ((before, MODULUS - 1, HALF, True), (after, HALF - 1, 0, True), (gone, MODULUS - 1, 0, False)):
            if blobs:
                q = _numbers(blobs) + (s - offset)
                ranges[opened].append((np.clip(q - first, low, max(low, high)), np.clip(q - last + 1, low, max(low, high))))
    found = []
    for opened in (True, False):
        found.append(_merged(*(np.concatenate(x) for x in zip(*ranges[opened], strict=True))) if ranges[opened] else (np.empty(0, np.int64),) * 2)
    (start, end), (gone_start, gone_end) = found
    sizes = end - start
    at = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    if len(gone_start):
        k = np.searchsorted(gone_start, at, side="right") - 1
        at = at[(k < 0) | (at >= gone_end[k])]
    return at, np.searchsorted(unit.starts, at, side="right") - 1


def _strings(number: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The strings of a pass that go through open samples."""
    within = _in_pass(number, STRING_PASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, dealer = Hasher(), _Dealer(STRING_PASSES, buckets)
        for unit in units(batches, ("before", "after", "gone")):
            at, part = _open_strings(unit)
            hashes = hasher.of(unit.data)
            h = hashes(0, at, at + LENGTH)
            own = within(h)
            h, at, part = h[own], at[own], part[own]
            yield from dealer.add(h, hashes(1, at, at + LENGTH), unit.keys[part], at - unit.starts[part] + unit.offsets[part])
        yield from dealer.out()

    return run


def _shared(h: np.ndarray, also: np.ndarray) -> np.ndarray:
    """Which rows agree with another one in both."""
    order = np.lexsort((also, h))
    same = (h[order][1:] == h[order][:-1]) & (also[order][1:] == also[order][:-1])
    out = np.zeros(len(h), bool)
    out[order] = np.append(same, False) | np.append(False, same)
    return out


def _open_samples(rows: tuple[np.ndarray, ...], found: _Gather) -> None:
    """Of the first samples of their ranks, those that can have equal strings through them."""
    order = np.argsort(rows[0])
    same = rows[0][order][1:] == rows[0][order][:-1]
    some = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    h, _, key, pos, near = (x[some] for x in rows)
    for kind, half in (("before", near >> 16), ("after", near & 0xFFFF)):
        own = _shared(h, half)
        found.add(kind, key[own], pos[own])


def _few_ranks(rows: tuple[np.ndarray, ...], found: _Gather) -> tuple[np.ndarray, ...]:
    """rows with WINDOW_RANKS ranks of each window at most; of a window that has more, all but the first are open on both sides."""
    order = np.argsort(rows[0], kind="stable")
    h = rows[0][order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    sizes = np.diff(np.append(first, len(h)))
    place, size = np.arange(len(h)) - np.repeat(first, sizes), np.repeat(sizes, sizes)
    for kind in ("before", "after"):
        crowded = order[size > WINDOW_RANKS]
        found.add(kind, rows[2][crowded], rows[3][crowded])
    return tuple(x[order][place < WINDOW_RANKS] for x in rows)


def _resolve(samples: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of DEALT_ROWS, sorted by bucket: all but the first of equal rows are gone; of samples, what is open then."""
    kind, columns = ("gone", list(_COLUMNS)) if samples else ("strings", list(_COLUMNS)[:4])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Gather()
        held: list[tuple[np.ndarray, ...]] = []
        bucket, size = None, 0

        def collapse() -> None:
            nonlocal held, size
            rows = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            again = _again(list(rows[:2]), rows[2], rows[3])
            found.add(kind, rows[2][again], rows[3][again])
            rows = tuple(x[~again] for x in rows)
            if samples and len(rows[0]) > RUN // 2:
                rows = _few_ranks(rows, found)
            held, size = [rows], len(rows[0])

        def finish() -> None:
            nonlocal held, size
            if held:
                collapse()
                if samples:
                    _open_samples(held[0], found)
            held, size = [], 0

        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] != bucket:
                    finish()
                    bucket = row["bucket"]
                if row["h"] is None:
                    found.add(kind, *(np.frombuffer(row[c], _COLUMNS[c]) for c in ("key", "pos")))
                else:
                    held.append(tuple(np.frombuffer(row[c], _COLUMNS[c]) for c in columns))
                    size += len(held[-1][0])
                if size >= RUN:
                    collapse()
                if found.full():
                    yield found.out()
        finish()
        yield found.out()

    return run


def _passes(rows: DataFrame, take: Callable, samples: bool, passes: int, buckets: int, label: str) -> list[DataFrame]:
    """What each pass over rows gives, one at a time; its shuffle is freed before the next begins."""
    out = []
    for number in range(passes):
        dealt = rows.mapInArrow(take(number, buckets), DEALT_ROWS)
        out.append(scratch.save(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolve(samples), FOUND), label))
        del dealt
        scratch.free(rows.sparkSession)
    return out


def _buckets(rows: float) -> int:
    """A power of two, for about BUCKET_ROWS rows in each."""
    return max(LEAST_BUCKETS, 1 << max(0, int(rows / BUCKET_ROWS)).bit_length())


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _chosen(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs whose key is among keys (left_semi), or isn't (left_anti)."""
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", how)


def _joined(docs: DataFrame, found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """docs with the positions of their keys: of each kind an array of blobs."""
    by_key = found.groupBy("key").agg(*(F.collect_list(k).alias(k) for k in kinds))
    return docs.join(by_key, "key")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key: the order of the rows. It's the id itself where ids are a key."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    counts = given.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if counts.isEmpty():
        return given.withColumn("key", F.col("doc_id"))
    # Sorted by ranges; the numbers of a sorted table's rows rise with its partitions.
    return scratch.save(given.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text")).withColumn("key", F.monotonically_increasing_id()), "ordered")


def removed(given: DataFrame) -> DataFrame:
    """Rows of FOUND: the samples (gone) and strings through or from which bytes go; given has key and text, without nulls."""
    given = given.select("key", "text")
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    ranks = _passes(given, _samples, True, SAMPLE_PASSES, _buckets(size * len(COVER) / MODULUS / SAMPLE_PASSES), "ranks")
    found = _together(ranks)
    opened = scratch.save(found.where("before is not null or after is not null").select("key").distinct(), "open-keys")
    docs = scratch.save(_joined(_chosen(given, opened, "left_semi"), found, ("before", "after", "gone")), "open")
    scratch.drop(opened)
    scratch.free(given.sparkSession)
    strings = _passes(docs, _strings, False, STRING_PASSES, _buckets(size / 10 / STRING_PASSES), "strings")
    scratch.drop(docs)
    return _together([*ranks, *strings]).where("gone is not null or strings is not null").select("key", "gone", "strings")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        out = []
        for doc_id, data, gone, strings in zip(b["doc_id"].to_pylist(), _bytes(b["text"]), b["gone"].to_pylist(), b["strings"].to_pylist(), strict=True):
            n, kept, done, removed = len(data), hashlib.sha256(), 0, 0
            starts: list[int] = []
            if gone or strings:
                q, i = _numbers(gone), _numbers(strings)
                start, end = np.append(np.maximum(0, q - MODULUS + 1), i), np.append(np.minimum(q + LENGTH, n), i + LENGTH)
                # A sample near both ends of a short text has no string through it.
                whole = end - start >= LENGTH
                start, end = _merged(start[whole], end[whole])
                starts, removed = start.tolist(), int((end - start).sum())
                for s, e in zip(starts, end.tolist(), strict=True):
                    kept.update(data[done:s])
                    done = e
            kept.update(data[done:])
            out.append((doc_id, n, removed, len(starts), kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: a row for each row of docs."""
    given = keyed(docs)
    found = removed(given)
    keys = scratch.save(found.select("key").distinct(), "cut-keys")
    cut = _joined(_chosen(given, keys, "left_semi"), found, ("gone", "strings"))
    none = F.array().cast("array<binary>")
    whole = _chosen(given, keys, "left_anti").select("*", none.alias("gone"), none.alias("strings"))
    columns = ("doc_id", "text", "gone", "strings")
    return cut.select(*columns).unionByName(whole.select(*columns)).mapInArrow(_finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
