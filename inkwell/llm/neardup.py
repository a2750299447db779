"""Near-duplicates: MinHash signatures in several indexes, links confirmed on full shingle sets.

A text's set of 5-word shingles gives ``POSITIONS`` MinHash values of 16 bits. Two sets of
similarity 0.85 differ in 15 of 100 positions on average. The first ``INDEXED`` positions are
indexed: they are split into chunks, and by the pigeonhole principle two signatures that differ in
at most d of them have a chunk that differs in at most d // chunks = 1 (distance() has d: 21 for
0.85, and 11 chunks). That one error is enumerated: an entry of an index is a chunk with one
position left out, so a text has INDEXED entries and every pair within d shares one. What is found
is exact, but signatures are samples, and links are lost by them: by the binomial law, of pairs at
exactly 0.85 about 10 in 100,000 differ in more indexed positions than that; at 0.86 it's 3, at 0.88
fewer than 1. (A closer look at all positions is 6 deviations wide and loses fewer than 1 in ten
million.)

Copies (equal sets) are one node. Of the nodes that share an entry, those whose signatures are near
are linked, with one link at most for each node and entry; entries that more than BUCKET nodes share
link each of them to the smallest without a look. That gives coarse groups which hold every pair
that the index finds, without listing pairs. A group is dealt in blocks of bounded size, of which the first has the nodes that share most entries:
its centres. First each block meets the centres, and its own nodes meet each other: in a group of
copies of one text that links nearly all. Then the nodes that aren't connected with most of their
group meet all of it, in wider blocks, which leaves no pair out. Pairs are compared
by signature, then by full set unless they are connected already; a task hands on at most one link
for each node, and components come from those links. So neither a key, nor a group, nor its pairs
end up in one task, and nothing is capped. A group of g nodes of which r aren't connected with most
costs 2 * g + g * r / 128 rows.

Edge cases: null or empty text has no shingles and is linked with nothing; with fewer words than a
shingle the whole sequence is one. Very long texts are hashed whole, in parts. A pair at exactly the
threshold is linked; of equal candidates the smallest id is kept. A row without doc_id is linked with
nothing, its component_id is null and it is kept. Of repeated rows each gets a row; rows that share a
doc_id are one node, and keep() keeps one of them. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import scratch
from inkwell.llm.batches import slices, texts
from inkwell.llm.graph import components
from inkwell.llm.shingles import Shingler

POSITIONS = 128
INDEXED = 64
PERCENT = 85
#: Standard deviations of the number of differing positions that a linked pair may be off its mean.
DEVIATIONS, WIDE = 4.2, 6.0
BLOCK_NODES = 32
BLOCK_BYTES = 1 << 20
#: Nodes of an entry up to which their signatures are compared.
BUCKET = 256
#: Blocks of nodes that the centres don't connect.
WIDE_NODES, WIDE_BYTES = 256, 8 << 20
#: Parts of a group that are searched for its centres on their own.
PARTS = 64
#: Ids that may be sent to every task to pick out the texts of coarse groups; beyond, they are joined.
BROADCAST_IDS = 2_000_000
SEED = 77_003


def distance(percent: int, positions: int, deviations: float = DEVIATIONS) -> int:
    """Differing positions of a pair at the threshold: the mean and some deviations."""
    q = 1 - percent / 100
    return int(positions * q + deviations * (positions * q * (1 - q)) ** 0.5)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, POSITIONS, np.uint64).astype(np.uint32), rng.integers(0, 1 << 32, POSITIONS, np.uint64).astype(np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray, x: np.ndarray, a: np.ndarray) -> bytes:
    """POSITIONS values of 16 bits, from the smallest hash of the set under each permutation."""
    small = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 4096):
        v = h[None, i : i + 4096] ^ x[:, None]
        v *= a[:, None]
        v ^= v >> np.uint32(15)
        np.minimum(small, (v * np.uint32(0x2C1B3C6D)).min(1), out=small)
    small *= np.uint32(0x9E3779B1)
    return (small >> np.uint32(16)).astype("<u2").tobytes()


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature (null without words), a row for each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (x, a) = Shingler(), _permutations()
        for b in slices(batches):
            sets = [shingler(t) for t in texts(b["text"])]
            columns = [b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s, x, a) if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, sig binary")


def entries(percent: int = PERCENT) -> Column:
    """The index entries of a signature: for each indexed position, its chunk without that position."""
    chunks = distance(percent, INDEXED) // 2 + 1
    ends = [INDEXED * (i + 1) // chunks for i in range(chunks)]
    out, start = [], 0
    for end in ends:
        for p in range(start, end):
            rest = F.concat(F.substring("sig", 2 * start + 1, 2 * (p - start)), F.substring("sig", 2 * p + 3, 2 * (end - p - 1)))
            out.append(F.xxhash64(F.lit(p), rest))
        start = end
    return F.explode(F.array(*out))


def _near(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of the nodes of each entry (rows sorted by key) whose signatures are near: one at most for each node."""
    most = distance(percent, POSITIONS, WIDE)

    def near(nids: list[int], sigs: list[bytes]) -> Iterator[tuple[int, int]]:
        values = np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), POSITIONS)
        label = np.arange(len(nids))
        for x in range(len(nids) - 1):
            for y in np.flatnonzero((values[x + 1 :] != values[x]).sum(1) <= most) + x + 1:
                if label[x] != label[y]:
                    label[label == label[y]] = label[x]
                    yield nids[x], nids[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nids, sigs, found = None, [], [], set()
        for b in batches:
            for k, n, sig in zip(b["key"].to_pylist(), b["nid"].to_pylist(), b["sig"].to_pylist(), strict=True):
                if k != key:
                    found.update(near(nids, sigs) if len(nids) > 1 else ())
                    key, nids, sigs = k, [], []
                nids.append(n)
                sigs.append(sig)
            pairs = list(found)
            found.clear()
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["u", "v"])
        found.update(near(nids, sigs) if nids else ())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    return run


#: Rows of a task, sorted by (comp, i, j): a node, what it is connected with, and its side.
SIDES = ("comp", "i", "j", "nid", "label", "side", "sig", "set")


def _links(percent: int, across: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between the two sides of each (comp, i, j), and unless ``across`` within side 1: one at most for each node."""
    most = distance(percent, POSITIONS, WIDE)

    def linked(s: np.ndarray, t: np.ndarray) -> bool:
        both = np.concatenate([s, t])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (len(s) + len(t) - common)

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        nids = [r[0] for r in rows]
        sigs = np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(len(rows), POSITIONS)
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        side = np.array([r[2] for r in rows])
        first: dict[int, int] = {}
        parent = [first.setdefault(r[1], i) for i, r in enumerate(rows)]

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x in range(len(rows) - 1):
            rest = slice(x + 1, None)
            near = (side[rest] != side[x]) if across else (side[rest] + side[x] > 0)
            near &= 100 * np.minimum(sizes[rest], sizes[x]) >= percent * np.maximum(sizes[rest], sizes[x])
            near &= (sigs[rest] != sigs[x]).sum(1) <= most
            for y in (np.flatnonzero(near) + x + 1).tolist():
                if (a := root(x)) != (b := root(y)) and linked(sets[x], sets[y]):
                    parent[b] = a
                    out.append((nids[x], nids[y]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for b in batches:
            for r in zip(*(b[n].to_pylist() for n in SIDES), strict=True):
                if r[:3] != key:
                    if len(rows) > 1:
                        found += compare(rows)
                    key, rows = r[:3], []
                rows.append(r[3:])
        if len(rows) > 1:
            found += compare(rows)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["u", "v"])

    return run


def _met(rows: DataFrame, percent: int, across: bool) -> DataFrame:
    dealt = rows.select(*SIDES).repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return dealt.mapInArrow(_links(percent, across), "u bigint, v bigint")


def _blocks(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(8 * shingles / BLOCK_BYTES)).cast("int")


def _wide(n: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(n / WIDE_NODES), F.ceil(8 * shingles / WIDE_BYTES)).cast("int")


def _block_of(nid: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(nid), F.col(blocks)).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _small(groups: DataFrame) -> DataFrame:
    """A row for each group, for a join with the groups' nodes: sent to every task up to BROADCAST_IDS of them, as one group may have most nodes."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups


def _apart(large: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the nodes of large groups (nid, comp, n): their labels and their group's largest part (label, main), those outside it, and the labels as links."""
    labels = components(links)
    told = large.join(labels.select(F.col("u").alias("nid"), "label"), "nid", "left").select("nid", "comp", "n", F.coalesce("label", "nid").alias("label"))
    told = scratch.save(told, "parts")
    most = told.groupBy("comp", "label").agg(F.count("*").alias("size")).groupBy("comp").agg(F.max(F.struct("size", "label"))["label"].alias("main"), F.count("*").alias("parts")).where("parts > 1")
    told = told.join(_small(most.select("comp", "main")), "comp")
    return told, told.where("label != main"), labels.select("u", F.col("label").alias("v"))


def group_links(members: DataFrame, percent: int) -> DataFrame:
    """(u, v): links, or labels in their place, that connect what is linked within each group.

    members has nid, comp, block (0: the group's centres), blocks, n, sig and set.
    """
    zero = F.lit(0)
    to = F.when(F.col("block") == 0, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array("block"))
    first = members.withColumn("j", F.explode(to)).select("*", zero.alias("i"), F.col("nid").alias("label"), (F.col("j") == F.col("block")).cast("int").alias("side"))
    links = scratch.save(_met(first, percent, False), "links")
    # Groups of several blocks that aren't connected yet: what isn't in their largest part meets all their blocks.
    large = members.where("blocks > 1").select("nid", "comp", "n")
    if large.isEmpty():
        return links
    told, rest, links = _apart(large, links)
    wide = told.groupBy("comp").agg(_wide(F.count("*"), F.sum("n")).alias("wide"))
    rows = rest.groupBy("comp").agg(_wide(F.count("*"), F.sum("n")).alias("rows")).join(wide, "comp")
    if rows.isEmpty():
        return links
    rows = _small(rows)
    rest = rest.join(rows, "comp").select("nid", _block_of("nid", "rows").alias("i"), "wide")
    all_of = members.select("nid", "comp", "sig", "set").join(told.select("nid", "label"), "nid")
    right = all_of.join(rows, "comp").withColumn("i", _each("rows")).select("*", _block_of("nid", "wide").alias("j"), F.lit(1).alias("side"))
    left = all_of.join(rest, "nid").withColumn("j", _each("wide")).select("*", zero.alias("side"))
    return links.unionByName(scratch.save(_met(left.select(*SIDES).unionByName(right.select(*SIDES)), percent, True), "links"))


def centres(nodes: DataFrame) -> DataFrame:
    """(nid): of each group (comp) the BLOCK_NODES nodes of the highest score, nid among equals; of parts of it first, so that no group meets in one task."""
    best = F.row_number().over(Window.partitionBy("comp", F.pmod(F.xxhash64("nid"), F.lit(PARTS))).orderBy(F.desc("score"), "nid"))
    some = nodes.select("comp", "nid", "score", best.alias("k")).where(F.col("k") <= BLOCK_NODES)
    best = F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("score"), "nid"))
    return some.select("nid", best.alias("k")).where(F.col("k") <= BLOCK_NODES).select("nid")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, nid, digest, ...) with the full set of the text it names."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in slices(batches):
            sets = [shingler(t) for t in texts(b["text"])]
            same = [digest(s) == d for s, d in zip(sets, b["digest"].to_pylist(), strict=True)]
            kept = [(n, s.tobytes()) for n, s, ok in zip(b["nid"].to_pylist(), sets, same, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in kept], pa.int64()), pa.array([s for _, s in kept], pa.binary())], ["nid", "set"])

    return found.select("nid", "digest", "text").mapInArrow(run, "nid bigint, set binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs."""
    rows = scratch.save(signatures(docs), "signatures")
    held = rows.where("doc_id is not null and digest is not null")
    nodes = held.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    nodes = scratch.save(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    index = nodes.select("nid", entries(percent).alias("key"))
    shared = index.groupBy("key").agg(F.min("nid").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = scratch.save(index.join(shared, "key"), "met")
    few = met.where(F.col("n") <= BUCKET).select("key", "nid").join(nodes.select("nid", "sig"), "nid")
    near = few.repartition("key").sortWithinPartitions("key", "nid").mapInArrow(_near(percent), "u bigint, v bigint")
    stars = met.where((F.col("n") > BUCKET) & (F.col("nid") != F.col("first"))).select(F.col("nid").alias("u"), F.col("first").alias("v")).unionByName(near)
    # Rows that share a doc_id are one document.
    ids = held.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("doc_id")
    coarse = scratch.save(components(stars), "coarse")
    size = coarse.join(nodes.select(F.col("nid").alias("u"), "n"), "u").groupBy("label").agg(_blocks(F.count("*"), F.sum("n")).alias("blocks"))
    grouped = coarse.join(size, "label").select(F.col("u").alias("nid"), F.col("label").alias("comp"), "blocks")
    score = met.groupBy("nid").agg(F.sum("n").alias("score"))
    large = scratch.save(centres(grouped.where("blocks > 1").join(score, "nid").select("nid", "comp", "score")), "centres")
    grouped = scratch.save(grouped.join(nodes, "nid").join(large.withColumn("central", F.lit(True)), "nid", "left"), "grouped")
    sets = _full_sets(docs, grouped.select("doc_id", "nid", "digest"))
    # Centres are block 0; the others are dealt to the rest.
    block = F.when(F.col("central") | (F.col("blocks") == 1), 0).otherwise(1 + F.pmod(F.xxhash64("nid"), F.greatest(F.col("blocks") - 1, F.lit(1))).cast("int"))
    members = scratch.save(grouped.select("nid", "comp", "blocks", "n", "sig", F.coalesce(block, F.lit(0)).alias("block")).join(sets, "nid"), "members")
    scratch.drop(met, large)
    links = group_links(members, percent)
    same = held.join(ids, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(nodes.select("digest", "nid"), "digest")
    same = same.join(same.groupBy("doc_id").agg(F.min("nid").alias("v")), "doc_id").where("nid != v").select(F.col("nid").alias("u"), "v")
    found = components(links.unionByName(same))
    scratch.drop(coarse, grouped, members)
    label = nodes.select("nid", "digest", "doc_id").join(found.withColumnRenamed("u", "nid"), "nid", "left").select("digest", "doc_id", F.coalesce("label", "nid").alias("label"))
    least = label.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    label = label.join(least, "label").select("digest", "component_id")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(label, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, and with the columns of docs."""
    drop = scratch.save(near_duplicates(docs, percent).where("not kept").select("doc_id").distinct(), "drop")
    kept = docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_IDS else drop, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    # Only rows that share a doc_id are dealt by it.
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
