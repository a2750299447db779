"""Personal data: pattern spans, and terms that disclose the protected entities.

A pattern pass finds e-mail addresses, IPv4 addresses, payment cards and phone numbers. What is
protected is each value found, and what it generalises to: its group (an address's domain, a network
of 16 bits, a card's issuer, the first four digits of a phone number) and its kind. These are the
entities c. A term t (a word of four or more letters or digits, outside the spans) of the same
document discloses c if little information about c is left once t is known, and t is what tells it:

    -log2 p(c | t) <= ``max_residual_bits``       PMI(c; t) = log2 p(c | t) / p(c) >= ``min_pmi_bits``

with p(c | t) = (n(c, t) + n(c) / n) / (n(t) + 1), shares of documents of the whole corpus shrunk
towards p(c) = n(c) / n by one document's weight. Both the entity and the pair need ``min_texts``
different texts, so that a word seen once beside an address, or in copies of one text, proves nothing.
Such terms become spans of kind ``term`` in the documents that hold c, and sanitising replaces them as
it does the entities; documents without personal data stay as they are.

Counting: terms are counted by task first, over all documents, in the same way for n(t) and n(c, t).
A term in more than 2 ** max_residual_bits times as many documents as c, or as documents with any
entity hold it, can't disclose c, so only pairs below that are counted, and a document's terms are dealt in ``PARTS`` parts before they meet its
entities. A kind that a third of all rows hold is summed by task, and by text, before it is dealt.

Edge cases: null or empty text has no spans; a null doc_id is kept as null; texts of any length are
read whole; of spans that overlap the one that starts first is replaced; a term exactly at a threshold
discloses; repeated rows each get their own row (and count as one text); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import scratch
from inkwell.llm.batches import slices, texts

KINDS = ("email", "ip", "card", "phone")
DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{4,}")

MIN_TEXTS = 3
#: One bit: with the term known, the entity is as likely there as not.
MAX_RESIDUAL_BITS = 1.0
MIN_PMI_BITS = 1.0
PARTS = 8
#: Terms that a task counts before it hands the counts on.
FLUSH = 200_000
#: Candidate terms, or pairs, that may be sent to every task; beyond, they are joined.
CANDIDATES = 300_000

#: What a sanitised text holds in place of a span.
GENERALISED = {"email": "[email]", "ip": "[ip]", "card": "[card]", "phone": "[phone]", "term": "[term]"}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, in time linear in the text: each is found from its @."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; offsets are code points."""
    out = [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def entity(kind: str, value: str) -> bytes:
    """A protected value as a key: case and separators don't matter."""
    value = value.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", value)
    return hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=16).digest()


def entities(kind: str, value: str) -> list[bytes]:
    """What a value found gives away: itself, its group and its kind."""
    digits = re.sub("[^0-9]", "", value)
    group = {"email": value.rpartition("@")[2].lower(), "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]
    return [entity(kind, value), *(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in (f"group:{kind}:{group}", f"kind:{kind}"))]


def words(text: str) -> set[str]:
    """The distinct terms outside personal data."""
    spans = base_spans(text)
    return {t for t, _, _ in terms(text, spans)} if spans else {w.lower() for w in set(TERM.findall(text))}


def terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(word, start, end) outside the spans."""
    covered = sorted((s, e) for _, s, e in spans)
    out, k, reach = [], 0, 0
    for m in TERM.finditer(text):
        while k < len(covered) and covered[k][0] < m.end():
            reach = max(reach, covered[k][1])
            k += 1
        if m.start() >= reach:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


PASS = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, text_key binary, entities array<binary>, terms array<string>, starts array<int>, ends array<int>"
ARROW = pa.schema([
    ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_spans", pa.string()), ("text_key", pa.binary()),
    ("entities", pa.list_(pa.binary())), ("terms", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; words and entities only where there are entities."""
    for b in slices(batches):
        out: dict[str, list] = {f.name: [] for f in ARROW}
        for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
            spans = base_spans(text)
            out["doc_id"].append(doc_id)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in spans))
            out["base_spans"].append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
            found = terms(text, spans) if spans else None
            out["text_key"].append(hashlib.blake2b(text.encode(), digest_size=16).digest() if spans else None)
            out["entities"].append(list({x for k, s, e in spans for x in entities(k, text[s:e])}) if spans else None)
            for name, i in (("terms", 0), ("starts", 1), ("ends", 2)):
                out[name].append([t[i] for t in found] if spans else None)
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in ARROW], schema=ARROW)


def _counts(wanted: Broadcast | None):
    """In how many documents of a task each word is; with wanted, of those words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in slices(batches):
            for text in texts(b["text"]):
                found = words(text)
                seen.update(found if wanted is None else found & wanted.value)
            if len(seen) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    return run


def document_counts(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(term, n_t): documents of the whole corpus that hold each candidate term.

    Up to CANDIDATES terms are sent to the tasks, which then hand on counts of those only. With more,
    every word is counted and the counts are joined; the result is the same.
    """
    spark = docs.sparkSession
    few = candidates.count() <= CANDIDATES
    wanted = spark.sparkContext.broadcast(frozenset(r["term"] for r in candidates.collect())) if few else None
    counted = docs.select("text").mapInArrow(_counts(wanted), "term string, n bigint")
    if not few:
        counted = counted.join(candidates, "term", "left_semi")
    return counted.groupBy("term").agg(F.sum("n").alias("n_t"))


def _small(df: DataFrame) -> DataFrame:
    """df for a join with something large: sent to every task up to CANDIDATES rows."""
    return F.broadcast(df) if df.count() <= CANDIDATES else df


def disclosing(docs: DataFrame, rows: DataFrame, min_texts: int, max_residual_bits: float, min_pmi_bits: float) -> DataFrame:
    """(entity, term, n_c, n_t, n_ct, p): the pairs of which the term discloses the entity; rows has _scan()'s columns and rid."""
    held = rows.where("entities is not null").select("rid", "text_key", F.explode("entities").alias("entity"))
    by_text = held.groupBy("entity", "text_key").agg(F.count("*").alias("n"))
    known = scratch.save(by_text.groupBy("entity").agg(F.sum("n").alias("n_c"), F.count("*").alias("texts")).where(F.col("texts") >= min_texts).select("entity", "n_c"), "pii-entities")
    used = rows.where("entities is not null").select("rid", "text_key", F.explode(F.array_distinct("terms")).alias("term"))
    candidates = used.groupBy("term", "text_key").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= min_texts).select("term", "n_e")
    candidates = scratch.save(candidates, "pii-candidates")
    reach = 2.0**max_residual_bits
    total = rows.count()
    most = known.agg(F.coalesce(F.max("n_c"), F.lit(0))).collect()[0][0]
    # n(c, t) is at most n_e, the documents with any entity that hold t: that leaves few terms which can disclose anything.
    counts = document_counts(docs, candidates.select("term")).join(candidates, "term")
    counts = scratch.save(counts.where((F.col("n_t") <= reach * most) & (F.col("n_t") + 1 <= reach * (F.col("n_e") + 1))).select("term", "n_t"), "pii-counts")
    # What a document's terms can disclose meets them in PARTS parts.
    of_row = held.join(_small(known), "entity").groupBy("rid").agg(F.collect_list(F.struct("entity", "n_c")).alias("of_row"))
    of_row = of_row.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    near = used.join(_small(counts), "term").withColumn("part", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).join(of_row, ["rid", "part"])
    near = near.select("text_key", "term", "n_t", F.explode(F.filter("of_row", lambda x: F.col("n_t") <= reach * x["n_c"])).alias("x")).select("text_key", "term", "n_t", "x.*")
    per_text = near.groupBy("entity", "n_c", "term", "n_t", "text_key").agg(F.count("*").alias("n"))
    pairs = per_text.groupBy("entity", "n_c", "term", "n_t").agg(F.sum("n").alias("n_ct"), F.count("*").alias("texts")).where(F.col("texts") >= min_texts).drop("texts")
    prior = F.col("n_c") / F.lit(float(max(1, total)))
    pairs = pairs.withColumn("p", (F.col("n_ct") + prior) / (F.col("n_t") + 1))
    out = scratch.save(pairs.where((-F.log2("p") <= max_residual_bits) & (F.log2(F.col("p") / prior) >= min_pmi_bits)), "pii-telling")
    scratch.drop(known, candidates, counts)
    return out


def find(docs: DataFrame, min_texts: int = MIN_TEXTS, max_residual_bits: float = MAX_RESIDUAL_BITS, min_pmi_bits: float = MIN_PMI_BITS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, term_spans (strings), a row for each row of docs.

    The pass that finds entities is written to the shared folder; a second pass counts the words that
    matter there.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scan, PASS)
    rows = scratch.save(rows.withColumn("rid", F.monotonically_increasing_id()), "pii")
    telling = disclosing(docs, rows, min_texts, max_residual_bits, min_pmi_bits).select("entity", "term")
    used = rows.where("entities is not null").select("rid", "entities", F.explode(F.arrays_zip("terms", "starts", "ends")).alias("t"))
    used = used.select("rid", "entities", F.col("t.terms").alias("term"), F.col("t.starts").alias("s"), F.col("t.ends").alias("e"))
    by_term = telling.groupBy("term").agg(F.collect_set("entity").alias("disclosed"))
    marks = used.join(_small(by_term), "term").where(F.arrays_overlap("entities", "disclosed")).select("rid", "s", "e")
    marks = marks.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("m"))
    marks = marks.select("rid", F.array_join(F.transform("m", lambda m: F.concat(F.lit("term:"), m["s"].cast("string"), F.lit(":"), m["e"].cast("string"))), ",").alias("term_spans"))
    out = rows.select("rid", "doc_id", *(f"n_{k}" for k in KINDS), "base_spans").join(marks, "rid", "left")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base_spans", F.coalesce("term_spans", F.lit("")).alias("term_spans"))


def replace(text: str | None, spans: str | None) -> str | None:
    """text with each span (kind:start:end, comma-joined) put in general terms; the first of overlapping ones counts."""
    if not text or not spans:
        return text
    out, at = [], 0
    for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(","))):
        if start >= at:
            out += [text[at:start], GENERALISED[kind]]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, **parameters) -> DataFrame:
    """docs with entities and disclosing terms of ``text`` replaced. doc_id has to be a key here; rows without one lose base spans only."""
    found = find(docs, **parameters).where("doc_id is not null and base_spans != ''")
    spans = found.select("doc_id", F.concat_ws(",", "base_spans", F.when(F.col("term_spans") != "", F.col("term_spans"))).alias("_spans")).distinct()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            given = [s if s is not None else ",".join(f"{k}:{x}:{y}" for k, x, y in base_spans(t or "")) for t, s in zip(b["text"].to_pylist(), b["_spans"].to_pylist(), strict=True)]
            new = pa.array([replace(t, s) for t, s in zip(b["text"].to_pylist(), given, strict=True)], pa.string())
            names = [n for n in b.schema.names if n != "_spans"]
            yield pa.RecordBatch.from_arrays([new if n == "text" else b[n] for n in names], names)

    return docs.join(spans, "doc_id", "left").select(*docs.columns, "_spans").mapInArrow(put, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the digest columns of find() over all documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    spans = F.concat_ws(",", F.when(F.col("base_spans") != "", F.col("base_spans")), F.when(F.col("term_spans") != "", F.col("term_spans")))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), spans.alias("spans"))
