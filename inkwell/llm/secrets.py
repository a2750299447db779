"""Secret scans: pattern spans, and how widely each secret is copied. DataFrame functions only.

Three patterns give the base spans: assignments to password-like names, access keys, and long hex
strings. Long mixed tokens elsewhere are further candidates. Every candidate's value is hashed and
the hashes are counted over the whole corpus, by distinct repositories and owners. A value that at
least ``COPIED_OWNERS`` owners and as many repositories hold is an example that people copy; a value
that fewer hold looks live. Candidates that look live become spans of kind ``token``; base spans
stay whatever they look like, and n_live and n_copied count them by kind.

Offsets come from the text split by a pattern and the pattern's matches: a match starts where the
pieces and matches before it end. Texts are looked at closely only behind cheap substring tests.

Counting a value first by (value, repository, owner) and then by value keeps a value that a third
of all rows hold from meeting in one task. What is known of the values is then sent to every task up
to BROADCAST_ROWS of them (counted first); beyond, each value's rows are dealt in SALTS parts.

Edge cases: null or empty text has no spans; a null owner or repository counts as one owner or
repository of its own; a null doc_id is kept as null; repeated rows each get a row (and count as one
owner); texts of any length are read whole; of spans that start together the kind listed first comes
first, and a value at exactly ``copied_owners`` counts as copied; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import scratch
from inkwell.llm.exprs import let

KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9_-]+"
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_TOKEN = 6, 20, 24, 20
#: Letters and digits that a further candidate needs each.
MIN_MIXED = 4
COPIED_OWNERS = 3
#: Flagged documents, or values, that may be sent to every task; beyond, they are joined.
BROADCAST_ROWS = 2_000_000
SALTS = 16
MASK = "[secret]"


def _matches(pattern: str, kind: str, value_group: int, least: int, matched: str | None = None) -> Column:
    """Spans (s, e, k, v) of a pattern's leftmost matches whose value has ``least`` characters.

    ``matched`` is a pattern of the same matches that are long enough, where failing matches can't
    hide others; it saves splitting at every short match.
    """
    pattern = matched or pattern
    text = F.col("text")
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("m"), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(value_group + 1)).alias("v"))
    k = F.lit(KINDS.index(kind))
    none = F.array().cast("array<struct<s:int,e:int,k:int,v:string>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        keep = F.coalesce(F.length(x["v"]) >= least, F.lit(False))
        out = F.when(keep, F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), k.alias("k"), x["v"].alias("v"))))).otherwise(acc["out"])
        return F.struct(e.alias("at"), out.alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _where(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast("array<struct<s:int,e:int,k:int,v:string>>"))


def spans_of_text() -> Column:
    """For a row with ``text``, base and further: arrays of spans (s, e, k, v)."""
    low = F.lower("text")
    named = F.col("text").contains("=") | F.col("text").contains(":")
    test = low.contains(NAMES[0])
    for name in NAMES[1:]:
        test = test | low.contains(name)
    assign = _where(named & test, _matches(ASSIGN, "assign", 2, MIN_VALUE))
    access = _where(F.col("text").contains("AKIA"), _matches(ACCESS, "access", 0, MIN_ACCESS, rf"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}"))
    hexes = _where(F.col("text").rlike(f"[0-9a-f]{{{MIN_HEX}}}"), _matches(HEX, "hex", 0, MIN_HEX, rf"(?<![0-9a-f])[0-9a-f]{{{MIN_HEX},}}"))
    mixed = F.col("text").rlike(rf"[A-Za-z0-9_-]{{{MIN_TOKEN}}}")
    tokens = _where(mixed, _matches(TOKEN, "token", 0, MIN_TOKEN, rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{{MIN_TOKEN},}}"))
    def mixed_enough(x: Column) -> Column:
        return (F.length(F.regexp_replace(x["v"], "[^0-9]", "")) >= MIN_MIXED) & (F.length(F.regexp_replace(x["v"], "[^A-Za-z]", "")) >= MIN_MIXED)

    def both(base: Column) -> Column:
        further = F.filter(tokens, lambda x: mixed_enough(x) & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        return F.struct(base.alias("base"), further.alias("further"))

    return let(F.array_sort(F.concat(assign, access, hexes)), both)


def with_known(held: DataFrame, known: DataFrame) -> DataFrame:
    """held with the columns of known, by value v; held has rid."""
    if known.count() <= BROADCAST_ROWS:
        return held.join(F.broadcast(known), "v")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return held.withColumn("salt", F.pmod(F.col("rid"), F.lit(SALTS)).cast("int")).join(known, ["v", "salt"]).drop("salt")


def find(docs: DataFrame, repository: str | Column = "source", owner: str | Column = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """doc_id, text_key, base and spans (arrays of s, e, k), n_live, n_copied: a row for each row of docs.

    base has the pattern spans. spans has these and further candidates that look live, each with
    ``live``.
    """
    repository, owner = (F.col(c) if isinstance(c, str) else c for c in (repository, owner))
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))

    def hashed(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), F.unhex(F.md5(x["v"])).alias("v")))

    spans = let(spans_of_text(), lambda x: F.struct(hashed(x["base"]).alias("base"), hashed(x["further"]).alias("further")))
    scanned = given.select("doc_id", "repository", "owner", F.xxhash64("text").alias("text_key"), spans.alias("x"), F.monotonically_increasing_id().alias("rid"))
    scanned = scratch.save(scanned, "secrets").select("doc_id", "repository", "owner", "text_key", "x.*", "rid")
    held = scanned.where("size(base) + size(further) > 0").select("rid", "repository", "owner", F.explode(F.concat("base", "further")).alias("x"))
    held = held.select("rid", "repository", "owner", "x.*")
    seen = held.groupBy("v", "repository", "owner").agg(F.count("*").alias("n"))
    seen = seen.groupBy("v").agg(F.count_distinct(F.coalesce("repository", F.lit("\x00"))).alias("repositories"), F.count_distinct(F.coalesce("owner", F.lit("\x00"))).alias("owners"))
    copied = seen.select("v", ((F.col("owners") >= copied_owners) & (F.col("repositories") >= copied_owners)).alias("copied"))
    told = with_known(held, scratch.save(copied, "values")).where((F.col("k") < 3) | ~F.col("copied"))
    told = told.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("s", "k", "e", (~F.col("copied")).alias("live")))).alias("spans"),
        F.sum((~F.col("copied")).cast("bigint")).alias("n_live"),
        F.sum(F.col("copied").cast("bigint")).alias("n_copied"),
    )
    none = F.array().cast("array<struct<s:int,k:int,e:int,live:boolean>>")
    out = scanned.select("rid", "doc_id", "text_key", F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))).alias("base")).join(told, "rid", "left")
    return out.select("doc_id", "text_key", "base", F.coalesce("spans", none).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("bigint").alias("n_copied"))


def written(spans: str) -> Column:
    """Spans as kind:start:end by start, then kind as listed, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, **parameters) -> DataFrame:
    """docs with every secret that looks live replaced in ``text`` (and ``n_chars`` brought up to date, if there is one)."""
    held = "_spans"
    while held in docs.columns:
        held += "_"
    live = find(docs, **parameters).where("n_live > 0").select("doc_id", "text_key", F.filter("spans", lambda x: x["live"]).alias(held)).dropDuplicates(["doc_id", "text_key"])
    live = scratch.save(live, "live")
    if live.count() <= BROADCAST_ROWS:
        live = F.broadcast(live)
    same = (F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("l.doc_id"))) & (F.xxhash64("d.text") == F.col("l.text_key"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], F.substr("text", acc["at"] + 1, x["s"] - acc["at"]), F.lit(MASK))
        return F.struct(F.when(x["s"] >= acc["at"], new).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    clean = F.aggregate(held, start, step, lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text"))))
    joined = docs.alias("d").join(live.alias("l"), same, "left").select("d.*", f"l.{held}")
    joined = joined.withColumn("text", F.when(F.col(held).isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(held).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)


def repository() -> Column:
    """What a source holds in one language; null only if both are."""
    return F.when(F.col("source").isNotNull() | F.col("lang").isNotNull(), F.concat_ws("/", "source", "lang"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents; owners are their sources, repositories what a source holds in one language."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"), repository(), "source")
    kinds = F.transform("base", lambda x: x["k"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), "n_live", "n_copied")
