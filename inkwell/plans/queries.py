"""Queries over the tables, one for each operator family, and the same as SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions import text as T
from inkwell.operators import bills, classify, contacts, evaluate, fuse, healing, layout, lines, lookup, model, names, offline, pages, parse, refine, semantic, universal
from inkwell.plans import corpora
from inkwell.session import table
from inkwell.sources import records, synthesis
from inkwell.streaming import jobs


def _csv(c):
    return F.array_join(c, ",")


def contact_fields(spark: SparkSession, d: str) -> DataFrame:
    found = contacts.contact_fields(corpora.cards(spark, d).select("id", "text"))
    return found.select("id", *(_csv(c).alias(c) for c in ("phones", "emails", "websites", "gstins", "pincodes")), _csv(F.transform("labelled_phones", lambda x: F.concat_ws(":", x["number"], x["label"]))).alias("labelled"))


CARDS = """
WITH k AS (SELECT s_suppkey AS id, '9' || lpad(CAST(s_suppkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS mobile, '2' || lpad(CAST(s_suppkey * 104729 % 10000000 AS VARCHAR), 7, '0') AS land,
lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS num, '411' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS pin, '27AAPFU' || lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') || 'F1ZV' AS code FROM supplier)
"""
CONTACT_FIELDS = (
    CARDS
    + """SELECT id, mobile || ',020-' || land AS phones, 'sales' || num || '@gmail.com' AS emails, 'www.shop' || num || '.in' AS websites, code AS gstins,
CASE WHEN strpos(mobile, pin) > 0 OR strpos('020' || land, pin) > 0 OR strpos(code, pin) > 0 THEN '' ELSE pin END AS pincodes, mobile || ':Mobile,020-' || land || ':Office' AS labelled FROM k"""
)


def document_emails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", _csv(contacts.emails(F.col("text"))).alias("emails"))


def _duck(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_steps = "coalesce(text, '')"
for _pattern, _put in (fixed.AT_SIGNS, *fixed.REPAIRS):
    _steps = f"regexp_replace({_steps}, {_duck(_pattern)}, {_duck(_put.replace('$', chr(92)))}, 'g')"
DOCUMENT_EMAILS = f"""SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(list_zip(m, range(1, len(m) + 1)), lambda x: list_position(m, x[1]) = x[2]), lambda x: x[1]), ','), '') AS emails
FROM (SELECT doc_id, list_transform(regexp_extract_all({_steps}, {_duck(fixed.EMAIL)}), lambda x: lower(trim(x))) AS m FROM documents)"""


def document_types(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id", "text").unionByName(corpora.bills(spark, d).select((-F.col("id")).alias("doc_id"), "text")).unionByName(corpora.cards(spark, d).select((-F.col("id") - 1_000_000_000).alias("doc_id"), "text"))
    return both.select("doc_id", classify.document_type(F.col("text")).alias("kind"), classify.routed_type(F.col("text")).alias("routed"))


def _hits(words: tuple[str, ...]) -> str:
    import re

    return " + ".join("CAST(regexp_matches(u, '(?:^|[^\\p{L}\\p{N}])" + re.sub(r"([.#-])", r"\\\1", w) + "(?:$|[^\\p{L}\\p{N}])') AS INT)" for w in words)


DOCUMENT_TYPES = (
    CARDS
    + f""", t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -o_orderkey, 'TAX INVOICE' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT -id - 1000000000, 'PROPRIETOR' FROM k),
h AS (SELECT doc_id, text, upper(coalesce(text, '')) AS u FROM t),
n AS (SELECT doc_id, text, {_hits(fixed.STRONG_BILL_WORDS)} AS strong, {_hits(fixed.BILL_WORDS)} AS bill, {_hits(fixed.CARD_WORDS)} AS card FROM h)
SELECT doc_id, CASE WHEN strong > 0 OR (bill >= 2 AND bill > card) THEN 'bill' ELSE 'card' END AS kind,
CASE WHEN regexp_matches(coalesce(text, ''), '(?i)invoice|bill\\s*(?:#|no|number)|tax\\s*invoice|subtotal|amount\\s*due|due\\s*date|line\\s*items') THEN 'bill' ELSE 'card' END AS routed FROM n"""
)


def bill_fields(spark: SparkSession, d: str) -> DataFrame:
    return bills.bill_fields(corpora.bills(spark, d).select("id", "text")).drop("text")


BILL_FIELDS = """SELECT o_orderkey AS id, 'TAX INVOICE' AS document_type, 'INV-' || o_orderkey AS invoice_number, strftime(o_orderdate, '%d/%m/%Y') AS invoice_date,
strftime(CAST(o_orderdate AS DATE) + 30, '%d/%m/%Y') AS due_date, CAST(0.5 AS DOUBLE) AS subtotal, CAST(round(CAST(o_totalprice AS DECIMAL(38, 10)), 2) AS DOUBLE) AS amount_due
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""


def bill_items(spark: SparkSession, d: str) -> DataFrame:
    found = bills.with_line_items(corpora.bills(spark, d).select("id", "lines"))
    return found.select("id", F.explode("items").alias("x")).select("id", "x.description", "x.code", F.round("x.billed", 2).alias("billed"))


BILL_ITEMS = """SELECT l_orderkey AS id, 'Part ' || l_partkey AS description, 'C' || l_linenumber AS code, round(l_extendedprice, 2) AS billed FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""


def boxed_lines(spark: SparkSession, d: str) -> DataFrame:
    boxed = table(spark, d, "documents").select("doc_id", lookup.boxed_lines(F.col("text")).alias("b"))
    return boxed.select("doc_id", F.size("b").cast("bigint").alias("n_lines"), F.coalesce(F.array_max(F.transform("b", lambda x: x["bottom"])), F.lit(0)).cast("bigint").alias("bottom"))


BOXED_LINES = """WITH l AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^-+\\s*(?i:page)\\s*\\d+\\s*-+$'))) AS n FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(CASE WHEN n = 0 THEN 0 ELSE 40 * (n - 1) + 30 END AS BIGINT) AS bottom FROM l"""


def script_families(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(lookup.script_family(F.col("lang")).alias("script")).agg(F.count("*").alias("n"))


_CASES = " ".join(f"WHEN lower(trim(lang)) IN ({', '.join(map(_duck, names))}) THEN '{script}'" for script, names in lookup.SCRIPTS.items())
SCRIPT_FAMILIES = f"SELECT CASE {_CASES} ELSE 'devanagari' END AS script, count(*) AS n FROM documents GROUP BY 1"


def places(spark: SparkSession, d: str) -> DataFrame:
    return corpora.cards(spark, d).select("id", lookup.first_place(F.col("text")).alias("city"))


PLACES = "SELECT s_suppkey AS id, ['Pune', 'Nagpur', 'Thane', 'Surat', NULL][CAST(s_suppkey % 5 AS INT) + 1] AS city FROM supplier"


def similarities(spark: SparkSession, d: str) -> DataFrame:
    a, b = T.skeleton(F.col("p_name")), T.skeleton(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", a.alias("skeleton"), F.round(T.similarity(a, b), 6).alias("similarity"), F.round(T.character_error(a, b), 6).alias("cer"))


_SK = "lower(regexp_replace(regexp_replace({0}, '\\p{{M}}', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"
SIMILARITIES = f"""WITH s AS (SELECT p_partkey, {_SK.format("p_name")} AS a, {_SK.format("p_type")} AS b FROM part)
SELECT p_partkey, a AS skeleton, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0 WHEN least(length(a), length(b)) = 0 THEN 0.0 ELSE 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END, 6) AS similarity,
round(CASE WHEN length(a) = 0 THEN CAST(length(b) > 0 AS INT) ELSE least(1.0, levenshtein(a, b) / CAST(length(a) AS DOUBLE)) END, 6) AS cer FROM s"""


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    cards = corpora.cards(spark, d)
    found = contacts.contact_fields(cards.select("id", "text"))
    severity = (F.col("id") % 3).alias("severity")
    gold = cards.select("id", severity, "text", "company", F.col("pin").alias("pincode"), F.col("code").alias("gstin"), F.array("mobile", F.concat(F.lit("020-"), F.col("land"))).alias("phones"), F.array(F.concat(F.lit("sales"), F.col("number"), F.lit("@gmail.com"))).alias("emails"), F.array(F.concat(F.lit("www.shop"), F.col("number"), F.lit(".in"))).alias("websites"), F.concat(F.lit("Plot, "), F.col("city")).alias("address"))
    # Every seventh card has no prediction, and where severity is 2 the company is wrong.
    predicted = found.where("id % 7 != 0").select("id", F.when(F.col("id") % 3 == 2, F.lit("Nobody")).otherwise(F.element_at(F.split("text", "\n"), 1)).alias("company"), F.get("pincodes", F.lit(0)).alias("pincode"), F.get("gstins", F.lit(0)).alias("gstin"), "phones", "emails", "websites", F.regexp_extract("text", "(Plot, \\w+)", 1).alias("address"))
    shown = evaluate.report(gold, predicted, by="severity")
    return shown.select("severity", "n", F.round("invalid_rate", 6).alias("invalid_rate"), F.round("company_exact", 6).alias("company_exact"), F.round("gstin_exact", 6).alias("gstin_exact"), F.round("phones_f1", 6).alias("phones_f1"), F.round("websites_precision", 6).alias("websites_precision"), F.round("websites_recall", 6).alias("websites_recall"), F.round("address_cer", 6).alias("address_cer"))


QUALITY_REPORT = """SELECT s_suppkey % 3 AS severity, count(*) AS n, round(avg(CAST(s_suppkey % 7 = 0 AS INT)), 6) AS invalid_rate,
round(avg(CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 3 <> 2 AS INT) END), 6) AS company_exact, round(avg(CASE WHEN s_suppkey % 7 <> 0 THEN 1.0 END), 6) AS gstin_exact,
CAST(1 AS DOUBLE) AS phones_f1, CAST(1 AS DOUBLE) AS websites_precision, CAST(1 AS DOUBLE) AS websites_recall, CAST(0 AS DOUBLE) AS address_cer FROM supplier GROUP BY ROLLUP (s_suppkey % 3)"""


def primary_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    scored = pages.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), F.length("text").alias("score"))
    return lookup.primary_pages(scored).select("doc_id", "page_no", F.col("score").cast("bigint").alias("score"))


PRIMARY_PAGES = """WITH p AS (SELECT conv_id AS doc_id, turn AS page_no, CAST(length(max(text)) AS BIGINT) AS score FROM conversations GROUP BY 1, 2)
SELECT doc_id, page_no, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, page_no) AS r FROM p) WHERE r = 1"""


def job_status(spark: SparkSession, d: str) -> DataFrame:
    return jobs.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id"])


JOB_STATUS = "SELECT user_id, event_type, event_id, n_events FROM (SELECT user_id, event_type, event_id, count(*) OVER (PARTITION BY user_id) AS n_events, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


def job_stages(spark: SparkSession, d: str) -> DataFrame:
    all_jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 4 == 0).alias("needs_review"))
    return jobs.progress_events(all_jobs, spark).groupBy("node").agg(F.count("*").alias("n"), F.max("progress").alias("progress"))


JOB_STAGES = "SELECT node, count(*) AS n, max(progress) AS progress FROM orders, (VALUES ('preprocess', 18), ('classify', 38), ('extract', 62), ('validate', 82), ('flag_review', 92), ('finalize', 98), ('done', 100)) s(node, progress) WHERE node <> 'flag_review' OR o_orderkey % 4 = 0 GROUP BY node"


def throttled_progress(spark: SparkSession, d: str) -> DataFrame:
    return jobs.reported(table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp"))), "user_id", "ms", 3_600_000)


THROTTLED_PROGRESS = """WITH RECURSIVE e AS (SELECT user_id, epoch_ms(CAST(ts AS TIMESTAMP)) AS t FROM events),
r(user_id, t, k) AS (SELECT user_id, min(t), 1 FROM e GROUP BY user_id UNION ALL SELECT r.user_id, min(e.t), r.k + 1 FROM r JOIN e ON e.user_id = r.user_id AND e.t > r.t + 3600000 GROUP BY r.user_id, r.k)
SELECT user_id, CAST(max(k) AS BIGINT) AS n FROM r GROUP BY user_id"""


def fused_pages(spark: SparkSession, d: str) -> DataFrame:
    """The Latin pass has every card's lines; the other pass has the same boxes moved by 2, with the second in Devanagari."""
    cards = corpora.cards(spark, d)
    latin = lookup.boxed_lines(F.col("text"))
    other = F.transform(latin, lambda x, i: F.struct(F.when(i == 1, F.lit("संचालक")).otherwise(x["text"]).alias("text"), (x["left"] + 2).alias("left"), x["top"].alias("top"), x["right"].alias("right"), x["bottom"].alias("bottom")))
    both = cards.select("id", latin.alias("latin_blocks"), other.alias("deva_blocks"), F.col("text").alias("latin_text"), F.lit("संचालक").alias("deva_text"))
    fused = fuse.fuse_pages(both)
    return fused.select("id", F.size("blocks").alias("n"), F.get("blocks", F.lit(1))["text"].alias("second"), F.element_at(F.split("raw_text", "\n"), 1).alias("head"))


FUSED_PAGES = "SELECT s_suppkey AS id, 8 AS n, 'संचालक' AS second, 'संचालक' AS head FROM supplier"


def universal_fields(spark: SparkSession, d: str) -> DataFrame:
    found = universal.with_deterministic(corpora.cards(spark, d).select("id", "text"))
    return found.select("id", *(_csv(c).alias(c) for c in ("phones", "landlines", "emails", "websites")), "gstin", "pincode")


UNIVERSAL_FIELDS = (
    CARDS
    + "SELECT id, mobile AS phones, '020-' || land AS landlines, 'Sales' || num || '@GMAI1.com' AS emails, 'www.shop' || num || '.in' AS websites, code AS gstin, pin AS pincode FROM k"
)


def card_addresses(spark: SparkSession, d: str) -> DataFrame:
    found = corpora.cards(spark, d).select("id", F.explode(universal.addresses(F.col("text"))).alias("a"))
    return found.select("id", "a.type", "a.label", "a.address", "a.city", "a.pincode")


CARD_ADDRESSES = (
    CARDS
    + """SELECT id, 'general' AS type, 'Location' AS label, 'Plot, ' || ['Pune', 'Nagpur', 'Thane', 'Surat', 'Elsewhere'][CAST(id % 5 AS INT) + 1] || ' - ' || pin AS address,
['Pune', 'Nagpur', NULL, 'Surat', NULL][CAST(id % 5 AS INT) + 1] AS city, pin AS pincode FROM k"""
)


def card_confidence(spark: SparkSession, d: str) -> DataFrame:
    found = universal.with_deterministic(corpora.cards(spark, d).select("id", "company", "text"))
    # Every third card has no company, every fourth no phone.
    card = {
        "company": F.when(F.col("id") % 3 != 0, F.concat("company", F.lit(" Traders"))), "phones": F.when(F.col("id") % 4 != 0, F.col("phones")), "emails": F.col("emails"),
        "persons": F.array().cast("array<struct<name:string,role:string>>"), "address_lines": F.array(F.lit("x")), "pincode": F.col("pincode"), "gstin": F.col("gstin"),
    }
    return found.select("id", universal.confidence(card).alias("c")).select("id", F.round("c.confidence", 4).alias("confidence"), "c.needs_review", F.size("c.reasons").cast("bigint").alias("n_reasons"))


CARD_CONFIDENCE = """WITH s AS (SELECT s_suppkey AS id, 25 + CASE WHEN s_suppkey % 3 <> 0 THEN 30 ELSE 0 END + CASE WHEN s_suppkey % 4 <> 0 THEN 20 ELSE 0 END AS points,
CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS n FROM supplier)
SELECT id, points / 100.0 AS confidence, points < 75 OR n >= 2 AS needs_review, CAST(n AS BIGINT) AS n_reasons FROM s"""


def fused_texts(spark: SparkSession, d: str) -> DataFrame:
    """Two passes of a page: the other one has Devanagari, a number, a code and a Latin word; this one noise, garbled lines and contacts."""
    key = F.col("s_suppkey").cast("string")
    deva = F.concat_ws("\n", F.lit("राजेश"), F.concat(F.lit("98220"), F.lpad(key, 5, "0")), F.concat(F.lit("B-"), key), F.lit("Shop"))
    latin = F.concat_ws("\n", F.lit("9:41 12KB/s VoLTE"), F.lit("HL.CEO499029R, CEOY9909€ www.x"), F.concat(F.lit("B-"), key), F.concat(F.lit("shop"), key, F.lit("@mail.in")), F.lit("Shop"), F.lit("Kiran Traders"), F.lit("x 1"))
    return corpora.suppliers(spark, d).select(F.col("s_suppkey").alias("id"), fuse.fused_text(latin, deva).alias("text"))


FUSED_TEXTS = """SELECT s_suppkey AS id, 'राजेश' || chr(10) || '98220' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || chr(10) || 'B-' || s_suppkey || chr(10) || 'Shop' || chr(10) || 'shop' || s_suppkey || '@mail.in' || chr(10) || 'Kiran Traders' AS text FROM supplier"""


def digit_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's key in each script's digits, and back."""
    zeros = F.array(*map(F.lit, sorted(fixed.INDIC_ZEROS.values())))
    spelt = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(zeros).alias("zero"))
    written = F.array_join(F.transform(F.filter(F.split(F.col("id").cast("string"), ""), lambda c: c != ""), lambda c: F.decode(F.unhex(F.lpad(F.hex(F.col("zero") + c.cast("int")), 4, "0")), "UTF-16BE")), "")
    return spelt.select("id", "zero", T.indic_digits(F.concat(F.lit("No. "), written)).alias("text"))


DIGIT_SCRIPTS = "SELECT c_custkey AS id, CAST(zero AS INT) AS zero, 'No. ' || c_custkey AS text FROM customer, (SELECT unnest([2406, 2534, 2662, 2790, 2918, 3046, 3174, 3302, 3430, 3664, 3792, 4160, 4240, 6112, 6470, 6608, 7248, 43216, 43264]) AS zero)"


def company_scores(spark: SparkSession, d: str) -> DataFrame:
    """A part's names as blocks of a card, at a place and a height that its key gives."""
    key = F.col("p_partkey")
    text = F.when(key % 5 == 0, F.concat(F.lit("Dr. "), "p_name")).when(key % 5 == 1, F.upper("p_name")).when(key % 5 == 2, F.initcap("p_name")).when(key % 5 == 3, F.concat("p_name", F.lit(" Traders"))).otherwise(F.concat(F.lit("Consulting Physician "), "p_name"))
    scored = layout.company_score(text, (key % 40).cast("int"), F.lit(1), (key % 101).cast("int"), F.lit(0), F.lit(100))
    return table(spark, d, "part").select(key.alias("id"), scored.cast("bigint").alias("score"))


COMPANY_SCORES = """WITH p AS (SELECT p_partkey AS id, len(list_filter(string_split(p_name, ' '), lambda w: w <> '')) AS n, regexp_matches(lower(p_name), '[a-z]') AS lettered FROM part)
SELECT id, CAST(3 * (id % 40) + CASE WHEN id % 101 < 40 THEN 20 WHEN id % 101 > 80 THEN -10 ELSE 0 END + CASE id % 5 WHEN 0 THEN -150 WHEN 4 THEN 25 - 150 WHEN 3 THEN 25 ELSE 0 END
+ CASE id % 5 WHEN 0 THEN CASE WHEN 1 >= (n + 1) // 2 THEN 4 ELSE 0 END WHEN 1 THEN CASE WHEN n >= 2 THEN 8 ELSE 0 END WHEN 2 THEN CASE WHEN n >= 2 THEN 4 ELSE 0 END
WHEN 3 THEN CASE WHEN 1 >= (n + 1) // 2 THEN 4 ELSE 0 END ELSE CASE WHEN 2 >= (n + 2) // 2 THEN 4 ELSE 0 END END AS BIGINT) AS score FROM p"""

_VOCABULARY = ("Enterprises", "Traders", "Motors", "Pune", "Nagpur")
_ALIASES = {"MD": "M.D.", "Pune": "PUNE"}


def token_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Aliases by token, and tokens snapped to a vocabulary."""
    key = F.col("s_suppkey")
    text = F.concat(F.element_at(F.array(*map(F.lit, ("MD,", "CMD", "(MD)", "Punekar", "Pune."))), (key % 5 + 1).cast("int")), F.lit("  "), F.element_at(F.array(*map(F.lit, ("Enterprizes", "Tradrs", "Motorcycle", "Xyz"))), (key % 4 + 1).cast("int")))
    return corpora.suppliers(spark, d).select(key.alias("id"), lookup.apply_aliases(text, _ALIASES).alias("aliased"), lookup.snap_tokens(text, _VOCABULARY, _ALIASES).alias("snapped"))


TOKEN_REPAIRS = """WITH s AS (SELECT s_suppkey AS id, ['M.D.,', 'CMD', '(M.D.)', 'Punekar', 'PUNE.'][CAST(s_suppkey % 5 AS INT) + 1] AS a, ['Enterprizes', 'Tradrs', 'Motorcycle', 'Xyz'][CAST(s_suppkey % 4 AS INT) + 1] AS b,
['Enterprises', 'Traders', 'Motorcycle', 'Xyz'][CAST(s_suppkey % 4 AS INT) + 1] AS c FROM supplier)
SELECT id, a || ' ' || b AS aliased, CASE a WHEN 'PUNE.' THEN 'Pune' ELSE a END || ' ' || c AS snapped FROM s"""


def business_cards(spark: SparkSession, d: str) -> DataFrame:
    found = parse.business_cards(corpora.laid_out_cards(spark, d).withColumn("blocks", F.lit(None).cast(f"array<{parse.BLOCK}>")))
    people = F.array_join(F.transform("persons", lambda p: F.concat_ws(":", p["name"], p["role"])), ";")
    return found.select("id", "company", "tagline", "slogan", F.array_join("services", ",").alias("services"), people.alias("persons"), F.array_join("addresses", ";").alias("addresses"), F.array_join("phones", ",").alias("phones"), "pincode")


def _spelt(number: str) -> str:
    w = f"translate(lpad(CAST({number} AS VARCHAR), 5, '0'), '0123456789', 'kalominuve')"
    return f"(upper(substr({w}, 1, 1)) || substr({w}, 2))"


BUSINESS_CARDS = f"""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 4 AS kind, {_spelt("s_suppkey")} AS w, {_spelt("(s_suppkey * 7 + 11)")} || ' ' || {_spelt("(s_suppkey * 3 + 5)")} AS p,
'4110' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS pin, '98' || lpad(CAST(s_suppkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS mobile FROM supplier),
a AS (SELECT *, 'Shop ' || id % 90 || ', Tilak Road, Pune - ' || pin AS place FROM s)
SELECT id, w || ' Enterprises' AS company, CASE WHEN kind < 2 THEN 'Quality you can see' WHEN kind = 2 THEN p || ' - Proprietor' END AS tagline, CASE WHEN kind < 2 THEN 'Quality you can see' END AS slogan, CASE WHEN kind = 2 THEN 'Pipes,Valves,Pumps' ELSE '' END AS services,
CASE kind WHEN 0 THEN p || ':Managing Director' WHEN 1 THEN 'Dr. ' || p WHEN 2 THEN p || ':Proprietor' ELSE '' END AS persons, CASE WHEN kind = 2 THEN 'Plot 4, Industrial Area;' ELSE '' END || place AS addresses, mobile AS phones,
CASE WHEN strpos(mobile, pin) > 0 THEN NULL ELSE pin END AS pincode FROM a"""


#: Lines and the kinds that each is, by hand.
_LINES = (
    ("MCB Box, Fan Box, Junction Box etc.", "goods,name"), ("Our Services:", "section"), ("Tilak Road, Pune", "address,place"), ("Rajesh T. Bokade", "name,title"), ("Managing Director", "role,title"), ("CEO", "role"),
    ("Vikram Singhania (Proprietor)", "inline,name,role"), ("kiran@firm.in", "contact,fragment"), ("॥ श्री गणेशाय नमः ॥", "garbled,prayer"), ("Kiran Enterprises", "firm"), ("9:41 12KB/s VoLTE", "status"), ("HL.CEO499029R, CEOY9909€", "address,garbled"),
)


def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Lines of known kinds, one for each customer in turn, and how many kinds of those listed each is."""
    listed = F.array(*(F.lit(t) for t, _ in _LINES))
    text = F.element_at(listed, (F.col("c_custkey") % len(_LINES) + 1).cast("int"))
    kinds = {
        "address": names.is_pure_address, "contact": names.is_native_contact, "firm": layout.has_company_word, "fragment": lines.is_address_fragment, "garbled": lines.is_garbled, "goods": lambda t: lines.is_goods_list(t, names.is_place(t)),
        "inline": lambda t: names.inline_person(t).isNotNull(), "name": names.is_person_name, "place": names.is_place, "prayer": layout.is_invocation, "role": lambda t: names.role(t).isNotNull(), "section": lines.is_section,
        "status": lines.is_status_bar, "title": lines.is_title_case_name,
    }
    held = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("text"))
    return held.select("id", F.concat_ws(",", *(F.when(test(F.col("text")), F.lit(k)) for k, test in kinds.items())).alias("kinds"))


LINE_KINDS = "SELECT c_custkey AS id, [" + ", ".join(_duck(k) for _, k in _LINES) + f"][CAST(c_custkey % {len(_LINES)} AS INT) + 1] AS kinds FROM customer"


def offline_fields(spark: SparkSession, d: str) -> DataFrame:
    """Cards with a mobile number behind a 0 or in groups, a land line, and two six-digit codes of which one is by a word of place."""
    key = F.col("s_suppkey")
    number = F.lpad((key * 7919 % 1_000_000_000).cast("string"), 9, "0")
    mobile = F.when(key % 2 == 0, F.concat(F.lit("09"), number)).otherwise(F.concat(F.lit("+91 9"), F.left(number, F.lit(4)), F.lit(" "), F.right(number, F.lit(5))))
    text = F.concat_ws("\n", F.lit("Kiran  Motors"), F.concat(F.lit("Mob: "), mobile), F.lit("Tel: 0712-2233445"), F.lit("Ref 543210\n\n"), F.concat(F.lit("Plot 4, Nagar Road - 4110"), F.lpad((key % 100).cast("string"), 2, "0")), F.lit("Shop@Firm.in, www.firm.in"))
    found = offline.with_fields(corpora.suppliers(spark, d).select(key.alias("id"), text.alias("text")))
    return found.select("id", *(_csv(c).alias(c) for c in ("phones", "landlines", "emails", "websites")), "gstin", "pincode")


OFFLINE_FIELDS = """SELECT s_suppkey AS id, '9' || lpad(CAST(s_suppkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS phones, '0712-2233445' AS landlines, 'shop@firm.in' AS emails, 'www.firm.in' AS websites, CAST(NULL AS VARCHAR) AS gstin,
'4110' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS pincode FROM supplier"""


def hallucination_rate(spark: SparkSession, d: str) -> DataFrame:
    """Every third prediction has a number, and every fifth a name, that the text doesn't hold."""
    key = F.col("s_suppkey")
    text = F.concat(F.lit("Kiran Motors\nMob 98220"), F.lpad(key.cast("string"), 5, "0"))
    phone = F.when(key % 3 == 0, F.lit("7000000000")).otherwise(F.concat(F.lit("98220"), F.lpad(key.cast("string"), 5, "0")))
    none = F.array().cast("array<string>")
    predicted = F.struct(F.when(key % 5 == 0, F.lit("Zzyzx Qwfp")).otherwise(F.lit("Kiran Motors")).alias("company"), F.lit(None).cast("string").alias("tagline"), none.alias("services"), F.array(phone).alias("phones"), none.alias("emails"), none.alias("websites"), none.alias("address_lines"), F.array().cast("array<struct<name:string,role:string>>").alias("persons"), F.lit(None).cast("string").alias("pincode"), F.lit(None).cast("string").alias("gstin"))
    found = evaluate.hallucination_rate(corpora.suppliers(spark, d).select(text.alias("text"), predicted.alias("prediction")))
    return found.select(F.round("hallucination_rate", 6).alias("hallucination_rate"), "unsupported", "populated")


HALLUCINATION_RATE = """SELECT round(sum(CAST(s_suppkey % 3 = 0 AS INT) + CAST(s_suppkey % 5 = 0 AS INT)) / CAST(2 * count(*) AS DOUBLE), 6) AS hallucination_rate,
CAST(sum(CAST(s_suppkey % 3 = 0 AS INT) + CAST(s_suppkey % 5 = 0 AS INT)) AS BIGINT) AS unsupported, 2 * count(*) AS populated FROM supplier"""


def token_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of documents in words, by language: the element at 95 in 100."""
    held = table(spark, d, "documents").select("lang", F.size(F.split("text", " ")).alias("words"))
    return records.ranks(held, ["lang"], "words", 0.95, "p95").select("lang", F.col("p95").cast("bigint").alias("p95"))


TOKEN_RANKS = """WITH w AS (SELECT lang, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL), o AS (SELECT lang, list(n ORDER BY n) AS v FROM w GROUP BY lang)
SELECT lang, CAST(v[CAST(least(floor(0.95 * len(v)), len(v) - 1) AS INT) + 1] AS BIGINT) AS p95 FROM o"""


def rendered_pages(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents of pages, with the size that each page is rendered at, made smaller by, and turned by."""
    key = F.col("o_orderkey")
    sizes = F.transform(F.sequence(F.lit(1), (key % 3 + 1).cast("int")), lambda i: F.struct((300 + key % 500 * i).cast("int").alias("width"), (200 + key % 700).cast("int").alias("height")))
    held = table(spark, d, "orders").select(key.alias("id"), sizes.alias("sizes"), (key * 37 % 20_000).cast("int").alias("side"), (key % 9).cast("int").alias("turn"))
    out = pages.pdf_pages(held)
    return out.select("id", "page_no", "width", "height", pages.sample_size(F.col("side"), F.lit(1)).alias("smaller"), pages.rotation(F.col("turn")).alias("degrees"))


RENDERED_PAGES = """WITH p AS (SELECT o_orderkey AS id, unnest(range(1, CAST(o_orderkey % 3 + 2 AS INT))) AS page_no FROM orders), s AS (SELECT id, page_no, 300 + id % 500 * page_no AS w, 200 + id % 700 AS h, id * 37 % 20000 AS side FROM p),
z AS (SELECT *, greatest(2.0::DOUBLE, least(3.5::DOUBLE, 2400::DOUBLE / greatest(w, h))) AS scale FROM s)
SELECT id, CAST(page_no AS INT) AS page_no, CAST(floor(w * scale) AS INT) AS width, CAST(floor(h * scale) AS INT) AS height, CAST(CASE WHEN side >= 16384 THEN 8 WHEN side >= 8192 THEN 4 WHEN side >= 4096 THEN 2 ELSE 1 END AS INT) AS smaller,
CAST(CASE id % 9 WHEN 6 THEN 90 WHEN 3 THEN 180 WHEN 8 THEN 270 ELSE 0 END AS INT) AS degrees FROM z"""


def recognised_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as JSON, some without boxes or lines, and the codes on them."""
    key = F.col("c_custkey")
    box = F.when(key % 2 == 0, F.concat(F.lit(', "boundingBox": {"left": 1, "top": '), key.cast("string"), F.lit("}"))).otherwise(F.lit(""))
    text = F.concat(F.lit('{"rawText": "a", "blocks": [{"text": "'), F.col("c_name"), F.lit('"'), box, F.when(key % 3 == 0, F.lit(', "lines": [{"text": "x"}, null]')).otherwise(F.lit("")), F.lit("}]}"))
    codes = F.when(key % 4 != 0, F.array(F.struct(F.lit("e").alias("value"), F.lit("EAN_13").alias("format")), F.struct(F.concat(F.lit("q"), key.cast("string")).alias("value"), F.when(key % 4 == 1, F.lit("QR_CODE")).otherwise(F.lit("CODE_39")).alias("format"))))
    read = table(spark, d, "customer").select(key.alias("id"), pages.read_ocr(text).alias("p"), pages.code_of(codes).alias("code"))
    first_block = F.get("p.blocks", F.lit(0))
    return read.select("id", first_block["text"].alias("text"), first_block["top"].alias("top"), F.size(first_block["lines"]).alias("n_lines"), "code")


RECOGNISED_PAGES = """SELECT c_custkey AS id, c_name AS text, CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS INT) AS top, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS n_lines,
CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'q' || c_custkey ELSE 'e' END AS code FROM customer"""


def job_answers(spark: SparkSession, d: str) -> DataFrame:
    """What is answered for a range of jobs, of which every seventh isn't known, after every third was asked to stop."""
    key = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("processing", "completed", "needs_review", "failed"))), (key % 4 + 1).cast("int"))
    held = table(spark, d, "orders").select(key.alias("job_id"), F.when(key % 3 == 0, jobs.cancelled(status)).otherwise(status).alias("status"))
    return jobs.status_of(held.select("job_id"), held.where("job_id % 7 != 0"))


JOB_ANSWERS = """WITH j AS (SELECT o_orderkey AS job_id, ['processing', 'completed', 'needs_review', 'failed'][CAST(o_orderkey % 4 AS INT) + 1] AS s FROM orders),
k AS (SELECT job_id, CASE WHEN job_id % 7 = 0 THEN NULL WHEN job_id % 3 = 0 AND s = 'processing' THEN 'cancelled' ELSE s END AS s FROM j)
SELECT job_id, coalesce(s, 'failed') AS status, CASE WHEN s IS NULL THEN 'JOB_NOT_FOUND' WHEN s IN ('completed', 'needs_review') THEN 'SUCCESS' WHEN s = 'failed' THEN 'SCAN_FAILED' ELSE 'PROCESSING' END AS code FROM k"""

def firm_slugs(spark: SparkSession, d: str) -> DataFrame:
    """What contacts call a firm, the line that fits, and the firm that a handle spells."""
    key = F.col("s_suppkey")
    w = F.lower(corpora.word(key))
    mail = F.when(key % 3 == 0, F.concat(F.lit("info@"), w, F.lit(".in"))).when(key % 3 == 1, F.concat(w, F.lit("sports7@gmail.com"))).otherwise(F.lit("sales@yahoo.com"))
    site = F.when(key % 2 == 0, F.concat(F.lit("https://www."), w, F.lit("-shop.in/x"))).otherwise(F.lit("www.ab.in"))
    lines = F.array(F.lit("Mob 1"), F.lit("Other Works"), F.concat(corpora.word(key), F.lit(" & Sons")))
    found = healing.slugs(F.array(mail), F.array(site))
    return corpora.suppliers(spark, d).select(key.alias("id"), _csv(found).alias("slugs"), healing.domain_line(lines, found).alias("line"), healing.brand_of_handle(F.array(mail), ("SPORTS", "MOTORS")).alias("brand"))


FIRM_SLUGS = f"""WITH s AS (SELECT s_suppkey AS id, lower({_spelt("s_suppkey")}) AS w, {_spelt("s_suppkey")} AS t FROM supplier)
SELECT id, concat_ws(',', CASE id % 3 WHEN 0 THEN w WHEN 1 THEN w || 'sports' END, CASE WHEN id % 2 = 0 THEN w || 'shop' END) AS slugs, CASE WHEN id % 3 < 2 OR id % 2 = 0 THEN t || ' & Sons' END AS line,
CASE WHEN id % 3 = 1 THEN upper(w) || ' SPORTS' END AS brand FROM s"""


def healed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Misread addresses, words and contacts put right; addresses that others hold left out."""
    key = F.col("s_suppkey").cast("string")
    address = F.concat(F.lit(", shop lo "), key, F.lit(" Bg Rosd,  Hagpur 440012 -"))
    lines = F.array(F.concat(F.lit("mail A"), key, F.lit("@gmai1.com")), F.concat(F.lit("WWW. Firm"), key, F.lit(".in")), F.concat(F.lit("+91 98220-"), F.lpad(key, 5, "0")))
    none = F.array().cast("array<string>")
    held = healing.without_contained(F.array(address, F.upper(address), F.concat(F.lit("Plot "), key)))
    return corpora.suppliers(spark, d).select(
        F.col("s_suppkey").alias("id"), healing.healed_address(address).alias("address"), healing.healed_text(F.concat(F.lit("टेडर्स हायोक "), key)).alias("text"), _csv(healing.healed_emails(none, lines)).alias("emails"),
        _csv(healing.healed_sites(none, lines)).alias("sites"), _csv(healing.healed_phones(none, lines)).alias("phones"), F.size(held).alias("n_addresses"), healing.title_cased(F.lit("DOOR LOCKS")).alias("part"),
    )


HEALED_LINES = """SELECT s_suppkey AS id, 'Shop No. ' || s_suppkey || ' Bag Road, Nagpur - 440012' AS address, 'ट्रेडर्स चौक ' || s_suppkey AS text, 'a' || s_suppkey || '@gmail.com' AS emails, 'www.firm' || s_suppkey || '.in' AS sites,
'98220' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS phones, CAST(2 AS INT) AS n_addresses, 'Door Locks' AS part FROM supplier"""


def stacked_phones(spark: SparkSession, d: str) -> DataFrame:
    """Names with as many lines of numbers below them as a key says."""
    key = F.col("c_custkey")
    number = F.concat(F.lit("98"), F.lpad(key.cast("string"), 8, "0"))
    lines = F.concat(F.array(F.lit("9822000000"), F.lit("Kiran")), F.array_repeat(F.concat(F.lit("+91 "), number), (key % 3).cast("int")), F.array(F.lit("Asha"), F.concat_ws(" ", F.left(number, F.lit(5)), F.right(number, F.lit(5)))))
    stacked = table(spark, d, "customer").select(key.alias("id"), F.posexplode(healing.stacked_phones(lines)).alias("at", "x"))
    return stacked.select("id", "at", "x.text", _csv(F.col("x.phones")).alias("phones"))


STACKED_PHONES = """WITH c AS (SELECT c_custkey AS id, '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS n FROM customer)
SELECT id, CAST(0 AS INT) AS at, 'Kiran' AS text, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN n ELSE n || ',' || n END AS phones FROM c UNION ALL SELECT id, CAST(1 AS INT), 'Asha', n FROM c"""


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers in fences, cut off, with objects for texts, or none, from a stand-in for a model."""

    def infer(text: str, grammar: str | None) -> str:
        number = int(text.split("No. ")[1].split("<")[0])
        whole = '{"companyName": "Firm %d", "emails": [{"value": "a@b.in"}], "contactPersons": ["Asha Rao"],' % number
        if number % 4 == 3:
            raise ValueError("no answer")
        return ("```json\n" + whole + "}\n```", "So: " + whole + ' "websites": ["www.b.in', "sorry")[number % 4]

    asked = corpora.suppliers(spark, d).select(F.col("s_suppkey").alias("id"), model.prompt("Read cards.", F.concat(F.lit("No. "), F.col("s_suppkey").cast("string"))).alias("prompt"))
    card = model.with_answers(asked, infer).select("id", "card.*")
    return card.select("id", F.coalesce("companyName", F.lit("by rules")).alias("company"), _csv(F.col("emails")).alias("emails"), _csv(F.col("websites")).alias("websites"), F.get("contactPersons", F.lit(0))["name"].alias("person"))


MODEL_ANSWERS = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 < 2 THEN 'Firm ' || s_suppkey ELSE 'by rules' END AS company, CASE WHEN s_suppkey % 4 < 2 THEN 'a@b.in' END AS emails,
CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'www.b.in' END AS websites, CASE WHEN s_suppkey % 4 < 2 THEN 'Asha Rao' END AS person FROM supplier"""


def fallback_bills(spark: SparkSession, d: str) -> DataFrame:
    """Bills without what a first pass finds, but for every other one's number."""
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("TAX INVOICE", "Your Health Plan", "BILL", "memo"))), (key % 4 + 1).cast("int"))
    text = F.concat_ws("\n", kind, F.concat(F.lit("Ink House "), key.cast("string")), F.concat(F.lit("Claim #: C-"), key.cast("string")), F.lit("Print Date: May 3, 2024"), F.lit("Total Due: $1,234.50"), F.lit("Provider Charges 900"))
    fields = bills.fallback_fields(text, {"invoice_number": F.when(key % 2 == 0, F.lit("known"))})
    return table(spark, d, "orders").select(key.alias("id"), *(v.alias(k) for k, v in fields.items()))


FALLBACK_BILLS = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'TAX INVOICE' ELSE 'HEALTH INSURANCE CLAIM' END AS document_type, CASE o_orderkey % 4 WHEN 1 THEN 'Your Health Plan' WHEN 3 THEN 'memo' ELSE 'Ink House ' || o_orderkey END AS issuer,
CASE WHEN o_orderkey % 2 = 0 THEN 'known' ELSE 'C-' || o_orderkey END AS invoice_number, 'May 3, 2024' AS invoice_date, CAST(NULL AS VARCHAR) AS due_date, CAST(900 AS DOUBLE) AS subtotal, CAST(1234.5 AS DOUBLE) AS amount_due FROM orders"""

def universal_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards in four layouts: a role below a name, a number beside one, a name in capitals with numbers below, and a title; each with a firm in its own way."""
    key = F.col("s_suppkey")
    w, p = corpora.word(key), F.concat(corpora.word(key * 7 + 11), F.lit(" "), corpora.word(key * 3 + 5))
    mobile = F.concat(F.lit("98"), F.lpad((key * 7919 % 100_000_000).cast("string"), 8, "0"))
    place = F.concat(F.lit("Tilak Road, Pune - 4110"), F.lpad((key % 100).cast("string"), 2, "0"))
    lines = (
        F.when(key % 4 == 0, F.array(F.concat(w, F.lit(" Tools")), p, F.lit("Managing Director"), F.concat(F.lit("info@"), F.lower(w), F.lit("tools.in")), place))
        .when(key % 4 == 1, F.array(w, F.lit("Motors"), F.concat(p, F.lit(" : "), mobile), F.lit("Our Services"), F.lit("Oil change"), F.lit("* Tyres"), place))
        .when(key % 4 == 2, F.array(F.concat(w, F.lit(" Traders")), F.upper(p), mobile, F.lit("Pipes, VALVES, Pumps"), place))
        .otherwise(F.array(F.concat(F.lit("Adv. "), p), F.concat(w, F.lit(" Associates")), F.lit("Trusted by many"), place))
    )
    found = semantic.universal_cards(corpora.suppliers(spark, d).select(key.alias("id"), F.array_join(lines, "\n").alias("text")))
    people = F.array_join(F.transform("persons", lambda x: F.concat_ws(":", x["name"], x["role"], F.array_join(x["phones"], "/"))), ";")
    return found.select("id", "company", people.alias("persons"), "tagline", _csv(F.col("services")).alias("services"), _csv(F.col("phones")).alias("phones"), F.array_join(F.transform("addresses", lambda a: a["address"]), ";").alias("addresses"), F.col("confidence.needs_review").alias("needs_review"))


UNIVERSAL_CARDS = f"""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 4 AS kind, {_spelt("s_suppkey")} AS w, {_spelt("(s_suppkey * 7 + 11)")} || ' ' || {_spelt("(s_suppkey * 3 + 5)")} AS p,
'98' || lpad(CAST(s_suppkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS mobile, 'Tilak Road, Pune - 4110' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS place FROM supplier)
SELECT id, w || [' Tools', ' Motors', ' Traders', ' Associates'][CAST(kind AS INT) + 1] AS company,
CASE kind WHEN 0 THEN p || ':Managing Director:' WHEN 1 THEN p || ':Owner:' || mobile WHEN 2 THEN upper(p) || ':Proprietor:' || mobile ELSE 'Adv. ' || p || ':Advocate:' END AS persons,
CASE kind WHEN 1 THEN 'Our Services' WHEN 3 THEN 'Trusted by many' END AS tagline, CASE kind WHEN 1 THEN 'Oil change,Tyres' WHEN 2 THEN 'Pipes,Valves,Pumps' ELSE '' END AS services,
CASE WHEN kind IN (1, 2) THEN mobile ELSE '' END AS phones, place AS addresses, kind IN (0, 3) AS needs_review FROM s"""

def refined_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of lines: a brand above its kind with a number beside a name, a firm that its site names, and a name in capitals with a handle."""
    key = F.col("s_suppkey")
    w, p = corpora.word(key), F.concat(corpora.word(key * 7 + 11), F.lit(" "), corpora.word(key * 3 + 5))
    mobile = F.concat(F.lit("98"), F.lpad((key * 7919 % 100_000_000).cast("string"), 8, "0"))
    place = F.concat(F.lit("Tilak Rosd, Pune - 4110"), F.lpad((key % 100).cast("string"), 2, "0"))
    lines = (
        F.when(key % 3 == 0, F.array(w, F.lit("Motors"), F.concat(p, F.lit(" : "), mobile), F.lit("Retailer of spare parts"), place))
        .when(key % 3 == 1, F.array(F.concat(w, F.lit(" Enterprises")), p, F.lit("Proprietor"), F.concat(F.lit("www."), F.lower(w), F.lit("ent.in")), place, F.concat(F.lit("Mob: "), mobile)))
        .otherwise(F.array(F.upper(p), F.concat(F.lower(w), F.lit("sports@gmail.com")), mobile))
    )
    found = refine.refined_cards(corpora.suppliers(spark, d).select(key.alias("id"), F.array_join(lines, "\n").alias("text")))
    people = F.array_join(F.transform("persons", lambda x: F.concat_ws(":", x["name"], x["role"])), ";")
    return found.select("id", "company", "tagline", people.alias("persons"), F.array_join("addresses", ";").alias("addresses"), _csv(F.col("phones")).alias("phones"))


REFINED_CARDS = f"""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 3 AS kind, {_spelt("s_suppkey")} AS w, {_spelt("(s_suppkey * 7 + 11)")} || ' ' || {_spelt("(s_suppkey * 3 + 5)")} AS p,
'98' || lpad(CAST(s_suppkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS mobile, 'Tilak Rosd, Pune - 4110' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS place FROM supplier)
SELECT id, CASE kind WHEN 0 THEN w || ' Motors' WHEN 1 THEN w || ' Enterprises' ELSE upper(p) END AS company, CASE WHEN kind = 0 THEN 'Retailer of spare parts' END AS tagline,
CASE kind WHEN 0 THEN p WHEN 1 THEN p || ':Proprietor' ELSE '' END AS persons, CASE WHEN kind < 2 THEN place ELSE '' END AS addresses, mobile AS phones FROM s"""


#: Made cards that the two reports below are over.
MADE_CARDS = 400


def label_keep_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of made cards whose labels outlive the noise, by its severity."""
    held = F.col("json")
    flags = {"company": held["companyName"].isNotNull(), "address": F.size(held["addressLines"]) > 0, "phones": F.size(held["phoneNumbers"]) > 0, "emails": F.size(held["emails"]) > 0}
    return records.keep_rates(synthesis.corpus(spark, MADE_CARDS), "severity", flags)


def rules_only_quality(spark: SparkSession, d: str) -> DataFrame:
    """What the offline rules find on made cards, against the labels that the noise left."""
    made = synthesis.corpus(spark, MADE_CARDS)
    none = F.lit(None).cast("string")
    gold = made.select("id", F.col("noisy_ocr").alias("text"), "severity", F.col("json.companyName").alias("company"), F.col("json.pincode").alias("pincode"), none.alias("gstin"), F.col("json.phoneNumbers").alias("phones"), F.col("json.emails").alias("emails"), F.col("json.websites").alias("websites"), F.array_join("json.addressLines", " ").alias("address"))
    found = offline.with_fields(gold.select("id", "text")).select("id", none.alias("company"), "pincode", "gstin", "phones", "emails", "websites", F.lit("").alias("address"))
    return evaluate.report(gold, found, by="severity")


QUERIES = {
    "universal_fields": (universal_fields, UNIVERSAL_FIELDS),
    "card_addresses": (card_addresses, CARD_ADDRESSES),
    "card_confidence": (card_confidence, CARD_CONFIDENCE),
    "contact_fields": (contact_fields, CONTACT_FIELDS),
    "document_emails": (document_emails, DOCUMENT_EMAILS),
    "document_types": (document_types, DOCUMENT_TYPES),
    "bill_fields": (bill_fields, BILL_FIELDS),
    "bill_items": (bill_items, BILL_ITEMS),
    "boxed_lines": (boxed_lines, BOXED_LINES),
    "script_families": (script_families, SCRIPT_FAMILIES),
    "places": (places, PLACES),
    "similarities": (similarities, SIMILARITIES),
    "quality_report": (quality_report, QUALITY_REPORT),
    "primary_pages": (primary_pages, PRIMARY_PAGES),
    "job_status": (job_status, JOB_STATUS),
    "job_stages": (job_stages, JOB_STAGES),
    "throttled_progress": (throttled_progress, THROTTLED_PROGRESS),
    "fused_pages": (fused_pages, FUSED_PAGES),
    "fused_texts": (fused_texts, FUSED_TEXTS),
    "digit_scripts": (digit_scripts, DIGIT_SCRIPTS),
    "company_scores": (company_scores, COMPANY_SCORES),
    "token_repairs": (token_repairs, TOKEN_REPAIRS),
    "business_cards": (business_cards, BUSINESS_CARDS),
    "line_kinds": (line_kinds, LINE_KINDS),
    "offline_fields": (offline_fields, OFFLINE_FIELDS),
    "hallucination_rate": (hallucination_rate, HALLUCINATION_RATE),
    "token_ranks": (token_ranks, TOKEN_RANKS),
    "rendered_pages": (rendered_pages, RENDERED_PAGES),
    "recognised_pages": (recognised_pages, RECOGNISED_PAGES),
    "job_answers": (job_answers, JOB_ANSWERS),
    "firm_slugs": (firm_slugs, FIRM_SLUGS),
    "healed_lines": (healed_lines, HEALED_LINES),
    "stacked_phones": (stacked_phones, STACKED_PHONES),
    "model_answers": (model_answers, MODEL_ANSWERS),
    "fallback_bills": (fallback_bills, FALLBACK_BILLS),
    "universal_cards": (universal_cards, UNIVERSAL_CARDS),
    "refined_cards": (refined_cards, REFINED_CARDS),
    "label_keep_rates": (label_keep_rates, None),
    "rules_only_quality": (rules_only_quality, None),
}
