"""Cards: several pages into one, and the response contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.exprs import bind, first
from inkwell.operators.lines import AUDIENCE, SECTION
from inkwell.operators.universal import city_and_state

PERSONS = "array<struct<name:string,role:string,phones:array<string>,email:string>>"
CARD = f"company string, tagline string, persons {PERSONS}, phones array<string>, emails array<string>, websites array<string>, address_lines array<string>, services array<string>, pincode string, gstin string, raw_text string"

# Rules for names, and the confidence that each filled field has.
SALUTED = r"(?i)^(?:Dr\.|Adv\.|Mr\.|Mrs\.|Ms\.|Shri\b)"
CORPORATE = r"(?i)pvt|ltd|limited|llp|traders|motors|enterprises|hospital|clinic"
BULLET = r"^(?:[>►•■▪★*✓✔+→▶\-–]|\d+[\.\)])\s*"
NOT_NAMES = ("download", "scan", "get it", "getit", "app")
FIELD_CONFIDENCE = {"full_name": 0.98, "job_title": 0.94, "company": 0.97, "email": 0.99, "phone": 0.98, "second_phone": 0.92, "website": 0.94, "address": 0.90, "city": 0.93, "state": 0.93}
REVIEWED = ("full_name", "company", "phone", "email", "address")
THRESHOLD = 0.7


def is_person(name: Column, vetoes: tuple[str, ...] = ()) -> Column:
    """A name of 3 to 55 characters, three letters, two digits at most, no list, no bullet, and none of the vetoed words."""
    lower = F.lower(F.trim(name))
    out = F.length(lower).between(3, 55) & ~lower.rlike(BULLET) & ~lower.rlike(SECTION) & ~lower.rlike(AUDIENCE) & ~lower.rlike(r"[|/,…]|\.\.\.") & ~lower.rlike("^(?:" + "|".join(NOT_NAMES) + ")")
    out = out & (F.length(F.regexp_replace(lower, r"[^0-9]", "")) <= 2) & (F.length(F.regexp_replace(lower, r"\P{L}", "")) >= 3)
    if vetoes:
        out = out & ~F.exists(F.array(*(F.lit(v.lower()) for v in vetoes)), lambda v: F.contains(lower, v))
    return F.coalesce(out, F.lit(False))


def _filled(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def _as_services(persons: Column) -> Column:
    """Names that aren't persons', as services."""
    names = F.transform(persons, lambda p: F.trim(F.regexp_replace(p["name"], BULLET, "")))
    return F.filter(names, lambda n: (F.length(n) >= 2) & ~n.rlike(SECTION))


def merge_pages(pages: DataFrame, vetoes: tuple[str, ...] = ()) -> DataFrame:
    """A10: one card for each doc_id from its pages (page_no and the columns of CARD).

    Strings are the first that are filled, arrays are joined without repeats. A person stays if a
    role, a salutation or a phone number anchors it, or if it's on the page that scores most and that
    has contacts; other names become services. A document's pages are few, and meet in one row.
    """
    names = [x.split(" ")[0] for x in CARD.split(", ") if x.split(" ")[0].isidentifier()]
    one = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", *(c for c in names if c in pages.columns)))).alias("p"))

    def filled(c: str) -> Column:
        return first(F.filter(F.col(f"p.{c}"), _filled)).alias(c)

    def joined(c: str) -> Column:
        return F.array_distinct(F.flatten(F.filter(F.col(f"p.{c}"), lambda x: x.isNotNull())))

    def size(c: Column) -> Column:
        return F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))

    def score(p: Column) -> Column:
        roles = F.coalesce(F.exists(p["persons"], lambda x: _filled(x["role"])), F.lit(False))
        return 10 * size(p["phones"]) + 10 * size(p["emails"]) + 5 * size(p["address_lines"]) + F.when(roles, 20).otherwise(0)

    # Of equal scores the last page.
    best = F.array_max(F.transform("p", lambda p, i: F.struct(score(p).alias("s"), i.alias("i"))))["i"]
    no_persons = F.array().cast(PERSONS)
    marked = F.flatten(F.transform("p", lambda p, i: F.transform(F.coalesce(p["persons"], no_persons), lambda x: F.struct(
        x.alias("x"), (_filled(x["role"]) | F.coalesce(x["name"].rlike(SALUTED), F.lit(False)) | (size(x["phones"]) > 0) | ((i == F.col("best")) & (size(p["phones"]) + size(p["emails"]) > 0))).alias("anchored"),
    ))))

    def good(m: Column) -> Column:
        return m["anchored"] & is_person(m["x"]["name"], vetoes)

    def keep_first(held: Column, m: Column) -> Column:
        there = F.exists(held, lambda h: F.lower(h["name"]) == F.lower(F.trim(m["x"]["name"])))
        return F.when(there, held).otherwise(F.concat(held, F.array(m["x"])))

    one = one.withColumn("best", best).withColumn("m", marked)
    persons = F.aggregate(F.filter("m", good), no_persons, keep_first)
    other = _as_services(F.transform(F.filter("m", lambda m: ~good(m)), lambda m: m["x"]))
    texts = F.transform(F.col("p.raw_text"), lambda t, i: F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), F.coalesce(t, F.lit(""))))
    text = F.when(F.size("p") == 1, first(F.col("p.raw_text"))).otherwise(F.array_join(texts, "\n\n"))
    arrays = [joined(c).alias(c) for c in ("phones", "emails", "websites", "address_lines")]
    services = F.array_distinct(F.concat(joined("services"), other)).alias("services")
    return one.select("doc_id", filled("company"), filled("tagline"), persons.alias("persons"), *arrays, services, filled("pincode"), filled("gstin"), text.alias("raw_text"))


def response(cards: DataFrame, threshold: float = THRESHOLD, category: str | None = None, vetoes: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, success, code, data, confidence, needs_review, overall, status) of cards; ``error`` not null, if there is such a column, gives SCAN_FAILED.

    Empty fields are '' as the contract has them, but for the second phone, which is null.
    """
    empty = F.lit("")
    persons = F.coalesce("persons", F.array().cast(PERSONS))
    texts = F.array().cast("array<string>")
    c = cards.withColumns({
        "_valid": F.filter(persons, lambda p: is_person(p["name"], vetoes)), "_other": _as_services(F.filter(persons, lambda p: ~is_person(p["name"], vetoes))),
        "_company": F.coalesce("company", empty), "_tagline": F.coalesce("tagline", empty), "_services": F.coalesce("services", texts), "_address": F.array_join(F.coalesce("address_lines", texts), ", "),
    })
    c = c.withColumns({"_name": F.coalesce(first(F.col("_valid"))["name"], empty), "_title": F.coalesce(first(F.col("_valid"))["role"], empty), "_place": city_and_state(F.col("_address"))})
    same = (F.col("_name") != "") & (F.lower("_name") == F.lower("_company"))
    shown_company = F.when(F.trim("_company").rlike(SECTION), empty).when(same & F.col("_name").rlike(SALUTED), empty).otherwise(F.col("_company"))
    shown_name = F.when(same & ~F.col("_name").rlike(SALUTED) & F.col("_company").rlike(CORPORATE), empty).otherwise(F.col("_name"))
    listed = F.concat("_services", "_other")
    listed = F.array_distinct(F.when((F.size(listed) == 0) & (F.col("_tagline") != ""), F.array("_tagline")).otherwise(listed))
    values = {
        "full_name": F.col("_name"), "job_title": F.col("_title"), "company": F.col("_company"), "email": F.coalesce(first(F.coalesce("emails", texts)), empty), "phone": F.coalesce(first(F.coalesce("phones", texts)), empty),
        "second_phone": F.get(F.coalesce("phones", texts), F.lit(1)), "website": F.coalesce(first(F.coalesce("websites", texts)), empty), "address": F.col("_address"), "city": F.col("_place.city"), "state": F.col("_place.state"),
    }
    sure = {k: F.when(F.coalesce(v, empty) != "", F.lit(FIELD_CONFIDENCE[k])).otherwise(F.lit(None if k == "second_phone" else 0.0).cast("double")) for k, v in values.items()}
    scored = F.filter(F.array(*sure.values()), lambda x: x > 0)
    overall = bind(scored, lambda s: F.when(F.size(s) > 0, F.floor(F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s) * 100 + 0.5) / 100).otherwise(F.lit(0.5)))
    review = F.filter(F.array(*(F.when((F.coalesce(values[k], empty) == "") | (sure[k] < threshold), F.lit(k)) for k in REVIEWED)), lambda x: x.isNotNull())
    of_kind = F.lit(category) if category else F.coalesce(first(listed), F.lit("General Business"))
    data = F.struct(*(v.alias(k) for k, v in (values | {"full_name": shown_name, "company": shown_company}).items()), of_kind.alias("category"), listed.alias("services"), F.col("_valid").alias("contacts"), "pincode", "gstin")
    failed = F.col("error").isNotNull() if "error" in cards.columns else F.lit(False)
    out = c.select("doc_id", failed.alias("_failed"), data.alias("data"), F.struct(*(v.alias(k) for k, v in sure.items())).alias("confidence"), review.alias("needs_review"), overall.alias("overall"))
    status = F.when((F.size("needs_review") > 0) | (F.col("overall") < 0.85), "needs_review").otherwise("completed")
    return out.select("doc_id", (~F.col("_failed")).alias("success"), F.when(F.col("_failed"), "SCAN_FAILED").otherwise("SUCCESS").alias("code"), *(F.when(~F.col("_failed"), F.col(x)).alias(x) for x in ("data", "confidence", "needs_review", "overall")), F.when(~F.col("_failed"), status).alias("status"))
