"""Extraction quality: one pass over gold rows and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.exprs import bind, digits
from inkwell.functions.text import character_error, similarity, skeleton

MATCH = 0.85
EVIDENCE = 0.62


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def exact(gold: Column, predicted: Column) -> Column:
    return blank_to_null(gold).eqNullSafe(blank_to_null(predicted))


def fuzzy(gold: Column, predicted: Column) -> Column:
    return exact(gold, predicted) | F.coalesce(similarity(skeleton(blank_to_null(gold)), skeleton(blank_to_null(predicted))) >= MATCH, F.lit(False))


def matched(gold: Column, predicted: Column, near: bool) -> Column:
    """How many predictions take a gold value each, in order: an equal one, or one that is similar enough."""

    def hit(p: Column, g: Column) -> Column:
        return similarity(skeleton(p), skeleton(g)) >= MATCH if near else p == g

    def step(acc: Column, p: Column) -> Column:
        at = F.array_position(F.transform(acc["left"], lambda g: hit(p, g)), True)
        rest = F.filter(acc["left"], lambda g, i: i != at - 1)
        return F.struct(F.when(at > 0, rest).otherwise(acc["left"]).alias("left"), (acc["n"] + (at > 0).cast("int")).alias("n"))

    empty = F.array().cast("array<string>")
    start = F.struct(F.coalesce(gold, empty).alias("left"), F.lit(0).alias("n"))
    return F.aggregate(F.coalesce(predicted, empty), start, step, lambda acc: acc["n"])


def has_evidence(value: Column, text: Column, kind: str) -> Column:
    """Whether a value could come from a text: its digits, its characters, or a window of like skeleton."""
    if kind == "digits":
        return F.contains(digits(text), digits(value))
    if kind == "ascii":
        return F.contains(F.lower(text), F.lower(value))

    def window(t: Column) -> Column:
        def search(v: Column) -> Column:
            n = F.greatest(F.length(t) - F.length(v), F.lit(0))
            near = F.exists(F.sequence(F.lit(1), n + 1), lambda i: similarity(v, F.substr(t, i, F.length(v))) >= EVIDENCE)
            return (F.length(v) == 0) | F.contains(t, v) | near

        return bind(skeleton(value), search)

    return bind(skeleton(text), window)


def report(gold: DataFrame, predictions: DataFrame, by: str | None = None, sets: tuple[str, ...] = ("phones", "emails", "websites"), fields: tuple[str, ...] = ("company", "pincode", "gstin")) -> DataFrame:
    """Rates for all rows, and by a column's values where one is named (null: all rows).

    gold and predictions have id; gold has text and address, predictions address; a gold row without a
    prediction counts as invalid.
    """
    own = [*fields, *sets, "address"]
    p = predictions.select("id", F.lit(True).alias("_valid"), *(F.col(c).alias(f"_{c}") for c in own))
    rows = gold.join(p, "id", "left")
    valid = F.col("_valid").isNotNull()
    sums = [F.count("*").alias("n"), F.avg((~valid).cast("double")).alias("invalid_rate")]
    for c in fields:
        sums += [F.avg(F.when(valid, exact(F.col(c), F.col(f"_{c}")).cast("double"))).alias(f"{c}_exact"), F.avg(F.when(valid, fuzzy(F.col(c), F.col(f"_{c}")).cast("double"))).alias(f"{c}_fuzzy")]
    for c in sets:
        tp = F.sum(F.when(valid, matched(F.col(c), F.col(f"_{c}"), False)))
        given, held = F.sum(F.when(valid, F.greatest(F.size(f"_{c}"), F.lit(0)))), F.sum(F.when(valid, F.greatest(F.size(c), F.lit(0))))
        sums += [F.coalesce(tp / F.nullif(given, F.lit(0)), F.lit(0.0)).alias(f"{c}_precision"), F.coalesce(tp / F.nullif(held, F.lit(0)), F.lit(0.0)).alias(f"{c}_recall"), F.coalesce(2 * tp / F.nullif(given + held, F.lit(0)), F.lit(0.0)).alias(f"{c}_f1")]
    sums.append(F.avg(F.when(valid, character_error(F.coalesce("address", F.lit("")), F.coalesce("_address", F.lit(""))))).alias("address_cer"))
    return rows.rollup(by).agg(*sums) if by else rows.agg(*sums)


#: Fields of a prediction and how a text shows that it could hold them.
EVIDENCE_OF = {"company": "text", "tagline": "text", "pincode": "digits", "gstin": "ascii"}
EVIDENCE_OF_EACH = {"services": "text", "phones": "digits", "emails": "ascii", "websites": "ascii", "address_lines": "text"}


def hallucinations(rows: DataFrame, text: str = "text", prediction: str = "prediction") -> DataFrame:
    """Rows with ``unsupported`` (an array of kind=value) and ``populated``: values of a prediction that its text doesn't show, and all of them."""
    held = F.col(prediction)
    single = [F.when(F.coalesce(held[k], F.lit("")) != "", F.struct(F.lit(k).alias("field"), held[k].alias("value"), F.lit(kind).alias("kind"))) for k, kind in EVIDENCE_OF.items()]
    kind = "array<struct<field:string,value:string,kind:string>>"
    none = F.array().cast(kind)

    def values_of(field: str, how: str) -> Column:
        return F.coalesce(F.transform(held[field], lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"), F.lit(how).alias("kind"))), none).cast(kind)

    each = [values_of(field, how) for field, how in EVIDENCE_OF_EACH.items()]
    people = F.transform(F.filter(held["persons"], lambda p: F.coalesce(p["name"], F.lit("")) != ""), lambda p: F.struct(F.lit("person").alias("field"), p["name"].alias("value"), F.lit("text").alias("kind")))
    values = F.concat(F.filter(F.array(*single).cast(kind), lambda x: x.isNotNull()), *each, F.coalesce(people, none).cast(kind))

    def shown(x: Column, t: Column) -> Column:
        v = F.coalesce(x["value"], F.lit(""))
        by_kind = F.when(x["kind"] == "digits", has_evidence(v, t, "digits")).when(x["kind"] == "ascii", has_evidence(v, t, "ascii")).otherwise(has_evidence(v, t, "text"))
        return (v == "") | by_kind

    out = rows.withColumn("_values", values)
    unsupported = bind(F.coalesce(F.col(text), F.lit("")), lambda t: F.transform(F.filter("_values", lambda x: ~shown(x, t)), lambda x: F.concat_ws("=", x["field"], x["value"])))
    return out.withColumns({"populated": F.size("_values"), "unsupported": unsupported}).drop("_values")


def hallucination_rate(rows: DataFrame, **names: str) -> DataFrame:
    """One row: unsupported values over populated ones, 0 without any."""
    found = hallucinations(rows, **names).agg(F.sum(F.size("unsupported")).alias("u"), F.sum("populated").alias("n"))
    return found.select(F.coalesce(F.col("u") / F.nullif("n", F.lit(0)), F.lit(0.0)).alias("hallucination_rate"), F.coalesce("u", F.lit(0)).alias("unsupported"), F.coalesce("n", F.lit(0)).alias("populated"))


def first_failing(rows: DataFrame, failed: Column, order: str, k: int = 5) -> DataFrame:
    """The first k rows that failed, by an order; a report of k rows."""
    return rows.where(failed).orderBy(order).limit(k)
