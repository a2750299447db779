"""Contact fields of a text in the native dialect: columns of arrays, no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions.exprs import bind, digits, found, matches
from inkwell.functions.text import clean_ocr, clean_url, devanagari_digits


def _texts() -> Column:
    return F.array().cast("array<string>")


def emails(text: Column) -> Column:
    """Texts without an @, and without what the repairs make one of, are told by a cheap test."""
    signs = F.lit(False)
    for sign in fixed.SIGNS:
        signs = signs | F.contains(text, F.lit(sign))
    found = bind(clean_ocr(F.coalesce(text, F.lit(""))), lambda t: F.array_distinct(F.transform(matches(t, fixed.EMAIL), lambda m: F.lower(F.trim(m)))))
    return F.when(F.coalesce(signs | text.rlike(fixed.SIGN_LIKE), F.lit(False)), found).otherwise(_texts())


def websites(text: Column) -> Column:
    """Prefixed addresses, then naked domains, outside e-mail addresses."""

    def sites(masked: Column) -> Column:
        both = F.transform(F.concat(matches(masked, fixed.URL), matches(masked, fixed.DOMAIN)), clean_url)
        return F.array_distinct(F.filter(both, lambda u: u.contains(".") & ~u.contains("@")))

    return bind(F.regexp_replace(clean_ocr(F.coalesce(text, F.lit(""))), fixed.EMAIL, " "), sites)


def gstins(text: Column) -> Column:
    return F.array_distinct(F.transform(matches(text, fixed.GSTIN), lambda m: F.upper(F.trim(m))))


def _ten(raw: Column) -> Column:
    """The last ten digits of a mobile number, null if it hasn't 10 to 13."""
    n = F.length(digits(raw))
    return F.when((n >= 10) & (n <= 13), F.right(digits(raw), F.lit(10)))


def _phones(text: Column) -> Column:
    """Slash pairs, mobiles, land lines not yet held, and foreign numbers with other last digits."""

    def pair(m: Column) -> Column:
        head = _ten(found(m["whole"], fixed.MOBILE, 0))
        return F.when(head.isNotNull(), F.array(head, F.concat(F.left(head, F.lit(5)), m["tail"]))).otherwise(_texts())

    pairs = F.flatten(F.transform(F.arrays_zip(matches(text, fixed.SLASH_PAIR).alias("whole"), matches(text, fixed.SLASH_PAIR, 1).alias("tail")), pair))
    mobiles = F.filter(F.transform(matches(text, fixed.MOBILE), _ten), lambda x: x.isNotNull())

    def land(held: Column, m: Column) -> Column:
        raw = F.trim(m)
        n = F.length(digits(raw))
        return F.when((n >= 8) & (n <= 12) & ~F.exists(held, lambda h: F.contains(h, raw)), F.concat(held, F.array(raw))).otherwise(held)

    def foreign(held: Column, m: Column) -> Column:
        raw = F.trim(m)
        n = F.length(digits(raw))
        return F.when((n >= 7) & (n <= 15) & ~F.exists(held, lambda h: F.contains(digits(h), F.right(digits(raw), F.lit(7)))), F.concat(held, F.array(raw))).otherwise(held)

    own = F.array_distinct(F.concat(pairs, mobiles))
    own = F.aggregate(matches(text, fixed.LANDLINE), own, land)
    return F.array_distinct(F.aggregate(matches(text, fixed.INTERNATIONAL), own, foreign))


def _ready(text: Column) -> Column:
    return devanagari_digits(clean_ocr(F.coalesce(text, F.lit(""))))


def phones(text: Column) -> Column:
    """Every pattern of _phones takes six digits with one separator between two at most, over line breaks too; other texts are told by one cheap test."""
    return bind(_ready(text), lambda t: F.when(t.rlike(r"\d(?:[\s.-]?\d){5}"), _phones(t)).otherwise(_texts()))


def pincodes(text: Column) -> Column:
    """Six-digit codes that are part of no phone number and no tax id."""

    def codes(t: Column) -> Column:
        def free(held: Column) -> Column:
            found = F.array_distinct(F.transform(matches(t, fixed.PIN), lambda m: F.regexp_replace(F.trim(m), r"[\s-]", "")))
            return F.filter(found, lambda p: ~F.exists(held, lambda h: F.contains(h, p)))

        return bind(F.concat(F.transform(phones(t), digits), gstins(t)), free)

    return bind(devanagari_digits(F.coalesce(text, F.lit(""))), codes)


def labelled_phones(text: Column) -> Column:
    """(number, label) by line; a number without a label takes one from a later line; the rest of the text's numbers follow."""

    def label(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, name in reversed(fixed.PHONE_LABELS):
            out = F.when(line.rlike(pattern), F.lit(name)).otherwise(out)
        at = F.when(F.instr(line, "|") > 0, F.instr(line, "|")).otherwise(F.instr(line, "/"))
        before = F.trim(F.substr(line, F.lit(1), at - 1))
        part = F.trim(F.element_at(F.split(before, "[,;]"), -1))
        part = F.when(F.length(part) > 30, F.regexp_extract(part, r"(?:\S+\s+)?\S+$", 0)).otherwise(part)
        named = (at > 1) & (F.size(phones(F.substr(line, at + 1, F.length(line)))) > 0) & F.length(part).between(3, 35) & ~part.rlike("^[0-9]+$")
        return F.coalesce(out, F.when(named, part))

    def entries(line: Column) -> Column:
        def numbers(own: Column) -> Column:
            specific = own
            for pattern, name in reversed(fixed.BRACKET_LABELS):
                specific = F.when(line.rlike(pattern), F.lit(name)).otherwise(specific)
            return F.transform(phones(line), lambda n: F.struct(n.alias("number"), specific.alias("label"), own.alias("own")))

        return bind(label(line), numbers)

    lines = F.filter(F.transform(F.split(_ready(text), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    found = F.flatten(F.transform(lines, entries))
    none = F.array().cast("array<struct<number:string,label:string>>")

    def merge(held: Column, x: Column) -> Column:
        new = F.concat(held, F.array(F.struct(x["number"].alias("number"), x["label"].alias("label"))))
        named = F.transform(held, lambda h: F.struct(h["number"].alias("number"), F.when(h["number"] == x["number"], F.coalesce(h["label"], x["own"])).otherwise(h["label"]).alias("label")))
        return F.when(F.exists(held, lambda h: h["number"] == x["number"]), named).otherwise(new)

    def rest(held: Column) -> Column:
        own = F.filter(phones(text), lambda n: ~F.exists(held, lambda h: h["number"] == n))
        return F.concat(held, F.transform(own, lambda n: F.struct(n.alias("number"), F.lit(None).cast("string").alias("label"))))

    return bind(F.aggregate(found, none, merge), rest)


def contact_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the arrays phones, labelled_phones, emails, websites, gstins and pincodes of a text column."""
    c = F.col(text)
    return df.withColumns({"phones": phones(c), "labelled_phones": labelled_phones(c), "emails": emails(c), "websites": websites(c), "gstins": gstins(c), "pincodes": pincodes(c)})
