"""Repairs of the universal dialect and what contacts say of a firm: columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.exprs import bind, digits, first, matches, words
from inkwell.operators.lookup import aliased

# Misread words and what they were, in the order that they are put right.
ALIASES = {
    "हायोक": "चौक", "चाक": "चौक", "पता": "पत्ता", "रथा": "रिक्षा", "रत्था": "रिक्षा", "सव्हिस": "सर्व्हिस", "स्पेअरस": "स्पेअर्स", "सचालक": "संचालक", "नागपुर": "नागपूर",
}
TRADE_WORDS = {
    "मोटसी": "मोटर्स", "मोटसि": "मोटर्स", "टेडर्स": "ट्रेडर्स", "ट्रेडस": "ट्रेडर्स", "सव्हिस": "सर्व्हिस", "स्पेअरस": "स्पेअर्स", "सचालक": "संचालक", "रथा": "रिक्षा", "रत्था": "रिक्षा",
}
MAIL_REPAIRS = (
    (r"(?i)@gmai1\.com", "@gmail.com"), (r"(?i)@gma1l\.com", "@gmail.com"), (r"(?i)@hotma1l\.com", "@hotmail.com"), (r"(?i)@out1ook\.com", "@outlook.com"), (r"(?i)@yah00\.com", "@yahoo.com"),
)
ADDRESS_REPAIRS = (
    (r"(?i)\bshop\s*lo\b\.?", "Shop No."), (r"(?i)\bshop\s*no\b\.?", "Shop No."), (r"(?i)\bBg\s+Rosd\b", "Bag Road"), (r"(?i)\bRosd\b", "Road"), (r"(?i)\bSqsre\b", "Square"), (r"(?i)\bSqaure\b", "Square"),
    (r"(?i)\bSltsidd\b", "Sitabuldi"), (r"(?i)\bSitabuld\b", "Sitabuldi"), (r"(?i)\bMaharaj\s+Bag\s+Road\b", "Maharaj Bagh Road"), (r"(?i)\bHagpur\b", "Nagpur"), (r"(?i)\bNagpir\b", "Nagpur"),
    (r"(?i)\b(Nagpur)[\s,-]*(\d{6})\b", "$1 - $2"),
)
WEBMAIL = ("gmail", "yahoo", "hotmail", "outlook", "rediffmail", "icloud", "live")
GENERAL_HANDLES = ("info", "contact", "admin", "sales", "support", "office", "help")
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SITE = r"(?i)(?:https?://|www\.)\s*[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
MOBILE = r"(?:\+?91[\s-]?)?(?:[-–\s]*)?([6-9]\d{4}[\s-]?\d{5}|[6-9]\d{9})\b"


def _rewritten(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, text)


def healed_text(text: Column) -> Column:
    """Words of trade, then the other misread words, wherever they stand."""
    return aliased(aliased(text, TRADE_WORDS), ALIASES)


def healed_address(text: Column) -> Column:
    """misread words of an address, single blanks, and no punctuation at its ends."""
    return F.regexp_replace(F.regexp_replace(_rewritten(text, ADDRESS_REPAIRS), r"\s+", " "), r"^[, \-.|/]+|[, \-.|/]+$", "")


def healed_emails(known: Column, lines: Column) -> Column:
    """known addresses and those of the lines in lower case, each once, with their providers put right."""
    found = F.flatten(F.transform(lines, lambda x: F.transform(matches(x, EMAIL), F.lower)))
    return F.transform(F.array_union(known, found), lambda e: _rewritten(e, MAIL_REPAIRS))


def healed_sites(known: Column, lines: Column) -> Column:
    """known sites and the first of each line, in lower case, without blanks and dots before them."""

    def clean(x: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(x, r"^\.+", ""), r"\s+", ""))

    found = F.filter(F.transform(lines, lambda x: first(matches(x, SITE))), lambda x: x.isNotNull())
    return F.concat(F.transform(known, clean), F.array_except(F.transform(found, clean), F.transform(known, clean)))


def healed_phones(known: Column, lines: Column) -> Column:
    """known numbers, then mobile numbers of ten digits, 91 before them left out."""
    found = F.flatten(F.transform(lines, lambda x: F.transform(matches(x, MOBILE), digits)))
    ten = F.transform(found, lambda d: F.when((F.length(d) == 12) & F.startswith(d, F.lit("91")), F.substr(d, F.lit(3))).otherwise(d))
    return F.array_union(known, F.filter(ten, lambda d: F.length(d) == 10))


def title_cased(text: Column) -> Column:
    """F16: a part in capitals (more than three characters) as words that begin with one."""
    return F.when(text.rlike(r"^[A-Z\s&]+$") & (F.length(text) > 3), F.initcap(text)).otherwise(text)


def _slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def handles(emails: Column) -> Column:
    """Of addresses at a common provider, the names that stand for a firm."""

    def own(e: Column) -> Column:
        handle, domain = _slug(F.regexp_replace(F.substring_index(e, "@", 1), r"[0-9]+$", "")), F.lower(F.substring_index(F.substring_index(e, "@", -1), ".", 1))
        return F.when(domain.isin(*WEBMAIL) & (F.length(handle) >= 4) & ~handle.isin(*GENERAL_HANDLES), handle)

    return F.filter(F.transform(F.filter(emails, lambda e: F.contains(e, F.lit("@"))), own), lambda s: s.isNotNull())


def slugs(emails: Column, sites: Column) -> Column:
    """what addresses and sites call a firm: their domain's first label, or the name at a common provider; four characters or more, each once."""

    def of_mail(e: Column) -> Column:
        domain = F.lower(F.substring_index(F.substring_index(e, "@", -1), ".", 1))
        return F.when(~domain.isin(*WEBMAIL) & (F.length(_slug(domain)) >= 4), F.array(_slug(domain))).otherwise(handles(F.array(e)))

    def of_site(u: Column) -> Column:
        return _slug(F.substring_index(F.substring_index(F.trim(F.regexp_replace(F.regexp_replace(u, "(?i)^https?://", ""), r"(?i)^www\.", "")), "/", 1), ".", 1))

    mail = F.flatten(F.transform(F.filter(emails, lambda e: F.contains(e, F.lit("@"))), of_mail))
    return F.array_distinct(F.concat(mail, F.filter(F.transform(sites, of_site), lambda s: F.length(s) >= 4)))


def brand_of_handle(emails: Column, trades: tuple[str, ...]) -> Column:
    """a firm from a handle that ends in a trade: the rest of it and the trade, in capitals; the last such address counts."""

    def brand(h: Column) -> Column:
        trade = first(F.filter(words(trades), lambda t: F.endswith(F.upper(h), F.upper(t)) & (F.length(h) > F.length(t))))
        return F.when(trade.isNotNull(), F.concat_ws(" ", F.upper(F.left(h, F.length(h) - F.length(trade))), F.upper(trade)))

    found = F.filter(F.transform(handles(emails), brand), lambda b: b.isNotNull())
    return F.try_element_at(found, F.lit(-1))


def domain_line(lines: Column, known: Column) -> Column:
    """The first line that holds a firm's slug, or is held by one, or begins with the same five characters."""

    def fits(line: Column) -> Column:
        def of(c: Column) -> Column:
            same = F.exists(known, lambda s: F.contains(c, s) | F.contains(s, c) | ((F.length(c) >= 5) & (F.length(s) >= 5) & (F.left(c, F.lit(5)) == F.left(s, F.lit(5)))))
            return (F.length(c) >= 4) & same

        return bind(_slug(line), of)

    return first(F.filter(lines, fits))


def without_contained(addresses: Column) -> Column:
    """Addresses of which none holds an earlier one or is held by it, whatever the case."""

    def step(held: Column, a: Column) -> Column:
        seen = F.exists(held, lambda h: F.contains(F.lower(h), F.lower(a)) | F.contains(F.lower(a), F.lower(h)))
        return F.when(seen, held).otherwise(F.concat(held, F.array(a)))

    return F.aggregate(addresses, F.array().cast("array<string>"), step)


def stacked_phones(lines: Column) -> Column:
    """For each line that isn't only a phone number, the numbers of the lines right below it that are: (text, phones)."""
    kind = "array<struct<text:string,phones:array<string>>>"
    alone = r"^\s*(?:\+?91[\s-]*)?[6-9]\d{4}[\s-]?\d{5}\s*$"

    def step(held: Column, line: Column) -> Column:
        last = F.try_element_at(held, F.lit(-1))
        grown = F.concat(F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))), F.array(F.struct(last["text"].alias("text"), F.concat(last["phones"], F.array(F.right(digits(line), F.lit(10)))).alias("phones"))))
        new = F.concat(held, F.array(F.struct(line.alias("text"), F.array().cast("array<string>").alias("phones"))))
        return F.when(line.rlike(alone) & (F.size(held) > 0), grown).when(line.rlike(alone), held).otherwise(new)

    return F.aggregate(lines, F.array().cast(kind), step)


def with_person(persons: Column, name: Column, phones: Column, role: str = "Owner") -> Column:
    """Persons (name, role, phones) with a person's phones; one of the same name takes them, whatever the case, else one is added."""
    same = F.exists(persons, lambda p: F.lower(p["name"]) == F.lower(name))
    grown = F.transform(persons, lambda p: F.struct(p["name"].alias("name"), p["role"].alias("role"), F.when(F.lower(p["name"]) == F.lower(name), F.array_union(p["phones"], phones)).otherwise(p["phones"]).alias("phones")))
    return F.when(same, grown).otherwise(F.concat(persons, F.array(F.struct(name.alias("name"), F.lit(role).alias("role"), phones.alias("phones")))))


def phone_style(number: Column, seed: Column) -> Column:
    """ten digits in one of five styles, by a hash: plain, 5 5, +91 5-5, a 0 before them, 4 3 3."""
    share = F.pmod(F.xxhash64(seed), F.lit(100))
    a, b = F.left(number, F.lit(5)), F.right(number, F.lit(5))
    grouped = F.concat_ws(" ", F.left(number, F.lit(4)), F.substr(number, F.lit(5), F.lit(3)), F.substr(number, F.lit(8), F.lit(3)))
    return F.when(share < 25, number).when(share < 45, F.concat_ws(" ", a, b)).when(share < 60, F.concat(F.lit("+91 "), a, F.lit("-"), b)).when(share < 75, F.concat(F.lit("0"), number)).otherwise(grouped)
