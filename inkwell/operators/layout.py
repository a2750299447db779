"""Lines and boxes of a card."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.exprs import bind, first, words

# Words by which lines are told apart, in the order that they are tried.
INVOCATIONS = (
    "परमात्मा एक", "श्री गणेशाय नमः", "श्री गणेशाय नम", "श्री स्वामी समर्थ", "जय माता दी", "अल्लाह", "786", "सत्यमेव जयते", "ੴ", "एक ओंकार", "जय श्री राम",
    "शुभ लाभ", "हर हर महादेव", "प्रसन्न", "jai mata di", "ganesh",
)
COMPANY_WORDS = (
    "प्रा. लि.", "प्रा.लि.", "मार्केटींग", "मार्केटिंग", "सेल्स", "एंटरप्रायझेस", "एंटरप्रायजेस", "ट्रेडर्स", "उद्योग", "कंपनी", "ग्रुप", "इंजिनिअरिंग", "डेव्हलपर्स", "अॅन्ड", "अँड",
    "सर्व्हिसेस", "हॉस्पिटल", "अकॅडमी", "इन्स्टिट्यूट", "फाउंडेशन", "फर्निचर", "इलेक्ट्रॉनिक्स", "इलेक्ट्रॉनिक", "स्टील", "स्टिल", "ऑटोमोबाईल्स", "वस्त्रनिकेतन", "साडी सेंटर",
    "साडी", "फॅशन साडी", "फॅशन", "ज्वेलर्स", "PVT. LTD.", "PVT LTD", "PVT. LTD", "LTD.", "LTD", "LIMITED", "ENTERPRISES", "TRADERS", "MARKETING",
    "INDUSTRIES", "DEVELOPERS", "SOLUTIONS", "SYSTEMS", "TECHNOLOGIES", "VENTURES", "HOLDINGS", "INTERNATIONAL", "BROTHERS", "BROS.",
    "CONSTRUCTION", "BUILDERS", "CONTRACTORS", "SUPPLIERS", "DISTRIBUTORS", "EXPORTS", "IMPORTS", "PHARMACEUTICALS", "PHARMA", "CHEMICALS",
    "METALS", "TEXTILES", "FOODS", "BEVERAGES", "CONSULTING", "MANAGEMENT", "INFRASTRUCTURE", "CAPITAL", "FOUNDATION", "TRUST", "SOCIETY",
    "LLP", "INC", "INC.", "LLC", "CAKES", "INN", "BAKERY", "CAFE", "SWEETS", "RESTAURANT", "HOTEL", "JEWELLERS", "JEWELERS", "CLOTHING",
    "FASHION", "SAREE", "MOTORS", "AUTO", "ELECTRONICS", "OPTICAL", "CLINIC", "DENTAL", "LAB", "SALON", "SPA", "FITNESS", "GYM", "TRAVELS",
    "LOGISTICS", "TELECOM", "COMMUNICATIONS", "COMMUNICATION", "CONSULTANCY", "ASTROLOGICAL", "ASTROLOGY", "MAKEOVER", "MAKEOVERS", "BEAUTY",
    "PARLOUR", "PARLOR", "STUDIO", "BOUTIQUE", "CREATION", "CREATIONS", "COLLECTION", "COLLECTIONS", "KITCHEN", "CUISINE", "ACADEMY", "CLASSES",
    "FURNITURE", "STEEL", "SWITCHGEARS", "SWITCHGEAR", "ELECTRICALS", "ELECTRICAL", "LIGHTING", "POWER SYSTEMS", "CORP", "CO.", "CO", "GROUP",
    "ASSOCIATES",
)
SALUTATIONS = (
    "Mr.", "Mr", "Mrs.", "Mrs", "Ms.", "Ms", "Dr.", "Dr", "Prof.", "Prof", "Shri", "Smt.", "Smt", "Er.", "Er", "Adv.", "Adv", "CA.", "CA", "CS.", "CS",
    "Hon.", "Hon", "Rev.", "Capt.", "Col.", "Major", "श्री.", "श्री", "श्रीमती.", "श्रीमती", "सौ.", "सौ", "डॉ.", "डॉ", "प्रा.", "अॅड.", "अ‍ॅड.",
)
SLOGAN_WORDS = (
    "सोच", "जिंदगी", "विश्वास", "सेवा", "गुणवत्ता", "सत्य", "प्रगती", "ध्येय", "माहेरघर", "लग्न बस्त्याचे", "quality", "trusted", "service", "innovate", "excellence",
    "growth", "best", "vision", "mission", "dedication", "commitment", "integrity", "passion", "transform", "empower", "inspire", "solution",
    "future", "premier", "leading",
)
BUSINESS_WORDS = (
    "wholesaler", "retailer", "whole seller", "dealer", "distributor", "stockist", "manufacturer", "supplier", "solutions", "services",
    "sales & service", "sales and service", "high quality", "all types of", "all kinds of", "goods", "spares", "parts", "systems",
    "technologies", "technology", "pioneering", "intelligent", "innovative", "engineering", "consulting", "automation", "logistics",
    "industries", "enterprise", "सेल्स", "सर्व्हिस", "स्पेअर्स", "विक्रेते", "उत्पादक", "दुरुस्ती", "ई-रिक्षा", "ई-बाईक", "रिक्षा", "बाईक", "दुकान", "होलसेल", "होलसेल दरात",
    "मिळतील", "कम्पलीट", "कम्प्लीट", "फॅमिली शॉप",
)
OFFERING = r"(?i)^(?:dealing in|dealers of|dealers in|all types of|all kinds of|manufacturers of|mfg\. of|services:|products:)\s*"
AND_SO_ON = r"(?i)[,\s]*(?:etc\.?|and more|इत्यादी|आदी)\s*$"
TOKENS = r"[\s,;:()/|\-]+"


def _any(text: Column, values: tuple[str, ...]) -> Column:
    return F.exists(words(values), lambda w: F.contains(text, w))


def has_company_word(text: Column) -> Column:
    """A possessive brand, a company's word (short ones only at the end), or a compound one anywhere."""
    whole = tuple(w for w in COMPANY_WORDS if len(w) > 5 or "." in w)
    short = tuple(w for w in COMPANY_WORDS if len(w) <= 5 and "." not in w)
    compound = tuple(w for w in COMPANY_WORDS if " " in w or "." in w)

    def upper(u: Column) -> Column:
        tokens = F.split(u, TOKENS)
        ends = F.exists(words(short), lambda w: (u == w) | F.endswith(u, F.concat(F.lit(" "), w)))
        return F.arrays_overlap(tokens, words(whole)) | ends | _any(u, compound)

    possessive = text.rlike(r"(?i)\b[A-Za-z0-9&]+'s\s+[A-Za-z0-9&]+")
    return F.coalesce(possessive | bind(F.upper(F.trim(text)), upper), F.lit(False))


def is_invocation(text: Column) -> Column:
    """A line between bars, or with words of prayer and no company; the short ones only among three words."""

    def of(t: Column) -> Column:
        lower = F.lower(t)
        few = F.filter(F.split(lower, TOKENS), lambda w: w != "")
        om = (F.size(few) <= 3) & (F.arrays_overlap(few, words(("om", "ॐ", "ओम"))) | lower.rlike("om namah|om sai|om shree ganesh"))
        return t.rlike(r"^[॥|].*[॥|]$") | (~has_company_word(t) & (om | _any(lower, INVOCATIONS)))

    return F.coalesce(bind(F.trim(text), of), F.lit(False))


def is_slogan(text: Column) -> Column:
    """Quoted, trailing off, or with a slogan's or a trade's word."""
    lower = F.lower(F.trim(text))
    return F.coalesce(lower.rlike(r"""^["'“‘].*["'”’]$|\.\.\.|…""") | _any(lower, SLOGAN_WORDS) | _any(lower, BUSINESS_WORDS), F.lit(False))


def services(text: Column) -> Column:
    """the parts of a list, without what leads in and out of it."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), OFFERING, ""), AND_SO_ON, "")
    parts = F.transform(F.split(clean, "[,;•▪|]+"), lambda x: F.regexp_replace(F.trim(x), r"^[-•▪*✔►>]+", ""))
    return F.filter(parts, lambda x: (F.trim(x) != "") & (F.length(x) > 1))


def salutation(text: Column) -> Column:
    """the first salutation that the text begins with, before a blank or a dot."""
    t = F.trim(text)
    return first(F.filter(words(SALUTATIONS), lambda s: F.startswith(F.lower(t), F.lower(s)) & F.substr(t, F.length(s) + 1, F.lit(1)).isin("", " ", ".")))


def is_numeric(text: Column) -> Column:
    """P10: more than two in five characters are digits."""
    return F.length(F.regexp_replace(text, "[^0-9]", "")) > 0.4 * F.length(text)


def is_artifact(text: Column) -> Column:
    """No letter and no digit."""
    return ~text.rlike(r"[\p{L}\p{N}]")


def columns_of(lines: Column) -> Column:
    """For each line (text, left, top, right, bottom), sorted by top, its column: the first whose mean centre is within max(80, 30 % of the widest)."""
    reach = F.greatest(F.lit(80.0), 0.30 * F.coalesce(F.array_max(F.transform(lines, lambda x: x["right"])), F.lit(0)))
    ordered = F.array_sort(F.transform(lines, lambda x, i: F.struct(x["top"].alias("top"), i.alias("i"), x.alias("x"))))
    start = F.struct(F.array().cast("array<struct<sum:double,n:int>>").alias("means"), F.array().cast("array<int>").alias("of"))

    def step(acc: Column, z: Column) -> Column:
        centre = F.floor((z["x"]["left"] + z["x"]["right"]) / 2)
        near = F.transform(acc["means"], lambda m: F.abs(centre - m["sum"] / m["n"]) < reach)
        at = F.array_position(near, True).cast("int")
        added = F.transform(acc["means"], lambda m, i: F.struct((m["sum"] + F.when(i + 1 == at, centre).otherwise(0)).cast("double").alias("sum"), (m["n"] + F.when(i + 1 == at, 1).otherwise(0)).alias("n")))
        new = F.concat(acc["means"], F.array(F.struct(centre.cast("double").alias("sum"), F.lit(1).alias("n"))))
        return F.struct(F.when(at > 0, added).otherwise(new).alias("means"), F.concat(acc["of"], F.array(F.when(at > 0, at - 1).otherwise(F.size(acc["means"])))).alias("of"))

    return F.aggregate(ordered, start, step, lambda acc: acc["of"])


#: What marks a person rather than a firm, at the start of a block or anywhere in it.
PERSON_STARTS = ("dr.", "adv.")
PERSON_WORDS = ("m.d.", "mbbs", "consulting physician", "legal consultant")


def company_score(text: Column, height: Column, lines: Column, top: Column, card_top: Column, card_bottom: Column) -> Column:
    """A1: how much a block looks like a company's name.

    Three times its mean height of a line, 20 above 40 % of the card and -10 below 80 %, 25 for a
    company's word, 8 for two words or more in capitals or 4 if at least half of them begin with one,
    -150 for a salutation, or the title or calling of a person.
    """

    def of(t: Column) -> Column:
        lower = F.lower(t)
        person = salutation(t).isNotNull() | F.exists(words(PERSON_STARTS), lambda w: F.startswith(lower, w)) | _any(lower, PERSON_WORDS)
        place = (top - card_top) / F.greatest(card_bottom - card_top, F.lit(1))
        own = F.filter(F.split(t, r"\s+"), lambda w: w != "")
        capital = F.size(F.filter(own, lambda w: w.rlike(r"^\p{Lu}"))) >= F.floor(F.size(own) / 2)
        case = F.when(F.size(own) < 2, 0).when(~t.rlike(r"[\p{L}&&[^\p{Lu}]]"), 8).when(capital, 4).otherwise(0)
        mean = F.floor(height / F.greatest(lines, F.lit(1))).cast("int")
        return F.when(person, -150).otherwise(0) + 3 * mean + F.when(place < 0.40, 20).when(place > 0.80, -10).otherwise(0) + F.when(has_company_word(t), 25).otherwise(0) + case

    return bind(F.trim(text), of)


def company_line(lines: Column) -> Column:
    """A1 for single lines: the one that scores most; of equal scores the first."""
    top = F.array_min(F.transform(lines, lambda x: x["top"]))
    bottom = F.array_max(F.transform(lines, lambda x: x["bottom"]))

    def scored(x: Column, i: Column) -> Column:
        score = company_score(x["text"], F.greatest(x["bottom"] - x["top"], F.lit(0)), F.lit(1), x["top"], top, bottom)
        return F.struct(score.alias("score"), (-i).alias("at"), F.trim(x["text"]).alias("text"))

    contact = r"(?i)@|www\.|https?:|\d(?:[^\d\n]{0,3}\d){6}"
    able = F.filter(lines, lambda x: (F.trim(x["text"]) != "") & (~x["text"].rlike(contact) | has_company_word(x["text"])) & ~is_invocation(x["text"]))
    return F.array_max(F.transform(able, scored))["text"]
