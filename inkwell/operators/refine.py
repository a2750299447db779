"""Second thoughts about a card, and which of both readings stand: columns over a card's fields and its lines.

The base is the card that parse.business_cards reads off a text without boxes. Clauses that name a single sample card's
words are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions.exprs import bind, digits, first, found, matches, words
from inkwell.operators import contacts, healing, parse
from inkwell.operators.layout import has_company_word, is_invocation
from inkwell.operators.lines import BULLET, SECTION, is_goods_list
from inkwell.operators.lookup import text_lines
from inkwell.operators.names import is_person_name, is_place, without_prayer
from inkwell.operators.semantic import LED_BY_LABEL, SITE_LIKE

# Kinds of business, phrases of trade, cities that stand alone, and patterns, in the order that they are tried.
BUSINESSES = (
    "SPORTS", "MOTORS", "SOLUTIONS", "MARKETING", "ENTERPRISES", "TRADERS", "AGENCY", "INDUSTRIES", "TECHNOLOGIES", "SERVICES", "SYSTEMS", "PVT LTD", "LTD",
    "CAKES", "INN", "BAKERY", "CAFE", "SWEETS", "FOODS", "RESTAURANT", "HOTEL", "JEWELLERS", "CLOTHING", "FASHION", "SAREE", "OPTICAL", "CLINIC", "DENTAL",
    "LAB", "SALON", "SPA", "FITNESS", "GYM", "TRAVELS", "AUTO", "ELECTRONICS", "TELECOM", "COMMUNICATIONS", "COMMUNICATION", "CONSULTANCY", "ASTROLOGICAL",
    "ASTROLOGY", "SWITCHGEARS", "SWITCHGEAR", "ELECTRICALS", "ELECTRICAL", "LIGHTING", "POWER", "MAKEOVER", "MAKEOVERS", "BEAUTY", "PARLOUR", "PARLOR", "STUDIO",
    "BOUTIQUE", "CREATION", "CREATIONS", "COLLECTION", "COLLECTIONS", "KITCHEN", "CUISINE", "ACADEMY", "CLASSES", "मोटर्स", "साडी", "फॅशन", "मार्केटींग", "मार्केटिंग",
    "प्रा. लि.", "प्रा.लि.", "सेल्स", "एंटरप्रायझेस", "ट्रेडर्स", "उद्योग", "फर्निचर", "इलेक्ट्रॉनिक्स", "इलेक्ट्रॉनिक", "स्टील", "स्टिल", "सोफा", "भांडी", "वस्त्रनिकेतन", "साडी सेंटर",
)
TRADE_PHRASES = (
    "whole seller", "wholesaler", "retailer", "manufacturer", "all types of", "all kinds of", "sales & service", "sales and service", "high quality",
    "quality of all", "spare parts", "folder", "lcd & touch", "astrology", "numerology", "tarot", "healing", "vastu", "gemstones", "कम्पलीट", "फॅमिली शॉप",
    "सेल्स सर्व्हिस", "आमच्याकडे", "होलसेल दरात", "मिळतील", "लग्न बस्त्याचे",
)
NO_FIRM = ("whole seller", "wholesaler", "retailer", "complete solution", "आमच्याकडे")
LONE_CITIES = (
    "mumbai", "pune", "delhi", "bengaluru", "bangalore", "hyderabad", "chennai", "kolkata", "ahmedabad", "surat", "jaipur", "nagpur", "lucknow", "kanpur",
    "noida", "gurgaon", "gurugram", "indore", "thane", "bhopal", "visakhapatnam", "vizag", "patna", "vadodara", "baroda", "kochi", "cochin", "coimbatore",
    "nashik", "aurangabad", "solapur", "amritsar", "chandigarh", "rajkot", "नागपूर", "पुणे", "मुंबई", "नाशिक", "ठाणे", "औरंगाबाद",
)
NAMED_PHONE = r"^([a-zA-Z\s\p{IsDevanagari}]{2,25})\s*[:\-–]\s*(?:(?:\+91|91|0)[\s.-]*)?([6-9]\d{9})"
BRANCH_PHONE = r"(?i)\s*[|/]\s*(?:(?:\+91|91|0)[\s.-]*)?[6-9]\d{4}[\s.-]?\d{5}"
NAMED_BRANCH = r"(?:^|[,;]\s*|\b)([A-Za-z0-9\s]{3,35})\s*[|/]\s*(?:(?:\+91|91|0)[\s.-]*)?([6-9]\d{4}[\s.-]?\d{5})"
IN_ADDRESS = (
    BRANCH_PHONE + ".*$", r"(?i)(?:email|e-mail|mail|fnol)?[:\s.-]*[a-zA-Z0-9._%+\-]+[@8](?:gmail|gnal|[a-zA-Z0-9.\-]+)[\s.]*(?:com|in|org)", r"(?i)\b(?:email|e-mail|mail|fnol)[^,;]*",
    r"(?i)\b[a-zA-Z0-9.-]+\.(?:com|in|org|net|co)\b",
)


def _any(text: Column, values: tuple[str, ...]) -> Column:
    return F.exists(words(values), lambda w: F.contains(text, w))


def _business(text: Column) -> Column:
    return bind(F.upper(text), lambda u: _any(u, BUSINESSES))


def _named(people: Column, text: Column) -> Column:
    return F.exists(people, lambda p: F.lower(p["name"]) == F.lower(text))


def company(lines: Column, base: Column, base_tagline: Column, people: Column, emails: Column, sites: Column) -> Column:
    """The firm that contacts name; else a brand above its kind; else what a handle spells where nothing better is known; else the first line with a kind of business, or the base."""
    at = F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.get(lines, i + 1).alias("next"), F.when(i > 0, F.get(lines, i - 1)).alias("before")))

    def exact(x: Column) -> Column:
        able = _business(x) & ~x.rlike(r"@|http|www\.") & ~_any(F.lower(x), NO_FIRM) & F.length(x).between(4, 55)
        return able & ~is_place(x) & ~is_goods_list(x, is_place(x)) & (F.size(contacts.phones(x)) == 0)

    def own(z: Column) -> Column:
        b = z["before"]
        joins = F.length(b).between(2, 30) & ~b.rlike(r"[@:\d]") & ~is_invocation(b) & ~is_place(b) & ~_named(people, b)
        return F.when(F.coalesce(joins, F.lit(False)), F.concat_ws(" ", b, z["x"])).otherwise(z["x"])

    read = first(F.filter(at, lambda z: exact(z["x"])))
    grown = (F.length(base_tagline) <= 25) & ~base_tagline.rlike("(?i)solution|whole") & ~base.rlike("(?i)LTD|PVT|LIMITED|INC|LLP") & _business(base_tagline)
    plain_read = F.when(read.isNotNull(), own(read)).when(F.coalesce(grown, F.lit(False)), F.concat_ws(" ", base, base_tagline)).otherwise(base)

    def plain(x: Column) -> Column:
        return ~x.rlike(SITE_LIKE) & ~x.rlike(r"^[•\-*0-9+]") & ~x.rlike(LED_BY_LABEL) & ~_named(people, x)

    def by_contacts(slugs: Column) -> Column:
        named = F.filter(lines, lambda x: F.length(x).between(4, 65) & plain(x) & ~x.rlike(r"(?i)^(?:Dr\.|Adv\.|Mr\.|Mrs\.|Ms\.|Shri\b)"))
        line = healing.domain_line(named, slugs)
        whole = F.exists(slugs, lambda s: F.contains(F.regexp_replace(F.lower(line), "[^a-z0-9]", ""), s))
        below = first(F.filter(at, lambda z: z["x"] == line))["next"]
        return F.when(line.isNotNull(), F.when(F.coalesce(~whole & _business(below) & (F.length(below) <= 30) & plain(below), F.lit(False)), F.concat_ws(" ", line, below)).otherwise(line))

    def brands(z: Column) -> Column:
        kind = (F.size(F.split(z["x"], r"\s+")) <= 2) & F.exists(words(BUSINESSES), lambda w: F.startswith(F.upper(z["x"]), w))
        return _business(z["x"]) & kind & ~_business(z["before"]) & F.length(z["before"]).between(2, 35) & F.length(z["x"]).between(2, 40) & ~z["before"].rlike(r"[:\d]|प्रसन्न|श्री|एक") & plain(z["x"]) & plain(z["before"])

    brand = first(F.filter(at, brands))
    spelt = healing.brand_of_handle(emails, BUSINESSES)
    weak = plain_read.isNull() | _named(people, plain_read) | ~_business(plain_read)
    return F.coalesce(bind(healing.slugs(emails, sites), by_contacts), F.when(brand.isNotNull(), F.concat_ws(" ", brand["before"], brand["x"])), F.when(spelt.isNotNull() & weak, spelt), plain_read)


def candidates(lines: Column, *people: Column) -> Column:
    """Texts that might be a person's name: before a number, a line without its prayer, and the names of people."""
    phoned = F.transform(lines, lambda x: F.trim(found(x, NAMED_PHONE, 1)))
    alone = F.transform(lines, lambda x: F.when(F.length(without_prayer(x)).between(3, 40), without_prayer(x)).otherwise(x))
    return F.array_distinct(F.filter(F.concat(phoned, alone, *(F.transform(p, lambda q: q["name"]) for p in people)), lambda n: n.isNotNull()))


def persons(lines: Column, people: Column, able: Column, firm: Column, said: Column, slogan: Column) -> Column:
    """Names with a number behind them, then the base's; only without any, clean lines of two to four words. able are the candidates() that are names."""
    kind = "array<struct<name:string,role:string>>"
    none = F.array().cast(kind)

    def one(name: Column, role: Column | None = None) -> Column:
        return F.struct(name.alias("name"), (F.lit(None).cast("string") if role is None else role).alias("role"))

    phoned = F.filter(F.transform(lines, lambda x: F.trim(found(x, NAMED_PHONE, 1))), lambda n: F.coalesce(F.array_contains(able, n), F.lit(False)))
    valid = F.filter(people, lambda p: F.array_contains(able, p["name"]))
    both = F.concat(F.transform(phoned, lambda n: one(n)).cast(kind), F.transform(valid, lambda p: one(p["name"], p["role"])).cast(kind))

    def lone(x: Column) -> Column:
        name = F.when(F.length(without_prayer(x)).between(3, 40), without_prayer(x)).otherwise(x)
        shaped = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")).between(2, 4) & name.rlike(r"^[\p{L}ऀ-ॿ.\s]+$")
        other = (name == F.coalesce(firm, F.lit(""))) | (name == F.coalesce(said, F.lit(""))) | (name == F.coalesce(slogan, F.lit(""))) | _business(name)
        return F.when(shaped & ~other & F.array_contains(able, name), one(name))

    alone = F.filter(F.transform(lines, lone), lambda p: p.isNotNull()).cast(kind)

    def once(held: Column, p: Column) -> Column:
        return F.when(F.exists(held, lambda h: F.lower(h["name"]) == F.lower(p["name"])), held).otherwise(F.concat(held, F.array(p)).cast(kind))

    def inside(text: Column, name: Column) -> Column:
        return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(name))

    known = bind(F.aggregate(both, none, once), lambda k: F.when(F.size(k) > 0, k).otherwise(F.aggregate(alone, none, once)))
    return F.filter(known, lambda p: ~has_company_word(p["name"]) & ~inside(firm, p["name"]) & ~inside(said, p["name"]) & ~p["name"].rlike(BULLET) & ~p["name"].rlike(SECTION))


def addresses(lines: Column, base: Column, firm: Column, said: Column, slogan: Column, slugs: Column) -> Column:
    """The base's, healed; then lines of a place or a branch that no other address holds; without cities alone where there is more."""
    apart = F.array(*(F.coalesce(c, F.lit("")) for c in (firm, said, slogan)))

    def healed(a: Column) -> Column:
        for pattern in IN_ADDRESS:
            a = F.trim(F.regexp_replace(a, pattern, ""))
        return healing.healed_address(a)

    own = F.filter(F.transform(base, healed), lambda a: (a != "") & ~F.array_contains(apart, a))

    def of_line(x: Column) -> Column:
        clean = F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, IN_ADDRESS[0], "")), IN_ADDRESS[1], ""))
        clean = F.regexp_replace(clean, r"^[, \-.|/]+|[, \-.|/]+$", "")
        held = F.exists(slugs, lambda s: F.contains(F.regexp_replace(F.lower(x), "[^a-z0-9]", ""), s)) | (F.length(F.coalesce(firm, F.lit(""))) > 0) & F.contains(F.lower(x), F.lower(F.coalesce(firm, F.lit(""))))
        able = (is_place(x) | x.rlike(BRANCH_PHONE)) & ~F.array_contains(apart, x) & ~F.contains(x, F.lit("@")) & (F.size(contacts.websites(x)) == 0) & ~x.rlike(fixed.GSTIN) & ~held
        return F.when(able & (F.length(clean) >= 8), clean)

    def added(held: Column, a: Column) -> Column:
        seen = F.exists(held, lambda h: F.contains(F.lower(h), F.lower(a)) | F.contains(F.lower(a), F.lower(h)))
        return F.when(seen, held).otherwise(F.concat(held, F.array(a)))

    def final(all_of: Column) -> Column:
        long = F.exists(all_of, lambda a: F.size(F.split(a, r"\s+")) >= 3)
        return F.array_distinct(F.when(long, F.filter(all_of, lambda a: ~F.lower(F.trim(a)).isin(*LONE_CITIES))).otherwise(all_of))

    return bind(F.aggregate(F.filter(F.transform(lines, of_line), lambda a: a.isNotNull()), own, added), final)


def worked_out(df: DataFrame) -> DataFrame:
    """df with its columns worked out: the optimiser copies no expression past this, as it would into every lambda that names a column."""
    return df.mapInArrow(lambda batches: batches, df.schema)


def refined_cards(cards: DataFrame, vetoes: tuple[str, ...] = ()) -> DataFrame:
    """Business cards (text, and blocks if there are any) with second thoughts (C9) where they are better: company, tagline, persons, addresses, phones and their labels."""
    none = F.lit(None).cast(f"array<{parse.BLOCK}>")
    keep = ("company", "tagline", "slogan", "persons", "addresses")
    boxed = "blocks" in cards.columns
    base = parse.business_cards(cards if boxed else cards.withColumn("blocks", none), vetoes=vetoes)
    first_read = base.withColumns({f"_{c}": F.col(c) for c in keep})
    both = first_read
    if boxed:
        # The second reading has the text alone; without boxes it's the first one again.
        given = first_read.drop(*keep).withColumn("_given", F.col("blocks")).withColumn("blocks", none)
        both = parse.business_cards(given, vetoes=vetoes).drop("blocks").withColumnRenamed("_given", "blocks")
    out = worked_out(both.withColumn("_lines", text_lines(F.coalesce("text", F.lit("")))))
    firm = company(F.col("_lines"), F.col("company"), F.col("tagline"), F.col("persons"), F.col("emails"), F.col("websites"))
    out = worked_out(out.withColumns({"_firm": firm, "_able": F.filter(candidates(F.col("_lines"), F.col("persons"), F.col("_persons")), lambda n: is_person_name(n, vetoes)), "_slugs": healing.slugs(F.col("emails"), F.col("websites"))}))
    said = first(F.filter("_lines", lambda x: _any(F.lower(x), TRADE_PHRASES) & ~x.eqNullSafe(F.col("_firm"))))
    inside = F.coalesce(F.contains(F.col("_firm"), F.col("tagline")), F.lit(False))
    out = out.withColumn("_said", F.coalesce(said, F.when(~inside, F.col("tagline"))))
    out = worked_out(out)
    out = out.withColumn("_people", persons(F.col("_lines"), F.col("persons"), F.col("_able"), F.col("_firm"), F.col("_said"), F.col("slogan")))
    out = out.withColumn("_places", addresses(F.col("_lines"), F.col("addresses"), F.col("_firm"), F.col("_said"), F.col("slogan"), F.col("_slugs")))
    better = (F.coalesce(F.trim("_firm"), F.lit("")) != "") & (F.coalesce(F.trim("_company"), F.lit("")).isin("") | F.contains("_company", F.lit(",")) | (F.length("_company") > 40) | has_company_word(F.col("_firm")))
    out = worked_out(out.withColumn("company", F.when(better, F.col("_firm")).otherwise(F.coalesce("_company", "_firm"))))
    again = F.col("_said").isNotNull() & (F.col("_tagline").isNull() | F.contains(F.col("_tagline"), F.coalesce("company", F.lit(""))))

    def valid(people: str) -> Column:
        return F.filter(people, lambda p: F.array_contains("_able", p["name"]) & ~has_company_word(p["name"]) & (F.lower(p["name"]) != F.lower(F.coalesce("company", F.lit("")))))

    pairs = F.flatten(F.transform("_lines", lambda x: F.arrays_zip(F.transform(matches(x, NAMED_BRANCH, 1), F.trim).alias("label"), F.transform(matches(x, NAMED_BRANCH, 2), digits).alias("number"))))
    told = F.filter("labelled_phones", lambda h: ~(h["label"].isNull() & F.exists(pairs, lambda b: b["number"] == h["number"])))
    new = F.filter(pairs, lambda b: ~F.exists("labelled_phones", lambda h: (h["number"] == b["number"]) & h["label"].isNotNull()))
    return out.withColumns({
        "tagline": F.when(again, F.col("_said")).otherwise(F.coalesce("_tagline", "_said")), "slogan": F.col("_slogan"), "persons": F.when(F.size(valid("_people")) > 0, valid("_people")).otherwise(valid("_persons")),
        "addresses": F.when(F.size("_addresses") > 0, F.col("_addresses")).otherwise(F.col("_places")), "phones": F.array_union("phones", F.transform(pairs, lambda b: b["number"])),
        "labelled_phones": F.concat(told, F.transform(new, lambda b: F.struct(b["number"].alias("number"), b["label"].alias("label")))),
    }).drop("_lines", "_firm", "_said", "_able", "_slugs", "_people", "_places", *(f"_{c}" for c in keep))
