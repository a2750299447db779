"""Cards in the universal dialect from their lines alone: persons, company, tagline, services, as columns.

Every rule gives, for all lines at once, an array of what it finds; rules in order are arrays in order,
and "only if none yet" is a choice between arrays. So a card is worked out in the JVM, without state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.exprs import bind, first, found, matches, words
from inkwell.functions.text import indic_digits
from inkwell.operators import healing, universal
from inkwell.operators.cards import is_person
from inkwell.operators.layout import is_artifact
from inkwell.operators.lines import BULLET, SECTION, is_contact
from inkwell.operators.lookup import text_lines
from inkwell.operators.names import without_prayer

# Trades, roles, and patterns that tell lines apart, in the order that they are tried.
TRADES = (
    "स्टील", "स्टिल", "फर्निचर", "इलेक्ट्रॉनिक्स", "इलेक्ट्रॉनिक", "मोटर्स", "ऑटोमोबाईल्स", "ऑटो", "ट्रेडर्स", "एंटरप्रायझेस", "एजन्सी", "उद्योग", "डेअरी", "साडी सेंटर",
    "वस्त्रनिकेतन", "ज्वेलर्स", "हॉटेल", "कॅफे", "बेकरी", "हॉस्पिटल", "क्लिनिक", "गॅरेज", "सर्व्हिसेस", "सॉल्युशन्स", "कन्स्ट्रक्शन", "डेव्हलपर्स", "सुपर मार्केट",
    "प्रोव्हिजन स्टोअर्स", "किराणा", "प्रिंटर्स", "पब्लिकेशन", "पॅकर्स", "सोल्युशन्स", "मल्टिसर्व्हिसेस", "SPORTS", "TELECOM", "SOLUTIONS", "PVT. LTD.", "PVT LTD", "LIMITED",
    "CONSULTANCY", "ASTROLOGICAL", "MARKETING", "मार्केटींग", "सेल्स", "फॅशन साडी", "फॅशन", "CAKES", "INN", "BAKERY", "CLINIC", "HOSPITAL", "MATERNITY",
    "HEALTHCARE", "DIAGNOSTIC", "PHARMA", "PHARMACEUTICALS", "ENGINEERING", "MANUFACTURING", "MANUFACTURERS", "INDUSTRIES", "INDUSTRY", "ENTERPRISES",
    "TRADERS", "TRADING", "TECHNOLOGIES", "TECH", "INFRA", "DEVELOPERS", "BUILDERS", "CONSTRUCTION", "ASSOCIATES", "CONSULTANTS", "CONSULTING", "LEGAL",
    "ADVOCATE", "AUTO", "CARE", "SERVICE", "SERVICES", "MOTORS", "GARAGE", "LABS", "LABORATORIES", "SYSTEMS", "VENTURES", "HOLDINGS", "FOODS", "FOOD",
    "PRODUCTS", "GRAINS", "SPICES", "AGRO", "AGENCY", "COMMUNICATIONS", "ELECTRICALS", "ELECTRONICS", "ELECTRICAL", "STEEL", "FURNITURE", "MAKEOVER",
    "MAKEOVERS", "BEAUTY", "PARLOUR", "PARLOR", "SALON", "STUDIO", "BOUTIQUE", "CREATION", "CREATIONS", "COLLECTION", "COLLECTIONS", "KITCHEN", "CUISINE",
    "ACADEMY", "CLASSES", "SWEETS", "CAFE", "FITNESS", "GYM", "SPA",
)
# Trades of three Latin letters stand within names too (Vinni, Kaspate), so they count as whole words only.
SHORT_TRADES = tuple(t for t in TRADES if len(t) <= 3 and t.isascii())
LONG_TRADES = tuple(t for t in TRADES if t not in SHORT_TRADES)
SHORT_TRADE = r"(?i)(?<!\p{L})(?:" + "|".join(SHORT_TRADES) + r")S?(?!\p{L})"
ROLES = (
    "chief executive officer", "chief technology officer", "chief medical officer", "chief financial officer", "managing director", "executive director",
    "managing partner", "senior partner", "partner", "advocate & legal consultant", "senior advocate", "legal counsel", "notary public", "chief surgeon",
    "senior consultant", "consultant physician", "pediatrician", "cardiologist", "radiologist", "founder & ceo", "ceo & founder", "ceo", "founder",
    "co-founder & cto", "director", "proprietor", "general manager", "head of engineering", "branch manager", "branch head", "manager", "owner",
)
INDIC_ROLES = (
    "संचालक", "सह-संचालक", "व्यवस्थापक", "अध्यक्ष", "उपाध्यक्ष", "सचिव", "खजिनदार", "प्रोप्रायटर", "प्रोप्रा.", "मालक", "भागीदार", "प्रबंधक", "सल्लागार", "अधिवक्ता",
    "संस्थापक", "निदेशक", "डॉक्टर", "वैद्य", "સંચાલક", "માલિક", "ભાગીદાર", "મેનેજર", "પ્રમુખ", "મંત્રી", "એમ.ડી.", "இயக்குநர்", "நிர்வாகி", "உரிமையாளர்", "தலைவர்",
    "செயலாளர்", "மருத்துவர்", "యజమాని", "మేనేజర్", "డైరెక్టర్", "వైద్యుడు", "అధ్యక్షుడు", "ನಿರ್ದೇಶಕ", "ವ್ಯವಸ್ಥಾಪಕ", "ಮಾಲೀಕರು", "ವೈದ್ಯರು", "পরিচালক", "ম্যানেজার", "মালিক",
    "ডাক্তার",
)
NAMED_PHONE = r"([A-Zऀ-ॿ][a-zA-Zऀ-ॿ\s.]+)\s*[:\-–|]\s*(?:[^\d]*)([6-9]\d{9})"
NO_NAME = r"(?i)^(?:mob|mobile|tel|telephone|phone|ph|cell|off|res|fax|contact|mo|call|whatsapp|shop|plot|flat|road|nagar|gst|gstin|email|website|web)\b|^(?:मोबाईल|मोबाइल|मो\.|मो|फोन|दूरध्वनी|संपर्क|भ्रमणध्वनी)$|^(?:पत्ता|पता|कार्यालय|ऑफीस)"
TITLED = r"(?i)^(?:Mr\.|Shri\b|Dr\.|Prof\.|Adv\.)\s+([A-Za-z\s.]+)"
LED_BY_LABEL = r"(?i)^(?:Tel|Mob|Phone|Email|GSTIN|Plot|Shop|Road|Address|Res Add|Off)"
SITE_LIKE = r"(?i)@|www\.|^http|\.(?:com|in|org|net|co|io)\b"
CALLING = r"(?i)^(?:High\s+Court\s+Advocate|Senior\s+Advocate|Legal\s+Consultant|Advocate|Adv\.|Director|Proprietor|Managing|CEO|Founder|Consulting\s+Physician|Consultant|Physician|Doctor|Dr\.|Surgeon|M\.D\.|MBBS|BAMS|BHMS|Whole\s*Seller|Wholesaler|Retailer|Manufacturer\s+of|Dealers\s+in|All\s+types|All\s+kinds|Specializing\s+in)"
CUES = r"(?i)माहेरघर|विश्व|दालन|केंद्र|शुद्ध तुपातील|गुणवत्तापूर्ण|विश्वासार्हतेचे|एकदा भेट द्या|सोच|जिंदगी|बदल|सॉल्युशन|सर्व्हिस|क्वालिटी|कम्पलीट|फॅमिली|solution|quality|excellence|trusted|service|satisfaction|crafting|building|connecting|innovating|complete\s+family|one\s+stop"
OFFERED = r"(?i)(?:quality\s+(?:of\s+)?|all\s+types?\s+(?:of\s+)?)([^,\n]+)"

PERSON = "struct<name:string,role:string,phones:array<string>>"


def _none() -> Column:
    return F.array().cast(f"array<{PERSON}>")


def _person(name: Column, role: Column, phones: Column | None = None) -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(name.alias("name"), role.alias("role"), (empty if phones is None else phones).alias("phones"))


def _trade(text: Column) -> Column:
    return bind(F.upper(text), lambda u: F.exists(words(LONG_TRADES), lambda t: F.contains(u, t)) | u.rlike(SHORT_TRADE))


def is_role(text: Column, persons: Column) -> Column:
    """P20: in brackets, a role or one with words before or after it, or a role that a person has."""
    lower = F.lower(F.trim(text))
    own = F.exists(words(ROLES), lambda r: (lower == r) | F.startswith(lower, F.concat(r, F.lit(" "))) | F.endswith(lower, F.concat(F.lit(" "), r)))
    held = F.exists(persons, lambda p: F.coalesce(F.contains(lower, F.lower(p["role"])), F.lit(False)))
    return F.trim(text).rlike(r"^\(.*\)$|^\[.*\]$") | own | held


def _by_line(lines: Column, rule) -> Column:
    """All that rule(line, line before it) gives, in order; nulls left out."""
    given = F.transform(lines, lambda x, i: rule(x, F.when(i > 0, F.get(lines, i - 1))))
    return F.filter(given, lambda p: p.isNotNull())


def persons(lines: Column, vetoes: tuple[str, ...] = ()) -> Column:
    """The persons of lines: by roles beside names, numbers beside names, titles; else in capitals, else at the top of the card."""
    vetoed = (*LONG_TRADES, *vetoes)

    def able(name: Column) -> Column:
        return is_person(name, vetoed) & ~F.coalesce(name.rlike(SHORT_TRADE), F.lit(False))

    def indic(x: Column, before: Column) -> Column:
        role = first(F.filter(words(INDIC_ROLES), lambda r: F.contains(x, r)))
        inline = F.trim(F.regexp_extract(x, r"^(.+?)\s*[\(\[]", 1))
        alone = (F.trim(x) == role) | F.startswith(F.trim(x), F.concat(role, F.lit(" :"))) | F.startswith(F.trim(x), F.concat(role, F.lit(":")))
        name = F.when(x.rlike(r"[\(\[].+[\)\]]") & (F.length(inline) > 2), inline).when(alone & F.length(before).between(3, 39) & ~is_contact(before), before)
        return F.when(role.isNotNull() & able(name), _person(name, role))

    def english(x: Column, before: Column) -> Column:
        lower = F.lower(x)
        return F.when(F.exists(words(ROLES), lambda r: F.contains(lower, r)) & F.length(before).between(3, 39) & ~is_contact(before) & able(before), _person(before, x))

    def titled(x: Column, before: Column) -> Column:
        name = F.trim(F.regexp_extract(x, TITLED, 0))
        role = F.when(name.rlike(r"(?i)Adv\."), "Advocate").when(name.rlike(r"(?i)Dr\."), "Doctor").otherwise("Contact Person")
        return F.when((F.length(name) > 5) & able(name), _person(name, role))

    stacked = healing.stacked_phones(lines)

    def phoned(x: Column) -> Column:
        pairs = F.arrays_zip(matches(x["text"], NAMED_PHONE, 1).alias("name"), matches(x["text"], NAMED_PHONE, 2).alias("phone"))
        given = F.filter(F.transform(pairs, lambda p: F.struct(F.trim(p["name"]).alias("name"), p["phone"].alias("phone"))), lambda p: F.length(p["name"]).between(2, 35) & ~p["name"].rlike(NO_NAME) & able(p["name"]))
        return F.transform(given, lambda p: _person(p["name"], F.lit("Owner"), F.array_union(F.array(p["phone"]), x["phones"])))

    listed = F.concat(_by_line(lines, indic), _by_line(lines, english), F.flatten(F.transform(stacked, phoned)), _by_line(lines, titled))
    capitals = F.transform(F.filter(stacked, lambda x: x["text"].rlike(r"^[A-Z]{3,}(?:\s+[A-Z]{3,}){1,2}$") & able(x["text"])), lambda x: _person(F.trim(x["text"]), F.lit("Proprietor"), x["phones"]))

    def top(x: Column) -> Column:
        name = without_prayer(x)
        shaped = name.rlike(r"^[ऀ-ॿ\s.]+$") | name.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$")
        n = F.size(F.filter(F.split(name, r"\s+"), lambda w: F.length(w) > 1))
        return F.when(shaped & n.between(2, 4) & ~name.rlike(universal.LOCATION) & ~name.rlike(r"\d") & able(name), _person(name, F.lit("प्रोप्रायटर")))

    at_top = F.filter(F.transform(F.slice(lines, 1, 4), top), lambda p: p.isNotNull())

    def merge(held: Column, p: Column) -> Column:
        same = F.exists(held, lambda h: F.lower(h["name"]) == F.lower(p["name"]))
        grown = F.transform(held, lambda h: F.when(F.lower(h["name"]) == F.lower(p["name"]), _person(h["name"], h["role"], F.array_union(h["phones"], p["phones"]))).otherwise(h))
        return F.when(same, grown).otherwise(F.concat(held, F.array(p)))

    def chosen(known: Column) -> Column:
        return F.when(F.size(known) > 0, known).when(F.size(capitals) > 0, F.slice(capitals, 1, 1)).otherwise(F.slice(at_top, 1, 1))

    return bind(F.aggregate(listed, _none(), merge), chosen)


def company(lines: Column, people: Column, emails: Column, sites: Column) -> Column:
    """The line that contacts name, with a trade's line below it; else a brand above its trade; else the first line with a trade."""

    def plain(x: Column) -> Column:
        other = x.rlike(SITE_LIKE) | x.rlike(r"^[•\-*0-9+]") | x.rlike(LED_BY_LABEL)
        return ~other & ~F.exists(people, lambda p: F.lower(p["name"]) == F.lower(x))

    def candidates(slugs: Column) -> Column:
        at = F.transform(lines, lambda x, i: F.struct(x.alias("x"), F.get(lines, i + 1).alias("next"), F.when(i > 0, F.get(lines, i - 1)).alias("before")))
        named = F.filter(lines, lambda x: F.length(x).between(4, 65) & plain(x) & ~x.rlike(TITLED) & ~x.rlike(r"(?i)Consulting\s+Physician|M\.D\.\s*\(|MBBS|LL\.B\.|Advocate|Legal\s+Consultant"))
        line = healing.domain_line(named, slugs)
        below = first(F.filter(at, lambda z: z["x"] == line))["next"]
        by_domain = F.when(line.isNotNull(), F.when((F.length(below) <= 30) & plain(below) & _trade(below), F.concat_ws(" ", line, below)).otherwise(line))
        brand = F.filter(at, lambda z: _trade(z["x"]) & (F.size(F.split(z["x"], r"\s+")) <= 4) & F.length(z["x"]).between(2, 40) & F.length(z["before"]).between(2, 35) & (~_trade(z["before"]) | F.lower(z["before"]).endswith("'s")) & plain(z["x"]) & plain(z["before"]) & ~z["before"].rlike("प्रसन्न|श्री|एक") & ~is_role(z["before"], people))
        by_trade = first(F.filter(lines, lambda x: _trade(x) & plain(x) & ~x.rlike(SECTION) & ~x.rlike(BULLET) & ~x.rlike(CALLING) & ~x.rlike("आमच्याकडे|लागणाऱ्या|होलसेल")))
        best = F.coalesce(by_domain, F.when(F.size(brand) > 0, F.concat_ws(" ", first(brand)["before"], first(brand)["x"])), by_trade)
        return F.when(~best.rlike(SECTION) & ~best.rlike(BULLET), best)

    return bind(healing.slugs(emails, sites), candidates)


def tagline(lines: Column, people: Column, firm: Column) -> Column:
    """The first word in capitals that isn't the firm's, or line with a cue; else the line below the firm."""

    def free(x: Column) -> Column:
        return (x != F.coalesce(firm, F.lit(""))) & ~F.exists(people, lambda p: p["name"] == x) & ~x.rlike(LED_BY_LABEL)

    def cue(x: Column) -> Column:
        single = x.rlike("^[A-Z]{3,15}$") & ~F.contains(F.coalesce(firm, F.lit("")), x) & ~is_contact(x)
        said = x.rlike(CUES) & ~x.rlike(universal.LOCATION) & ~x.rlike(universal.PIN) & F.length(x).between(6, 80)
        return free(x) & (single | said)

    below = F.filter(F.transform(lines, lambda x, i: F.when(F.contains(x, firm), F.get(lines, i + 1))), lambda x: x.isNotNull())
    after = F.when(F.length(first(below)).between(4, 45) & free(first(below)) & ~first(below).rlike(r"@|www\.|^[0-9+]"), first(below))
    return F.coalesce(first(F.filter(lines, cue)), after)


def offered(lines: Column, people: Column) -> Column:
    """What stands below a heading of services, behind bullets, in lists, or after words of praise; each once."""
    heading = F.array_position(F.transform(lines, lambda x: x.rlike(SECTION)), True)

    def plain(x: Column) -> Column:
        return ~is_contact(x) & ~x.rlike(universal.LOCATION)

    def of(x: Column, i: Column) -> Column:
        bare = F.trim(F.regexp_replace(x, BULLET, ""))
        parts = F.filter(F.transform(F.split(x, "[,|•■▪/]"), lambda p: F.trim(p)), lambda p: F.length(p).between(3, 40))
        listed = (F.size(parts) >= 2) & plain(x) & ~x.rlike(LED_BY_LABEL) & ~x.rlike(universal.PIN) & F.forall(parts, lambda p: ~is_contact(p) & ~F.exists(people, lambda q: F.lower(q["name"]) == F.lower(p)))
        items = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^[&\-–•*]\s*", ""))), lambda p: F.length(p) >= 3)
        praised = F.trim(found(x, OFFERED, 1))
        empty = F.array().cast("array<string>")
        own = F.concat(F.when(praised.isNotNull(), F.array(praised)).otherwise(empty), F.when(listed, F.transform(items, healing.title_cased)).otherwise(empty))
        below = (heading > 0) & (i + 1 > heading) & F.length(bare).between(2, 50) & plain(bare)
        return F.when(x.rlike(SECTION), empty).when(below, F.array(bare)).when(x.rlike(BULLET), F.when(F.length(bare).between(2, 50) & ~is_contact(bare), F.array(bare)).otherwise(empty)).otherwise(own)

    return F.array_distinct(F.flatten(F.transform(lines, of)))


def universal_cards(cards: DataFrame, vetoes: tuple[str, ...] = ()) -> DataFrame:
    """Cards (text) with the rules' fields, which always win, what the lines say, and how sure that is.

    Columns added: phones, landlines, emails, websites, gstin, pincode, company, tagline, services, persons,
    addresses and confidence (with needs_review and reasons). Null texts are empty cards.
    """
    known = universal.with_deterministic(cards.withColumn("text", F.coalesce("text", F.lit(""))))
    lines = F.filter(text_lines(healing.healed_text(indic_digits(F.col("text")))), lambda x: ~is_artifact(x))
    out = known.withColumn("_lines", lines).withColumn("_persons", persons(F.col("_lines"), vetoes))
    out = out.withColumns({
        "emails": healing.healed_emails(F.col("emails"), F.col("_lines")), "websites": healing.healed_sites(F.col("websites"), F.col("_lines")), "phones": F.array_union("phones", F.flatten(F.transform("_persons", lambda p: p["phones"]))),
        "addresses": universal.addresses(F.col("text")),
    })
    out = out.withColumn("company", company(F.col("_lines"), F.col("_persons"), F.col("emails"), F.col("websites")))
    out = out.withColumn("tagline", tagline(F.col("_lines"), F.col("_persons"), F.col("company"))).withColumn("services", offered(F.col("_lines"), F.col("_persons")))
    inside = lambda p: F.contains(F.lower(F.coalesce("company", F.lit(""))), F.lower(p["name"])) | F.contains(F.lower(F.coalesce("tagline", F.lit(""))), F.lower(p["name"]))
    out = out.withColumn("persons", F.filter("_persons", lambda p: ~inside(p)))
    card = {k: F.col(k) for k in ("company", "phones", "emails", "pincode", "gstin")}
    card |= {"persons": F.transform("persons", lambda p: F.struct(p["name"].alias("name"), p["role"].alias("role"))), "address_lines": F.transform("addresses", lambda a: a["address"])}
    return out.withColumn("confidence", universal.confidence(card)).drop("_lines", "_persons")
