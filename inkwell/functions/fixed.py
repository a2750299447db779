"""Patterns, word lists and constants that results depend on, in the order that rules try them."""

EMAIL = r"(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
GSTIN = r"\b[0-9]{2}[a-zA-Z]{5}[0-9]{4}[a-zA-Z]{1}[1-9a-zA-Z]{1}[zZ][0-9a-zA-Z]{1}\b"
MOBILE = r"(?<!\d)(?:(?:\+91|91|0)[\s.-]*)?([6-9](?:[\s.-]?\d){9})(?!\d)"
LANDLINE = r"(?<!\d)(0\d{1,4}[\s.-]?[1-9]\d{5,7})(?!\d)"
INTERNATIONAL = r"\+(?!91\b)([1-9]\d{0,2})[\s.-]?(?:\(\d{1,4}\)[\s.-]?)?(?:\d[\s.-]?){6,14}\d(?:[ ]?(?:ext|x|extn)\.?[\s.-]?\d{1,5})?"
SLASH_PAIR = r"(?:(?:\+91|91|0)[\s.-]?)?[6-9]\d{4}[\s.-]?\d{5}\s*/\s*(\d{5})(?!\s*\d)"
PIN = r"(?<!\d)[1-9][0-9]{2}[\s-]?[0-9]{3}(?!\d)"
URL = r"(?i)(?:https?://|www\.)[a-zA-Z0-9.-]+(?:\.[a-zA-Z]{2,})+(?:/[^\s,;)\]]*)?"
TLDS = (
    "com", "in", r"co\.in", "org", "net", "io", "ai", "biz", "info", "tech", "online", "store", "co", "edu", "gov", "app", "dev", "me",
    "us", "uk", "ca", "au", "sg", "ae", "de", "fr", "jp", "cn", "global", "studio", "agency", "solutions", "cloud", "digital", "services",
    "group", "institute", "foundation", "ventures", "media", "news", "health", "care", "finance", "consulting", "design", "build", "works",
    "systems", "software", "int", "mobi", "name", "pro", "travel", "jobs", "museum", "coop", "aero", "mil", r"gov\.in", r"ac\.in",
    r"nic\.in", r"res\.in", r"edu\.in", r"gov\.uk", r"co\.uk", r"org\.uk",
)
DOMAIN = r"(?i)\b[a-zA-Z0-9][a-zA-Z0-9.-]*\.(?:" + "|".join(TLDS) + r")(?:/[^\s,;)\]]*)?\b"
SPACED_EMAIL = r"(?i)(?:[a-zA-Z0-9][\s]{1,2}){2,}@(?:[a-zA-Z0-9][\s]{0,2}){2,}\.[a-zA-Z]{2,}"

#: Repairs of recognised text, before and after spaced-out addresses are closed up.
AT_SIGNS = (r"([a-zA-Z0-9._%+\-])(?:©|®|\(c\)|\(C\))([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})", "$1@$2")
#: What an @ is, or is taken for; the second as a pattern, before a domain.
SIGNS = ("@", "©", "®", "(c)", "(C)")
SIGN_LIKE = r"(?i)(?:fd|cl|\(a\)|\[a\])[a-zA-Z0-9.-]+\.(?:com|in|co\.in|org|net|io|ai|xyz|gov|edu)\b"
REPAIRS = (
    (r"(?i)@(gmai[1l]|gma1l|gmaii|gmall)\.com", "@gmail.com"),
    (r"(?i)@(hotmai[1l]|hotma1l)\.com", "@hotmail.com"),
    (r"(?i)@(out1ook|outl00k)\.com", "@outlook.com"),
    (r"(?i)@(yah00|yaho0|yah0o)\.com", "@yahoo.com"),
    (r"(?i)@(red1ffmail|rediffmai1)\.com", "@rediffmail.com"),
    (r"(?i)\b([a-zA-Z0-9._%+\-]{3,})(?:fd|cl|\(a\)|\[a\])([a-zA-Z0-9.-]+\.(?:com|in|co\.in|org|net|io|ai|xyz|gov|edu))\b", "$1@$2"),
    (r"(?i)([a-zA-Z0-9._%+\-]+)\s*@\s*([a-zA-Z0-9.\-]+)\s*\.\s*([a-zA-Z]{2,})", "$1@$2.$3"),
)

#: Labels of phone numbers by what their line holds; the first counts. Brackets override them.
PHONE_LABELS = (
    (r"(?i)\b(?:off(?:ice)?|दुकान|कार्यालय)\b", "Office"),
    (r"(?i)\b(?:res(?:idence|id)?|घर)\b", "Residence"),
    (r"(?i)\b(?:whats?app|wa)\b", "WhatsApp"),
    (r"(?i)\b(?:mob(?:ile)?|cell|m\.?\s*no|मो(?:बाईल)?)\b", "Mobile"),
    (r"(?i)\b(?:tel(?:ephone)?|landline|ph(?:one)?|फोन)\b", "Landline"),
)
BRACKET_LABELS = ((r"(?i)\(off\)", "Office"), (r"(?i)\(res\)", "Residence"), (r"(?i)\(wa\)", "WhatsApp"))

STRONG_BILL_WORDS = (
    "INVOICE", "TAX INVOICE", "BILL OF SUPPLY", "MEDICAL CLAIM", "CLAIM #", "CLAIM NO", "CLAIM NUMBER", "AMOUNT DUE", "SUBTOTAL", "SUB TOTAL",
    "TOTAL DUE", "GRAND TOTAL", "BALANCE DUE", "PAYMENT DUE", "TOTAL PAYABLE", "TOTALS", "TOTAL AMOUNT", "GOOD FAITH ESTIMATE",
    "TOTAL ESTIMATED COST", "AMOUNT OWED",
)
BILL_WORDS = (
    "BILL", "RECEIPT", "STATEMENT", "CHARGES", "BILLED", "PROCEDURE", "PATIENT", "INSURANCE", "CLAIM", "CGST", "SGST", "IGST", "DUE DATE",
    "TAXABLE", "INVOICE DATE", "BILL DATE", "QTY", "RATE", "UNIT PRICE", "COPAY", "CO-PAY", "DEDUCTIBLE", "ESTIMATE", "ESTIMATED",
    "HOSPITAL COST", "INSURANCE COST",
)
CARD_WORDS = (
    "CEO", "FOUNDER", "CO-FOUNDER", "DIRECTOR", "PROPRIETOR", "PROP.", "MANAGING DIRECTOR", "CHAIRMAN", "CONSULTANT", "PARTNER",
    "डायरेक्टर", "संचालक", "संस्थापक", "मालक", "प्रोप्राईटर",
)

DOCUMENT_TYPES = (
    "GOOD FAITH ESTIMATE", "ESTIMATE", "TAX INVOICE", "COMMERCIAL INVOICE", "PROFORMA INVOICE", "INVOICE", "BILL OF SUPPLY", "MEDICAL CLAIM",
    "HEALTH INSURANCE CLAIM", "HOSPITAL BILL", "CASH RECEIPT", "RECEIPT", "BILL",
)
HEADER_WORDS = (
    "PROCEDURE", "DESCRIPTION", "PARTICULARS", "ITEM", "SERVICE", "DETAILS", "CODE", "CPT", "HSN", "SAC", "BILLED", "CHARGES", "AMOUNT",
    "RATE", "PRICE", "QTY", "QUANTITY", "TOTAL", "INSURANCE", "PAID", "DISCOUNT", "PATIENT", "RESPONSIBILITY", "NET",
)
SUMMARY_WORDS = (
    "TOTAL", "SUBTOTAL", "SUB TOTAL", "AMOUNT DUE", "TOTAL DUE", "GRAND TOTAL", "NET AMOUNT", "BALANCE DUE", "TAX", "GST", "CGST", "SGST",
    "IGST", "AMOUNT OWED", "TOTAL OWED",
)
#: Columns of a bill's table by words of their headings; the first kind that fits counts.
COLUMN_WORDS = (
    ("description", ("PROCEDURE", "DESCRIPTION", "ITEM", "PARTICULARS")),
    ("code", ("CODE", "CPT", "HSN")),
    ("billed", ("BILLED", "CHARGES", "AMOUNT", "RATE", "PRICE")),
    ("paid", ("PAID", "INSURANCE")),
    ("responsibility", ("PATIENT", "RESPONSIBILITY", "NET")),
)
INVOICE_NUMBER = r"(?i)(?:invoice|inv|bill|receipt|claim|memo|estimate)\s*(?:(?:no|#|num|number)[.:\s-]*|[:#-])\s*([A-Za-z0-9][A-Za-z0-9\/-]{2,25})"
NOT_A_NUMBER = ("DATE", "TOTAL", "AMOUNT", "DUE", "INVOICE")
NUMERIC_DATE = r"\d{1,2}[\/.-]\d{1,2}[\/.-]\d{2,4}|\d{4}[\/.-]\d{1,2}[\/.-]\d{1,2}"
ANY_DATE = NUMERIC_DATE + r"|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4}"
INVOICE_DATE = r"(?i)(?:invoice\s*date|bill\s*date|dated|date)[:\s]*(" + ANY_DATE + ")"
DUE_DATE = r"(?i)(?:due\s*date|payment\s*due|pay\s*by|due)[:\s]*(" + ANY_DATE + ")"
MONEY = r"[:\s]*[$₹€£]?\s*([0-9]{1,3}(?:,[0-9]{2,3})*(?:\.[0-9]{1,2})?)"
SUBTOTAL = r"(?i)(?:sub\s*total|taxable\s*value|taxable\s*amount|subtotal|estimated\s*cost|total\s*estimated\s*cost)" + MONEY
AMOUNT_DUE = r"(?i)(?:amount\s*due|total\s*amount|total\s*due|net\s*amount|grand\s*total|balance\s*due|total\s*payable|total\s*charges|balance|totals?|amount\s*owed|total\s*owed|patient\s*responsibility|you\s*owe)" + MONEY

#: First characters of the scripts' digit blocks; each block runs from 0 to 9.
INDIC_ZEROS = {
    "devanagari": 0x0966, "bengali": 0x09E6, "gurmukhi": 0x0A66, "gujarati": 0x0AE6, "oriya": 0x0B66, "tamil": 0x0BE6, "telugu": 0x0C66,
    "kannada": 0x0CE6, "malayalam": 0x0D66, "thai": 0x0E50, "lao": 0x0ED0, "myanmar": 0x1040, "khmer": 0x17E0, "shan": 0x1090,
    "saurashtra": 0xA8D0, "kayah": 0xA900, "ol chiki": 0x1C50, "limbu": 0x1946, "new tai lue": 0x19D0,
}

#: Stages of an extraction job, in order, with the progress that each reports.
JOB_STAGES = (("preprocess", 18), ("classify", 38), ("extract", 62), ("validate", 82), ("flag_review", 92), ("finalize", 98))
