"""Kinds of lines: columns of booleans; null texts are no kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.exprs import words
from inkwell.functions.text import devanagari_count
from inkwell.operators.layout import BUSINESS_WORDS, COMPANY_WORDS, SLOGAN_WORDS, has_company_word

# Patterns that tell lines apart, and words of goods.
SECTION = r"(?i)^\s*(?:our\s+)?(?:services|products|offerings|specialities|solutions|deals\s+in|we\s+offer|facilities|amenities)(?:\s*[:\-–])?\s*$"
BULLET = r"^[>►•▪*\-✔✓+→▶]+\s*|^[0-9]+[\.\)]\s+"
AUDIENCE = r"(?i)^\s*(?:(?:only\s+)?(?:ladies|women|gents|men|kids|boys|girls|children)(?:\s+only)?|(?:for\s+)?(?:ladies|women|gents|men|kids)(?:\s+only)?|(?:ladies|women)\s*(?:&|and)\s*(?:gents|men|kids)|all\s+types\s+of|specialists?\s+in|exclusive\s+showroom|wholesale\s*(?:&|and)?\s*retail)\s*$"
CONTACT = r"(?i)@|www\.|https?:|\b[6-9]\d{9}\b|\b0\d{2,4}[\s-]\d{6,8}\b|\b(?:mob|tel|phone|fax|email)\b"
FRAGMENT = r"(?i)\.com|\.in|\.org|\.net|@|www\.|http|^(?:e-?mail|mail)|gmail|gnal|yahoo|outlook|fnol"
STATUS_BAR = r"(?i)\d{1,2}:\d{2}.*(?:KB/s|MB/s|\d+%)|\d+\s*(?:KB|MB)/s|\b(?:VoLTE|4G|5G|LTE)\b|KB/s"
GOODS = (
    "box", "boxes", "mcb", "fan box", "junction box", "modular box", "concealed box", "spares", "parts", "fittings", "pipes", "valves",
    "cables", "wires", "switches", "switchgears", "hardware", "tools", "motors", "pumps", "appliances", "equipment", "accessories",
    "goods", "items", "stationery", "garments", "textiles", "fabrics", "सोफासेट", "सोफा", "कपाट", "टेबल", "फ्रिज", "कुलर", "भांडी",
    "वस्तु", "सामग्री", "होलसेल", "ऑईल चेंज", "टायर",
)
SCRIPTED = r"[ऀ-ॿa-zA-Z0-9؀-ۿЀ-ӿ一-鿿஀-௿ఀ-౿]"
LEADS = r"^(?:dealing in|dealers of|dealers in|all types of|all kinds of|manufacturers of|mfg\. of|services:|products:|आमच्याकडे|येथे)|मिळतील|मिळेल"
ENDS = r"(?:etc\.?|and more|इत्यादी|आदी)$"
JOINED = r"अॅन्ड| & | and |सोल्युशन्स|solutions|ltd$"
APP = r"^(?:download|scan|get it|app)|राशि|राशी|कुंडली|graha"


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _has(text: Column, values: tuple[str, ...]) -> Column:
    return F.exists(words(values), lambda w: F.contains(text, F.lower(w)))


def is_section(text: Column) -> Column:
    return _no(text.rlike(SECTION))


def is_contact(text: Column) -> Column:
    """P8"""
    return _no(text.rlike(CONTACT))


def is_address_fragment(text: Column) -> Column:
    """A piece of an e-mail address or a site, damaged ones too."""
    return _no(text.rlike(FRAGMENT))


def is_status_bar(text: Column) -> Column:
    """P17"""
    return _no(text.rlike(STATUS_BAR))


def is_garbled(text: Column) -> Column:
    """More than two odd symbols, or one of currency or markup in more than eight characters."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N} .@\-_/,:()\[\]]", ""))
    return _no((odd > 2) | ((F.length(text) > 8) & text.rlike(r"[€$#%^*+=~`|<>]")))


def is_catalogue(text: Column) -> Column:
    """A bulleted line without a postal code or a word of place."""
    return _no(text.rlike(r"^[•■▪★*✓✔\-–]\s*") & ~text.rlike(r"\b[1-8]\d{5}\b") & ~text.rlike(r"(?i)रोड|रस्ता|चौक|नगर|Street|Road|Chowk"))


def is_goods_list(text: Column, place: Column | None = None) -> Column:
    """An offer, a list that goes on, or two commas and a word of goods; never a place (a column that says so) or a firm."""
    lower = F.lower(F.trim(text))
    commas = F.length(lower) - F.length(F.replace(lower, F.lit(","), F.lit("")))
    offered = (lower.rlike(ENDS) & (commas >= 1)) | lower.rlike(LEADS) | ((commas >= 2) & _has(lower, GOODS))
    return _no(offered & ~lower.rlike(JOINED) & ~(place if place is not None else F.lit(False)))


def is_title_case_name(text: Column, vetoes: tuple[str, ...] = ()) -> Column:
    """Two to four words that begin with a capital, at least two of them of two letters, and no word of a firm or a slogan."""
    t = F.trim(text)
    lower = F.lower(t)
    parts = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    titled = F.forall(parts, lambda w: F.regexp_replace(w, r"\.+$", "").rlike(r"^\p{Lu}.{0,19}$") & (F.length(F.regexp_replace(w, "[^0-9]", "")) <= 1))
    lettered = F.size(F.filter(parts, lambda w: F.length(F.regexp_replace(w, r"\P{L}", "")) >= 2)) >= 2
    plain = ~t.rlike(BULLET) & ~t.rlike(SECTION) & ~t.rlike(AUDIENCE) & ~t.rlike(r"[,…/@#%&*(){}<>]|\.\.\.") & ~lower.rlike(APP) & (F.length(F.regexp_replace(t, "[^0-9]", "")) <= 2)
    vetoed = _has(lower, SLOGAN_WORDS) | _has(lower, BUSINESS_WORDS) | _has(lower, COMPANY_WORDS) | has_company_word(t)
    if vetoes:
        vetoed = vetoed | _has(lower, vetoes)
    return _no(F.size(parts).between(2, 4) & titled & lettered & plain & ~vetoed)


def is_text_line(text: Column, confidence: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Characters of a known script, and neither a short doubtful one nor a large square (a logo)."""
    t = F.trim(text)
    area = width.cast("double") * height / F.nullif(page_width.cast("double") * page_height, F.lit(0.0))
    logo = (area > 0.15) & (width / F.greatest(height, F.lit(1))).between(0.80, 1.25) & (F.length(t) < 10)
    return _no(t.rlike(SCRIPTED) & ~((confidence < 0.32) & (F.length(t) <= 4)) & ~F.coalesce(logo, F.lit(False)))


def wants_devanagari(text: Column) -> Column:
    """whether a page should be read again for Devanagari, by the first rule that fits."""
    t = F.trim(F.coalesce(text, F.lit("")))
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    local = t.rlike(r"\b[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b|\+91|(?i:GSTIN|Chowk|Nagar|Road)")
    out = F.when(t == "", True).when(devanagari_count(t) > 0, True).when(local, True).when(t.rlike(r"(?i)@|https?://|\.com|\.in|\.org|\.net"), False).when(letters >= 30, False)
    out = out.when((F.length(t) <= 10) & (letters < 5) & ~t.rlike("[0-9]"), True)
    return out.when((letters < 0.35 * F.length(t)) & F.length(t).between(10, 40) & ~t.rlike("[0-9]"), True).otherwise(False)


def devanagari_is_better(latin: Column, deva: Column) -> Column:
    """whether the Devanagari pass found more of its script, or a text where there was hardly one."""
    n = devanagari_count(deva)
    return _no(((n > 0) & (n >= devanagari_count(latin))) | ((F.length(F.trim(latin)) < 15) & (F.length(F.trim(deva)) >= 15)))
