"""Contact fields in the offline dialect: spans in Arrow batches, repairs as columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.operators import lookup
from inkwell.operators.universal import checked, normal

# Patterns of the offline dialect, in the order that they are tried.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
URL = r"\b(?:https?://|www\.)[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?:/\S*)?|\b[A-Za-z0-9\-]+\.(?:com|in|co\.in|net|org|shop|store|business)\b"
GSTIN = r"\b(\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z][A-Z0-9])\b"
ZERO_MOBILE = r"(?<!\d)0([6-9]\d{9})(?!\d)"
LANDLINE = r"\b(0\d{2,4})[\s\-]?(\d{6,8})\b"
MOBILE = r"(?:(?:\+?91|0)[\s\-]?)?([6-9](?:[\s\-]?\d){9})\b"
PINCODE = r"\b([1-9]\d{5})\b"
# Words of an address, and labels of phones and of other fields.
ADDRESS_WORDS = (
    "पत्ता", "चौक", "नगर", "पेठ", "रोड", "मार्ग", "गल्ली", "वाडी", "कॉलनी", "सोसायटी", "बिल्डिंग", "कॉम्प्लेक्स", "दुकान", "गाळा", "मजला", "जिल्हा", "Road", "Street",
    "Colony", "Nagar", "Layout", "Extension", "Block", "Phase", "Sector", "Plot", "Flat", "Floor", "Building", "Complex", "Main", "Cross", "Bypass",
    "Highway", "Market", "मार्केट", "बाजार", "मुहल्ला", "સોસાયટી", "રોડ", "தெரு", "நகர்", "రోడ్", "నగర్",
)
PHONE_LABELS = (
    "mob", "mobile", "cell", "ph", "phone", "tel", "contact", "मो", "मो.", "मोबा.", "मोबाईल", "भ्रमणध्वनी", "दूरध्वनी", "फोन", "संपर्क", "ફોન", "મોબાઇલ", "போன்",
    "தொலைபேசி", "ఫోన్", "మొబైల్", "ಫೋನ್", "ಮೊಬೈಲ್", "ফোন", "মোবাইল", "ഫോൺ", "മൊബൈൽ",
)
OTHER_LABELS = (
    "address", "addr", "add", "office", "पत्ता", "पत्ता:", "पता", "पता:", "कार्यालय", "સરનામું", "முகவரி", "அலுவலகம்", "చిరునామా", "కార్యాలయం", "ವಿಳಾಸ", "ঠিকানা",
    "വിലാസം", "email", "e-mail", "mail", "ई-मेल", "ईमेल", "இமெயில்", "gstin", "gst", "gst no", "gst no.", "gst number", "pan", "pan no", "pan no.",
    "pan number",
)
LABELS = frozenset(PHONE_LABELS + OTHER_LABELS)
PHONE_LABEL = re.compile("(?i)" + "|".join(map(re.escape, PHONE_LABELS)))


def tidy(text: str) -> str:
    """F3, runs of blanks as one, no empty lines, lines trimmed."""
    text = re.sub(r"\n{2,}", "\n", re.sub(r"[ \t\u00a0]+", " ", normal(text)))
    return "\n".join(map(str.strip, text.split("\n"))).strip()


def fields(raw: str, places: Iterable[str] = lookup.CITIES, valid_pincodes: frozenset[str] | None = None) -> dict:
    """values by stages, each match beside what earlier stages have claimed; and what is left of the text."""
    text = tidy(raw)
    claimed: list[tuple[int, int]] = []

    def free(m: re.Match, by_start: bool) -> bool:
        end = m.start() + 1 if by_start else m.end()
        return all(end <= s or e <= m.start() for s, e in claimed)

    def stage(pattern: str, take: Callable[[re.Match], str | None], rule: Callable[[re.Match], bool]) -> list[str]:
        out = []
        for m in re.finditer(pattern, text):
            if rule(m) and (value := take(m)) is not None:
                out.append(value)
                claimed.append(m.span())
        return list(dict.fromkeys(out))

    anywhere, outside, apart = (lambda m: True), (lambda m: free(m, True)), (lambda m: free(m, False))
    emails = stage(EMAIL, lambda m: m[0].lower(), anywhere)
    sites = stage(URL, lambda m: m[0].lower().rstrip(".,;"), outside)
    taxes = stage(GSTIN, lambda m: m[1] if checked(m[1]) else None, anywhere)
    phones = stage(ZERO_MOBILE, lambda m: m[1], anywhere)
    land = stage(LANDLINE, lambda m: f"{m[1]}-{m[2]}", outside)
    phones += stage(MOBILE, lambda m: re.sub(r"\D", "", m[1]), apart)
    pin = pincode(text, [m for m in re.finditer(PINCODE, text) if apart(m) and (not valid_pincodes or m[1] in valid_pincodes)], (*ADDRESS_WORDS, *places))
    if pin:
        claimed.append(pin.span())
    left = list(text)
    for s, e in claimed:
        left[s:e] = ["\n" if c == "\n" else " " for c in left[s:e]]
    lines = (re.sub(r"\s{2,}", " ", x).strip(" .:-|•■▪▸►") for x in "".join(left).split("\n"))
    rest = [x for x in lines if x.casefold() not in LABELS and re.search(r"[^\W_]", x)]
    return {"phones": list(dict.fromkeys(phones)), "landlines": land, "emails": emails, "websites": sites, "gstin": taxes[-1] if taxes else None, "pincode": pin[1] if pin else None, "residual": "\n".join(rest)}


def pincode(text: str, candidates: list[re.Match], places: tuple[str, ...]) -> re.Match | None:
    """The code whose line has most words of place (a hyphen before the code counts as one); of equal ones the last.

    A line without any counts only among the last two and without a phone's label.
    """

    def scored(m: re.Match) -> tuple[int, int] | None:
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        line = text[start : end if end >= 0 else len(text)]
        score = sum(p in line for p in places) + bool(re.search(r"[-–]\s*$", text[start : m.start()]))
        last = text.count("\n", m.end()) <= 1 and not PHONE_LABEL.search(line)
        return (score, m.start()) if score or last else None

    able = [(s, m) for m in candidates if (s := scored(m)) is not None]
    return max(able, key=lambda x: x[0])[1] if able else None


KINDS = {"phones": "array<string>", "landlines": "array<string>", "emails": "array<string>", "websites": "array<string>", "gstin": "string", "pincode": "string", "residual": "string"}


def with_fields(df: DataFrame, text: str = "text", places: tuple[str, ...] = lookup.CITIES, valid_pincodes: Iterable[str] | None = None) -> DataFrame:
    """df with the fields of KINDS; null texts are empty. valid_pincodes (J10) is a whitelist of postal codes."""
    allowed = frozenset(valid_pincodes) if valid_pincodes else None
    kinds = {k: pa.list_(pa.string()) if v.startswith("array") else pa.string() for k, v in KINDS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [fields(t or "", places, allowed) for t in b[text].to_pylist()]
            for name, kind in kinds.items():
                b = b.append_column(name, pa.array([r[name] for r in rows], kind))
            yield b

    plain = df.drop(*(k for k in KINDS if k != text))
    return plain.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), *(f"{k} {v}" for k, v in KINDS.items())]))


def repaired(card: dict[str, Column], suffixes: tuple[str, ...], roles: tuple[str, ...], places: tuple[str, ...], aliases: dict[str, str]) -> dict[str, Column]:
    """A model's company, persons and address_lines, snapped to what is known of firms, roles and places."""
    return card | {
        "company": lookup.snap_tokens(card["company"], suffixes, aliases, 0.80),
        "persons": F.transform(card["persons"], lambda p: F.struct(p["name"].alias("name"), lookup.snap(p["role"], roles, 0.70).alias("role"))),
        "address_lines": F.transform(card["address_lines"], lambda x: lookup.snap_tokens(x, places, aliases, 0.78)),
    }


def merged(df: DataFrame, rules: str, model: str) -> DataFrame:
    """Df with a struct ``merged`` of the rules' fields, which always win, and what only a model gives."""
    none = F.array().cast("array<string>")
    own = [F.col(f"{rules}.{c}").alias(c) for c in ("phones", "landlines", "emails", "websites", "gstin", "pincode")]
    persons = F.coalesce(F.col(f"{model}.persons"), F.array().cast("array<struct<name:string,role:string>>")).alias("persons")
    given = [F.col(f"{model}.company").alias("company"), F.col(f"{model}.tagline").alias("tagline"), F.coalesce(F.col(f"{model}.services"), none).alias("services"), persons, F.coalesce(F.col(f"{model}.address_lines"), none).alias("address_lines")]
    return df.withColumn("merged", F.struct(*given, *own))
