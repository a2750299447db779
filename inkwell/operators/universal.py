"""The universal dialect: spans by stages, confidence, addresses by line."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions.exprs import bind, first, found
from inkwell.operators.lookup import first_place, text_lines

# Patterns of the stages, suffixes of company names, states, and rules for address lines.
EMAIL = r"\b([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)\b"
WEB = r"\b(?:https?://)?(?:www\.)?([a-zA-Z0-9-]+(?:\.[a-zA-Z]{2,})+(?:/[^\s]*)?)\b"
TAX = r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])\b"
ZERO_MOBILE = r"(?<!\d)0([6-9]\d{9})(?!\d)"
LAND = r"\b(0\d{2,4})[\s-](\d{6,8})\b"
MOBILE = r"(?:\+?91[\s-]?)?([6-9](?:[\s-]?\d){9})(?!\d)"
PIN = r"\b([1-8]\d{5})\b"
SUFFIXES = (
    "LTD", "PVT", "LIMITED", "INC", "CORP", "INDUSTRIES", "ENTERPRISES", "TRADERS", "SOLUTIONS", "SERVICES", "SYSTEMS", "TECHNOLOGIES",
    "MOTORS", "CLINIC", "HOSPITAL", "PHARMA", "AGENCY", "VENTURES", "LLP", "प्रा. लि.", "प्रा.लि.", "ट्रेडर्स", "उद्योग", "स्टील", "फर्निचर",
    "इलेक्ट्रॉनिक्स", "सेल्स", "MARKETING", "मार्केटिंग", "मार्केटींग", "CENTRE", "CENTER", "ACADEMY", "ASSOCIATES", "CONSULTANTS", "CONSULTANCY",
    "LEGAL", "ADVISORY", "ADVOCATE", "DEVELOPERS", "INFRA", "BUILDERS", "ENGINEERING", "MANUFACTURING", "MANAGEMENT",
)
STATES = (
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana", "Himachal Pradesh", "Jharkhand",
    "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur", "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan",
    "Sikkim", "Tamil Nadu", "Telangana", "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal", "Delhi", "Chandigarh", "Puducherry",
    "Jammu and Kashmir", "Ladakh",
)
LOCATION = r"(?i)रोड|रस्ता|मार्ग|चौक|नाका|फाटा|शेजारी|समोर|जवळ|मागे|ता\.|जि\.|तालुका|जिल्हा|मु\.|पो\.|गाव|नगर|पेठ|कॉलनी|वाडी|सोसायटी|अपार्टमेंट|कॉम्प्लेक्स|शॉप नं|दुकान नं|प्लॉट नं|पत्ता|पता|\b(?:Street|Road|Rd|Chowk|Square|Sq|Cross|Lane|Nagar|Colony|Layout|Sector|Plot|Shop|Bldg|Building|Opp|Near|Behind|Floor|Amsterdam|Netherland|India|Nagpur|Pune|Mumbai)\b"
STATUS_BAR = r"(?i)\d{1,2}:\d{2}|KB/s|MB/s|\d+%\b|VoLTE|4G|5G|LTE|Yo\s*\d+%"
BRANCH = r"(?i)^([A-Za-zऀ-ॿ\s,.-]+?)\s*\|\s*(?:(?:\+?91|0)[\s-]*)?([6-9]\d{4}[\s.-]?\d{5}|[6-9]\d{9}|0\d{2,4}[\s.-]?\d{6,8})"
PREFIXES = (
    (r"(?i)^(?:off(?:ice)?(?:\s*add)?|corporate\s*office|head\s*office|regd(?:\.?\s*office)?|कार्यालय|ऑफीस(?:\s*पत्ता)?|पत्ता|पता)\s*[:\-–|]", "head_office", "Office"),
    (r"(?i)^(?:res(?:idence)?(?:\s*add)?|home|house|निवास(?:\s*पत्ता)?|घर)\s*[:\-–|]", "residence", "Residence"),
    (r"(?i)^(?:works|factory|plant|कारखाना)\s*[:\-–|]", "factory", "Factory"),
    (r"(?i)^(?:chamber|clinic|dispensary|हॉस्पिटल|दवाखाना)\s*[:\-–|]", "chamber", "Chamber"),
    (r"(?i)^(?:branch(?:\s*office)?|शाखा)\s*[:\-–|]", "branch", "Branch"),
)
COUNTRY = r"(?i)^(India|Netherlands|USA|UK|UAE|Singapore)\s*[:\-]"
ADDRESS_CITIES = ("Mumbai", "Pune", "Nagpur", "Delhi", "Bengaluru", "Bangalore", "Hyderabad", "Chennai", "Kolkata", "Ahmedabad", "Surat", "Jaipur", "Lucknow", "Kanpur", "Amsterdam")

_INDIC = {zero + i: str(i) for zero in fixed.INDIC_ZEROS.values() for i in range(10)}
_BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def checked(code: str) -> bool:
    """Whether a tax id ends in its check character."""
    products = [_BASE36.index(c) * (1 + i % 2) for i, c in enumerate(code[:14])]
    return _BASE36[-sum(p // 36 + p % 36 for p in products) % 36] == code[14]


def normal(text: str) -> str:
    """NFC, no zero-width characters, Indic digits as ASCII."""
    return re.sub("[​-‍﻿]", "", unicodedata.normalize("NFC", text)).translate(_INDIC)


def deterministic(raw: str) -> dict:
    """Values by stages: a match counts if it overlaps nothing that an earlier one has claimed."""
    text = normal(raw)
    claimed: list[tuple[int, int]] = []

    def stage(pattern: str, take: Callable[[re.Match], object]) -> list:
        out = []
        for m in re.finditer(pattern, text, re.ASCII):
            if all(m.end() <= s or e <= m.start() for s, e in claimed) and (value := take(m)) is not None:
                claimed.append(m.span())
                out.append(value)
        return out

    emails = stage(EMAIL, lambda m: m[1])
    sites = stage(WEB, lambda m: m[0])
    taxes = stage(TAX, lambda m: m[1] if checked(m[1]) or "GST" in text[max(0, m.start() - 10) : m.start()].upper() else None)
    phones = stage(ZERO_MOBILE, lambda m: m[1])
    land = stage(LAND, lambda m: f"{m[1]}-{m[2]}")

    def mobile(m: re.Match) -> str | None:
        number = re.sub(r"\D", "", m[1])
        if number in phones:
            return None
        phones.append(number)
        return number

    stage(MOBILE, mobile)
    pins = stage(PIN, lambda m: m[1])
    pin = next((p for p in pins if re.match("4[0-4]", p)), pins[0] if pins else None)
    blank = list(text)
    for s, e in claimed:
        blank[s:e] = ["\n" if c == "\n" else " " for c in blank[s:e]]
    rest = re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+", " ", "".join(blank))).strip()
    return {"phones": phones, "landlines": land, "emails": emails, "websites": sites, "gstin": taxes[-1] if taxes else None, "pincode": pin, "residual": rest}


FIELDS = {"phones": "array<string>", "landlines": "array<string>", "emails": "array<string>", "websites": "array<string>", "gstin": "string", "pincode": "string", "residual": "string"}


def with_deterministic(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the fields of FIELDS, in Arrow batches; null texts are empty."""
    kinds = {k: pa.list_(pa.string()) if v.startswith("array") else pa.string() for k, v in FIELDS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [deterministic(t or "") for t in b[text].to_pylist()]
            for name, kind in kinds.items():
                b = b.append_column(name, pa.array([r[name] for r in rows], kind))
            yield b

    plain = df.drop(*(k for k in FIELDS if k != text))
    return plain.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), *(f"{k} {v}" for k, v in FIELDS.items())]))


def confidence(card: dict[str, Column]) -> Column:
    """(confidence, needs_review, reasons) of a card's columns: company, phones, emails, persons (name, role), address_lines, pincode, gstin."""
    company, persons = F.trim(F.coalesce(card["company"], F.lit(""))), F.coalesce(card["persons"], F.array().cast("array<struct<name:string,role:string>>"))
    n = {k: F.coalesce(F.greatest(F.size(card[k]), F.lit(0)), F.lit(0)) for k in ("phones", "emails", "address_lines")}
    upper = F.upper(company)
    suffix = F.lit(False)
    for s in SUFFIXES:
        suffix = suffix | upper.contains(s)
    named = F.length(company) >= 3
    person = first(F.filter(persons, lambda p: F.length(F.trim(p["name"])) >= 3))
    points = [
        F.when(named, 15 + F.when(suffix, 15).when(F.length(company) >= 6, 10).otherwise(0)).otherwise(0),
        F.when(n["phones"] > 1, 25).when(n["phones"] > 0, 20).otherwise(0), F.when(n["emails"] > 0, 10).otherwise(0),
        F.when(person.isNotNull(), 12 + F.when(F.length(F.trim(person["role"])) > 0, 8).otherwise(0)).otherwise(0), F.when(n["address_lines"] > 0, 8).otherwise(0),
        F.when(card["pincode"].rlike(r"^[1-9]\d{5}$"), 4).otherwise(0), F.when(card["gstin"].rlike(r"^\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"), 3).otherwise(0),
    ]
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.1), sum(points[1:], points[0]) / 100))
    reasons = F.filter(F.array(F.when(~named, "Company name is missing or ambiguous"), F.when(n["phones"] == 0, "No valid phone number detected"), F.when((F.size(persons) == 0) & (F.coalesce(card["company"], F.lit("")) == ""), "Neither person nor company identified with confidence")), lambda r: r.isNotNull())
    return F.struct(score.alias("confidence"), ((score < 0.75) | (F.size(reasons) >= 2)).alias("needs_review"), reasons.alias("reasons"))


def city_and_state(address: Column) -> Column:
    """(city, state) of an address; Delhi is a state of its own."""

    def both(a: Column) -> Column:
        city, state = first_place(a), first_place(a, STATES)
        return F.struct(F.coalesce(city, F.lit("")).alias("city"), F.coalesce(state, F.when(F.lower(city) == "delhi", F.lit("Delhi")), F.lit("")).alias("state"))

    return bind(F.coalesce(address, F.lit("")), both)


def addresses(text: Column) -> Column:
    """C11: (type, label, address, city, pincode, country, phone) of each line that holds an address."""

    def built(kind: Column, label: Column, address: Column, country: Column, phone: Column) -> Column:
        pin = found(address, PIN, 0)
        return F.struct(kind.alias("type"), label.alias("label"), address.alias("address"), first_place(address, ADDRESS_CITIES).alias("city"), pin.alias("pincode"), country.alias("country"), phone.alias("phone"))

    none = F.lit(None).cast("string")

    def of_line(line: Column) -> Column:
        branch = F.trim(F.regexp_extract(line, BRANCH, 1))
        part = F.trim(F.element_at(F.split(branch, r"[,\-]"), 1))
        out = F.when(line.rlike(BRANCH), built(F.lit("branch"), F.when(part != "", part).otherwise(F.lit("Branch")), branch, none, F.trim(F.regexp_extract(line, BRANCH, 2))))
        for pattern, kind, label in PREFIXES:
            out = out.when(line.rlike(pattern), built(F.lit(kind), F.lit(label), F.trim(F.regexp_replace(line, pattern, "")), none, none))
        place = (line.rlike(LOCATION) | line.rlike(r"^[1-8]\d{5}$")) & ~line.contains("@") & ~line.contains("www.") & ~(line.rlike(r"^[•▪*-]") & ~line.rlike(PIN) & ~line.rlike(LOCATION))
        country = F.regexp_extract(line, COUNTRY, 1)
        out = out.when(place & line.rlike(COUNTRY), built(F.lit("general"), country, F.trim(F.regexp_replace(line, COUNTRY, "")), country, none))
        return out.when(place & (F.length(line) >= 8), built(F.lit("general"), F.lit("Location"), line, none, none))

    lines = F.filter(text_lines(text), lambda x: ~x.rlike(STATUS_BAR))
    return F.filter(F.transform(lines, lambda x: of_line(x)), lambda a: a.isNotNull())
