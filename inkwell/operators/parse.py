"""A card's layout: company, services, persons, slogan, addresses and tagline.

What a line or block is, is worked out as columns (``kinds``). The choice between lines is greedy:
each detector leaves to the next what it didn't take, and an address grows from a line with a word of
place over its neighbours. That part runs over Arrow batches, one card at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.functions.exprs import bind, first, words
from inkwell.operators import contacts, lookup
from inkwell.operators.layout import BUSINESS_WORDS, COMPANY_WORDS, SLOGAN_WORDS, columns_of, company_score, has_company_word, is_invocation, is_numeric, is_slogan, salutation, services
from inkwell.operators.lines import BULLET, SECTION, is_address_fragment, is_goods_list, is_status_bar, is_title_case_name
from inkwell.operators.names import PLACES, ROLES, clean_address, has_name_shape, inline_person, place_words, role

# Words of repair and security trades.
SERVICE_WORDS = ("repairing", "refilling", "maintenance", "recovery", "installation", "networking", "biometric", "intercom", "cctv", "camera", "door lock", "amc", "attendance")

BOXED = "struct<text:string,left:int,top:int,right:int,bottom:int>"
BLOCK = f"struct<text:string,left:int,top:int,right:int,bottom:int,lines:array<{BOXED}>>"
PERSON = "struct<name:string,role:string>"
LAYOUT = f"struct<company:string,tagline:string,slogan:string,services:array<string>,persons:array<{PERSON}>,addresses:array<string>>"


def _any(text: Column, values: tuple[str, ...]) -> Column:
    return F.exists(words(values), lambda w: F.contains(text, w))


def kinds(text: Column, vetoes: tuple[str, ...] = (), roles: tuple[str, ...] = ROLES, places: tuple[str, ...] = PLACES) -> Column:
    """What a text is, as a struct of booleans and texts."""

    def found(t: Column) -> Column:
        """What takes a search of its own, once."""
        return F.struct(
            (F.size(contacts.phones(t)) > 0).alias("phone"), ((F.size(contacts.emails(t)) > 0) | (F.size(contacts.websites(t)) > 0)).alias("mail"), (F.size(contacts.gstins(t)) > 0).alias("gstin"),
            (F.size(contacts.pincodes(t)) > 0).alias("pin"), place_words(t, places).alias("places"), is_invocation(t).alias("prayer"), has_company_word(t).alias("firm"), is_slogan(t).alias("motto"),
        )

    def of(t: Column) -> Column:
        def told(k: Column) -> Column:
            lower = F.lower(t)
            bare = F.trim(F.regexp_replace(t, BULLET, ""))
            contact, place, address = k["phone"] | k["mail"] | k["gstin"], k["places"] > 0, (k["places"] >= 2) | k["pin"]
            held = {
                "text": t, "contact": contact, "phone": k["phone"], "mail": k["mail"], "gstin": k["gstin"], "pin": k["pin"], "prayer": k["prayer"], "firm": k["firm"], "firm_word": _any(F.upper(t), COMPANY_WORDS), "motto": k["motto"],
                "slogan_word": _any(lower, SLOGAN_WORDS), "trade_word": _any(lower, BUSINESS_WORDS), "goods": is_goods_list(t, place), "place": place, "address": address, "fragment": is_address_fragment(t), "title": is_title_case_name(t, vetoes),
                "name": has_name_shape(t, vetoes, roles) & ~(k["motto"] | contact | k["firm"] | k["prayer"] | place | address), "section": t.rlike(SECTION), "bullet": t.rlike(BULLET), "salutation": salutation(t).isNotNull(),
                "role": role(t, roles), "inline": inline_person(t, vetoes, roles), "numeric": is_numeric(t), "status": is_status_bar(t), "service_word": _any(lower, SERVICE_WORDS), "vetoed": _any(lower, vetoes) if vetoes else F.lit(False),
                "bare": bare, "offered": services(bare), "cleaned": clean_address(t), "bare_section": bare.rlike(SECTION),
            }
            return F.struct(*(v.alias(name) for name, v in held.items()))

        return bind(found(t), told)

    return bind(F.trim(F.coalesce(text, F.lit(""))), of)


def as_blocks(text: Column) -> Column:
    """A block of one line for each line of a text."""
    return F.transform(lookup.boxed_lines(text), lambda x: F.struct(x["text"].alias("text"), x["left"].alias("left"), x["top"].alias("top"), x["right"].alias("right"), x["bottom"].alias("bottom"), F.array(x.cast(BOXED)).alias("lines")))


def _with_kinds(cards: DataFrame, vetoes: tuple[str, ...], roles: tuple[str, ...], places: tuple[str, ...]) -> DataFrame:
    """cards with ``_blocks`` (box, score), ``_lines`` by top (box, block), ``_columns`` of these, and ``_kinds`` of the texts of both."""

    def box(x: Column) -> list[Column]:
        return [x[c].alias(c) for c in ("left", "top", "right", "bottom")]

    blocks = F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>"))
    flat = F.flatten(F.transform(blocks, lambda b, i: F.transform(b["lines"], lambda x: F.struct(x["text"].alias("text"), *box(x), i.alias("block")))))
    ordered = F.transform(F.array_sort(F.transform(flat, lambda x, i: F.struct(x["top"].alias("top"), i.alias("i"), x.alias("x")))), lambda z: z["x"])
    top, bottom = F.array_min(F.transform(blocks, lambda b: b["top"])), F.array_max(F.transform(blocks, lambda b: b["bottom"]))

    def scored(b: Column) -> Column:
        lines = F.coalesce(F.size(b["lines"]), F.lit(0))
        score = company_score(b["text"], F.greatest(b["bottom"] - b["top"], F.lit(0)), lines, b["top"], top, F.greatest(bottom, top + 1))
        return F.struct(*box(b), score.cast("int").alias("score"))

    out = cards.withColumn("_blocks", F.transform(blocks, scored)).withColumn("_ordered", ordered)
    # Blocks and lines in one array, so that the rules for texts stand in the plan once.
    texts = F.concat(F.transform(blocks, lambda b: b["text"]), F.transform("_ordered", lambda x: x["text"]))
    lines = F.transform("_ordered", lambda x: F.struct(*box(x), x["block"].alias("block")))
    return out.withColumns({"_kinds": F.transform(texts, lambda t: kinds(t, vetoes, roles, places)), "_lines": lines, "_columns": columns_of(F.col("_ordered"))}).drop("_ordered")


class Card:
    """The lines and blocks of a card, and the texts that are taken."""

    def __init__(self, blocks: list[dict], lines: list[dict], columns: list[int], told: list[dict]) -> None:
        self.blocks, self.lines, self.taken = blocks, lines, set()
        for x, kind in zip([*blocks, *lines], told, strict=True):
            x |= kind
        found: dict[int, list[dict]] = {}
        for line, column in zip(lines, columns or [], strict=True):
            found.setdefault(column, []).append(line)
        # Columns by the left edge of their first line.
        self.columns = sorted(found.values(), key=lambda c: c[0]["left"])

    def free(self, line: dict) -> bool:
        return line["text"] not in self.taken


def _clean(x: dict) -> bool:
    return not (x["prayer"] or x["contact"] or x["address"])


def company(card: Card) -> tuple[str | None, dict | None]:
    """The block that scores most of those that aren't prayers, addresses, lists or mere contacts; and its name."""

    def able(b: dict) -> bool:
        mere = (b["phone"] or b["mail"]) and not b["firm"]
        return bool(b["text"]) and not (b["prayer"] or b["address"] or b["goods"] or b["section"] or b["bullet"] or b["gstin"] or mere)

    best = max(filter(able, card.blocks), key=lambda b: b["score"], default=None)
    if best is None:
        return None, None
    own = [x for x in card.lines if card.blocks[x["block"]] is best]
    if len(own) > 1:
        plain = [x for x in own if _clean(x) and not (x["goods"] or x["text"].count(",") >= 2 or x["trade_word"] or x["slogan_word"] or x["vetoed"])]
        if 0 < len(plain) <= 2:
            return " ".join(x["text"] for x in plain), best
        firm = next((x for x in own if x["firm"]), None) or max(own, key=lambda x: x["bottom"] - x["top"])
        return firm["text"], best
    width, height = max(0, best["right"] - best["left"]), max(0, best["bottom"] - best["top"])

    def beside(b: dict) -> bool:
        return b is not best and _clean(b) and 3 <= len(b["text"]) <= 35

    def above(b: dict) -> bool:
        near = b["bottom"] <= best["top"] + 20 and best["top"] - b["bottom"] <= 1.5 * height and abs(b["left"] - best["left"]) <= width
        return beside(b) and near and not (b["firm"] or b["salutation"])

    before = next(filter(above, card.blocks), None)
    if before:
        return f"{before['text']} {best['text']}", best
    if best["text"].lower().endswith("'s"):
        after = next((b for b in card.blocks if beside(b) and b["top"] >= best["bottom"] - 20 and b["top"] - best["bottom"] <= 1.8 * height), None)
        if after:
            return f"{best['text']} {after['text']}", best
    return best["text"], best


def offered(card: Card) -> list[str]:
    """Parts of bulleted lines, lists, lines of a service trade, and short lines below a heading of services."""
    heading = next((x["bottom"] for x in card.lines if x["section"]), None)
    out: list[str] = []
    for x in card.lines:
        if not x["text"] or not card.free(x) or not _clean(x) or x["section"]:
            continue
        below = heading is not None and x["top"] >= heading - 10 and 3 <= len(x["text"]) <= 45
        if (x["bullet"] or below or x["goods"] or x["service_word"]) and len(x["bare"]) > 1 and not x["bare_section"]:
            out += x["offered"]
    return list(dict.fromkeys(out))


def persons(card: Card) -> list[dict]:
    """By column, lines with a salutation, with a role in them, beside a line of role, or in title case."""
    out: list[dict] = []
    seen: set[str] = set()

    def add(name: str, title: str | None) -> None:
        out.append({"name": name, "role": title})
        seen.add(name)

    for lines in card.columns:
        done: set[int] = set()

        def role_below(i: int, lines: list[dict] = lines, done: set[int] = done) -> str | None:
            if i + 1 < len(lines) and i + 1 not in done and lines[i + 1]["role"] is not None:
                done.add(i + 1)
                return lines[i + 1]["text"]
            return None

        for i, x in enumerate(lines):
            name = x["name"] and card.free(x)
            if i in done or not card.free(x) or x["contact"] or x["prayer"] or x["text"] in seen:
                continue
            if x["salutation"] and name:
                add(x["text"], role_below(i))
            elif x["inline"] is not None and x["inline"]["name"] not in seen:
                add(x["inline"]["name"], x["inline"]["role"])
            else:
                beside = [k for k in (i - 1, i + 1) if x["role"] is not None and 0 <= k < len(lines) and k not in done and lines[k]["name"] and card.free(lines[k]) and lines[k]["text"] not in seen]
                if beside:
                    add(lines[beside[0]]["text"], x["text"])
                    done.add(beside[0])
                elif x["title"] and name:
                    add(x["text"], role_below(i))
                else:
                    continue
            done.add(i)
    return out


def _quoted(t: str) -> bool:
    return t.startswith('"') and t.endswith('"') or t.startswith("“") and t.endswith("”")


def _trails_off(t: str) -> bool:
    return "..." in t or "…" in t


def slogan(card: Card) -> str | None:
    """The line that scores most as a slogan, if it is quoted, trails off or has a slogan's word."""

    def score(x: dict) -> int:
        return 8 * _trails_off(x["text"]) + 7 * _quoted(x["text"]) + 10 * x["slogan_word"] - 15 * x["place"] - 15 * x["pin"] - 6 * x["title"]

    able = [x for x in card.lines if card.free(x) and not x["prayer"] and not x["contact"] and 5 <= len(x["text"]) <= 150]
    best = max(able, key=score, default=None)
    if best and (_trails_off(best["text"]) or best["text"].startswith(('"', "“")) or best["slogan_word"]):
        return best["text"]
    return None


def addresses(card: Card) -> list[str]:
    """Each line with a word of place or a postal code, and the lines around it that go with it."""
    lines = [x for x in card.lines if x["text"] and card.free(x) and not (x["prayer"] or x["firm"] or x["fragment"] or x["mail"] or x["gstin"])]
    claimed: set[int] = set()
    out = []

    def seed(x: dict) -> bool:
        return x["place"] or x["pin"]

    def in_column(a: dict, b: dict) -> bool:
        widths = [max(0, x["right"] - x["left"]) for x in (a, b)]
        if min(widths) <= 40:
            return True
        least = max(1, min(widths))
        over = min(a["right"], b["right"]) - max(a["left"], b["left"])
        return over / least > 0.25 or abs((a["left"] + a["right"]) // 2 - (b["left"] + b["right"]) // 2) < 0.8 * least

    def goes_with(s: dict, x: dict, gap: int, up: bool) -> bool:
        other = x["status"] or x["contact"] or x["prayer"] or x["motto"] or x["firm"] or x["firm_word"] or x["goods"] or x["fragment"] or x["role"] is not None or up and x["salutation"]
        return not seed(x) and not other and len(x["text"]) > 3 and gap <= int(1.8 * max(12, s["bottom"] - s["top"])) and in_column(s, x)

    for i, s in enumerate(lines):
        if not seed(s) or i in claimed:
            continue
        first_of, last_of = i, i
        while first_of > 0 and first_of - 1 not in claimed and goes_with(s, lines[first_of - 1], s["top"] - lines[first_of - 1]["bottom"], True):
            first_of -= 1
        while last_of + 1 < len(lines) and last_of + 1 not in claimed and goes_with(s, lines[last_of + 1], lines[last_of + 1]["top"] - s["bottom"], False):
            last_of += 1
        claimed.update(range(first_of, last_of + 1))
        parts = [x["cleaned"] for x in lines[first_of : last_of + 1] if x["cleaned"].strip()]
        if parts:
            out.append(", ".join(parts))
    return out


def tagline(card: Card, block: dict | None, found: list[str]) -> str | None:
    """The line between company and address that says most of a trade, near to the company."""
    bottom = block["bottom"] if block else 0
    tops = [x["top"] for x in card.lines if any(a in x["text"] for a in found)]
    limit = min(tops) + 20 if tops else None

    def able(x: dict) -> bool:
        within = (not bottom or x["top"] >= bottom - 10) and (limit is None or x["bottom"] <= limit)
        return card.free(x) and 5 <= len(x["text"]) <= 120 and within and not (x["prayer"] or x["numeric"] or x["contact"] or x["place"] or x["pin"])

    def score(x: dict) -> int:
        near = max(0, x["top"] - bottom) // 25 if bottom > 0 else 0
        return 8 * x["trade_word"] + 5 * x["slogan_word"] + 2 * _trails_off(x["text"]) - 4 * (x["title"] and not x["trade_word"]) - near

    best = max(filter(able, card.lines), key=score, default=None)
    return best["text"] if best else None


def layout(blocks: list[dict], lines: list[dict], columns: list[int], told: list[dict]) -> dict:
    """All of a card; what one step takes, the next ones don't."""
    card = Card(blocks, lines, columns, told)
    name, block = company(card)
    if name is not None:
        card.taken |= {name.strip(), block["text"], *block["text"].split("\n"), *(w for w in name.split(" ") if len(w) > 2)}
        card.taken |= {x["text"] for x in card.lines if card.blocks[x["block"]] is block}
    out = {"company": name, "services": offered(card)}
    card.taken |= set(out["services"])
    for x in card.lines:
        if x["bullet"] or x["section"]:
            card.taken |= {x["text"], x["bare"]}
    out["persons"] = persons(card)
    for p in out["persons"]:
        card.taken |= {p["name"].strip(), (p["role"] or p["name"]).strip()}
    out["slogan"] = slogan(card)
    card.taken |= {out["slogan"] or ""}
    out["addresses"] = addresses(card)
    card.taken |= set(out["addresses"])
    out["tagline"] = tagline(card, block, out["addresses"]) or out["slogan"]
    return out


def with_layout(cards: DataFrame, vetoes: tuple[str, ...] = (), roles: tuple[str, ...] = ROLES, places: tuple[str, ...] = PLACES) -> DataFrame:
    """Cards (``blocks``: array of BLOCK) with ``layout``; vetoes are words that no person's name holds. Null or no blocks: an empty layout."""
    known = _with_kinds(cards, vetoes, roles, places)
    own = [c for c in known.columns if c not in ("_blocks", "_lines", "_columns", "_kinds")]
    schema = T.StructType([*(known.schema[c] for c in own), T.StructField("layout", T._parse_datatype_string(LAYOUT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [layout(*x) for x in zip(*(b[c].to_pylist() for c in ("_blocks", "_lines", "_columns", "_kinds")), strict=True)]
            kind = pa.struct([
                ("company", pa.string()), ("tagline", pa.string()), ("slogan", pa.string()), ("services", pa.list_(pa.string())),
                ("persons", pa.list_(pa.struct([("name", pa.string()), ("role", pa.string())]))), ("addresses", pa.list_(pa.string())),
            ])
            yield pa.RecordBatch.from_arrays([*(b[c] for c in own), pa.array(found, kind)], [*own, "layout"])

    return known.mapInArrow(run, schema)


def business_cards(cards: DataFrame, **parameters) -> DataFrame:
    """C8 before refinement: cards (text, blocks, which may be null or empty) with the fields of a business card.

    Page markers are left out; a card without blocks has one for each line of its text.
    """
    marker = r"(?i)^---+\s*Page\s*\d+\s*---+$"
    clean = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r"), lambda x: ~F.trim(x).rlike(marker)), "\n")
    given = cards.withColumn("text", clean)
    none = F.coalesce(F.size("blocks"), F.lit(0)) <= 0
    own = F.filter("blocks", lambda b: ~F.trim(b["text"]).rlike(marker))
    found = with_layout(given.withColumn("blocks", F.when(none, as_blocks(F.col("text"))).otherwise(own)), **parameters)
    fields = contacts.contact_fields(found)
    return fields.withColumns({
        "company": F.col("layout.company"), "tagline": F.col("layout.tagline"), "slogan": F.col("layout.slogan"), "services": F.col("layout.services"), "persons": F.col("layout.persons"),
        "addresses": F.col("layout.addresses"), "pincode": first(F.col("pincodes")), "gstin": first(F.col("gstins")),
    }).drop("layout", "pincodes", "gstins")
