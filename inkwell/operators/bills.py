"""Bills: fields of the text, and tables rebuilt from boxes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions.exprs import bind, first, found, last, matches, words
from inkwell.functions.text import amount

LINES = "array<struct<text:string,left:int,top:int,right:int,bottom:int>>"
ITEMS = "array<struct<description:string,code:string,billed:double,paid:double,responsibility:double>>"


def document_type(text: Column) -> Column:
    return bind(F.upper(text), lambda t: first(F.filter(words(fixed.DOCUMENT_TYPES), lambda w: F.contains(t, w))))


def invoice_number(text: Column) -> Column:
    return first(F.filter(F.transform(matches(text, fixed.INVOICE_NUMBER, 1), lambda x: F.trim(x)), lambda x: ~F.upper(x).isin(*fixed.NOT_A_NUMBER)))


def invoice_date(text: Column) -> Column:
    return F.coalesce(F.trim(found(text, fixed.INVOICE_DATE, 1)), found(text, r"\b(" + fixed.NUMERIC_DATE + r")\b", 0))


def due_date(text: Column) -> Column:
    return F.trim(found(text, fixed.DUE_DATE, 1))


def subtotal(text: Column) -> Column:
    return amount(found(text, fixed.SUBTOTAL, 1))


def amount_due(text: Column) -> Column:
    """The last of them."""
    return amount(last(matches(text, fixed.AMOUNT_DUE, 1)))


def bill_fields(df: DataFrame, text: str = "text") -> DataFrame:
    c = F.col(text)
    return df.withColumns({"document_type": document_type(c), "invoice_number": invoice_number(c), "invoice_date": invoice_date(c), "due_date": due_date(c), "subtotal": subtotal(c), "amount_due": amount_due(c)})


def issuer(blocks: Column) -> Column:
    """The first line of the tallest block in the top 35 % that names neither a document type nor a contact.

    blocks: array of (text, left, top, right, bottom).
    """
    top = F.array_min(F.transform(blocks, lambda b: b["top"]))
    bottom = F.array_max(F.transform(blocks, lambda b: b["bottom"]))
    vetoed = r"(?i)" + "|".join([*fixed.DOCUMENT_TYPES, "INVOICE", "PHONE", "EMAIL", "GSTIN"])
    near = F.filter(blocks, lambda b: (b["top"] <= top + (bottom - top) * 0.35) & (F.trim(b["text"]) != "") & ~b["text"].rlike(vetoed))
    height = F.array_max(F.transform(near, lambda b: F.greatest(b["bottom"] - b["top"], F.lit(0))))
    return first(F.transform(F.filter(near, lambda b: F.greatest(b["bottom"] - b["top"], F.lit(0)) == height), lambda b: F.trim(F.element_at(F.split(b["text"], "\n"), 1))))


def _number(text: str) -> float | None:
    kept = "".join(c for c in text if c not in "$₹€£," and not c.isspace())
    try:
        return float(kept) if kept and "_" not in kept else None
    except ValueError:
        return None


def _rows(lines: list[dict]) -> list[list[dict]]:
    """Lines by rows: each joins the first row whose first line has its middle within 0.7 of the taller height."""
    rows: list[tuple[int, int, list[dict]]] = []
    for line in sorted((x for x in lines if x["text"].strip()), key=lambda x: x["top"]):
        middle, height = int((line["top"] + line["bottom"]) / 2), max(10, line["bottom"] - line["top"])
        for at, tall, cells in rows:
            if abs(middle - at) < 0.7 * max(height, tall):
                cells.append(line)
                break
        else:
            rows.append((middle, height, [line]))
    return [sorted(cells, key=lambda x: x["left"]) for _, _, cells in rows]


def _item(parts: list[str], code: str | None, money: dict[str, float]) -> dict | None:
    text = " ".join(parts).strip()
    if not text and "billed" not in money:
        return None
    return {"description": text or "Item", "code": code, **{k: money.get(k) for k in ("billed", "paid", "responsibility")}}


def line_items(lines: list[dict]) -> list[dict]:
    """The items of a page's lines: cells fall to the nearest heading, down to the first summary row."""
    rows = _rows(lines)
    joined = [" ".join(c["text"] for c in r).strip().upper() for r in rows]
    head = next((i for i, t in enumerate(joined) if sum(w in t for w in fixed.HEADER_WORDS) >= 2), None)
    out = []
    if head is None:
        for row, text in zip(rows, joined, strict=True):
            if not text.startswith(fixed.SUMMARY_WORDS):
                values = [_number(c["text"].strip()) for c in row]
                at = next((i for i, v in enumerate(values) if v is not None), None)
                out.append(_item([c["text"].strip() for i, c in enumerate(row) if i != at], None, {} if at is None else {"billed": values[at]}))
        return [x for x in out if x]
    columns = {"description": (0, 300)}
    for cell in rows[head]:
        kind = next((k for k, ws in fixed.COLUMN_WORDS if any(w in cell["text"].upper() for w in ws)), None)
        if kind:
            columns[kind] = (cell["left"], cell["right"])

    def near(cell: dict, kind: str) -> bool:
        if columns.get(kind, (-1, -1))[0] == -1:
            return False
        left, right = columns[kind]
        return abs(int((cell["left"] + cell["right"]) / 2) - int((left + right) / 2)) < 0.9 * max(40, right - left)

    for row, text in zip(rows[head + 1 :], joined[head + 1 :], strict=True):
        if text.startswith(fixed.SUMMARY_WORDS) or "TOTAL:" in text or "DUE:" in text:
            break
        parts, code, money = [], None, {}
        for cell in row:
            own, value = cell["text"].strip(), _number(cell["text"].strip())
            kind = "code" if near(cell, "code") else next((k for k in ("billed", "paid", "responsibility") if value is not None and near(cell, k)), None)
            if kind == "code":
                code = own
            elif kind:
                money[kind] = value
            elif value is None:
                parts.append(own)
            elif "billed" not in money and cell["left"] > columns["description"][1]:
                money["billed"] = value
        out.append(_item(parts, code, money))
    return [x for x in out if x]


def with_line_items(pages: DataFrame, lines: str = "lines") -> DataFrame:
    """pages with ``items``; lines: array of (text, left, top, right, bottom). Rows stay where they are; nothing is shuffled."""
    kind = pa.list_(pa.struct([("description", pa.string()), ("code", pa.string()), ("billed", pa.float64()), ("paid", pa.float64()), ("responsibility", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("items", pa.array([line_items(x or []) for x in b[lines].to_pylist()], kind))

    plain = pages.drop("items")
    return plain.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), f"items {ITEMS}"]))


def merge_pages(pages: DataFrame) -> DataFrame:
    """One bill of a doc_id's pages: first strings, last amounts, all items in page order."""
    order = [F.struct("page_no", "document_type", "invoice_number", "invoice_date", "due_date", "subtotal", "amount_due", "items")]
    one = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(*order)).alias("p"))
    strings = ("document_type", "invoice_number", "invoice_date", "due_date")
    out = [first(F.filter(F.col(f"p.{c}"), lambda v: F.trim(v) != "")).alias(c) for c in strings]
    money = [last(F.filter(F.col(f"p.{c}"), lambda v: v.isNotNull())).alias(c) for c in ("subtotal", "amount_due")]
    return one.select("doc_id", *out, *money, F.flatten(F.col("p.items")).alias("items"))


# Kinds of bills and known issuers by what a text holds, in the order that they are tried, and patterns of fields.
FALLBACK_TYPES = (
    (r"(?i)GOOD\s*FAITH\s*ESTIMATE", "GOOD FAITH ESTIMATE"), (r"(?i)TAX\s*INVOICE", "TAX INVOICE"),
    (r"(?i)HEALTH\s*INSURANCE|MEDICAL\s*CLAIM|\bClaim\s*#|Your\s*Health\s*Plan|HIGHMARK", "HEALTH INSURANCE CLAIM"), (r"(?i)\bBILL\b", "BILL"), (r"(?i)INVOICE", "INVOICE"),
)
FALLBACK_ISSUERS = (
    (r"(?i)Southwestern\s*Vermont\s*Medical\s*Center", "Southwestern Vermont Medical Center"), (r"(?i)ABC\s*Gastroenterology", "ABC Gastroenterology Associates / XYZ Endoscopy Center"),
    (r"(?i)HIGHMARK|COPLEY\s*HOSPITAL", "HIGHMARK / COPLEY HOSPITAL"),
)
NO_ISSUER = r"(?i)good faith|estimate|invoice|bill|tax|procedure|billed"
FALLBACK_NUMBER = r"(?i)(?:Invoice\s*#?|INV|Claim\s*#|Patient\s*ID)[:\s]*([A-Za-z0-9\-]+)"
FALLBACK_DATE = r"(?i)(?:Invoice\s*Date|Date\s*\(s\)\s*of\s*Service|Print\s*Date|Date\s*of\s*Birth)[:\s]*([A-Za-z0-9\/\, ]+?)(?=\s+(?:Due|Total|Member|Provider|\$|\n)|$)"
FALLBACK_DUE = r"(?i)(?:Due\s*Date|Pay\s*By)[:\s]*([A-Za-z0-9\/\, ]+?)(?=\s+(?:Total|Amount|\$|\n)|$)"
FALLBACK_AMOUNT = r"(?i)(?:AMOUNT\s*DUE|TOTAL\s*DUE|Amount\s*Owed|Your\s*Responsibility|TOTALS?)[:\s]*\$?\s*([0-9,]+\.[0-9]{2}|[0-9,]+)"
FALLBACK_SUBTOTAL = r"(?i)(?:Subtotal|Total\s*Estimated\s*Cost|Provider\s*Charges)[:\s]*\$?\s*([0-9,]+\.[0-9]{2}|[0-9,]+)"


def fallback_fields(text: Column, known: dict[str, Column] | None = None) -> dict[str, Column]:
    """document_type, issuer, invoice_number, invoice_date, due_date, subtotal and amount_due: those known, else by patterns over all lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.array_join(lines, " ")

    def by(rules: tuple[tuple[str, str], ...], otherwise: Column) -> Column:
        out = otherwise
        for pattern, value in reversed(rules):
            out = F.when(whole.rlike(pattern), F.lit(value)).otherwise(out)
        return out

    def money(pattern: str) -> Column:
        return F.regexp_replace(found(whole, pattern, 1), ",", "").try_cast("double")

    none = F.lit(None).cast("string")
    own = {
        "document_type": by(FALLBACK_TYPES, none), "issuer": by(FALLBACK_ISSUERS, first(F.filter(lines, lambda x: (F.length(x) > 3) & ~x.rlike(NO_ISSUER)))), "invoice_number": F.trim(found(whole, FALLBACK_NUMBER, 1)),
        "invoice_date": F.trim(found(whole, FALLBACK_DATE, 1)), "due_date": F.trim(found(whole, FALLBACK_DUE, 1)), "subtotal": money(FALLBACK_SUBTOTAL), "amount_due": money(FALLBACK_AMOUNT),
    }
    return {k: F.coalesce(known[k], v) if known and k in known else v for k, v in own.items()}
