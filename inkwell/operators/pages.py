"""Pages before recognition, and recognised pages as JSON: columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.exprs import first
from inkwell.functions.text import half_up

#: Sides of a rendered page that are aimed at, and the side from which on an image is made smaller.
RENDERED, LARGEST = 2400, 2048
# Degrees by the orientation that an image's data gives.
ROTATIONS = {6: 90, 3: 180, 8: 270}
SCHEMES = ("file", "content")

BOX = "struct<left:int,top:int,right:int,bottom:int>"
OCR = f"struct<rawText:string,blocks:array<struct<text:string,boundingBox:{BOX},lines:array<struct<text:string,boundingBox:{BOX}>>>>>"


def checked_uri(uri: Column) -> Column:
    """The address of a page; any scheme but file and content is an error, a null one stays null."""
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(uri.isNull() | scheme.isin(*SCHEMES), uri).otherwise(F.raise_error(F.concat(F.lit("unsupported scheme of "), uri)))


def is_pdf(mime: Column, uri: Column) -> Column:
    """By type, else by name."""
    path = F.regexp_replace(uri, r"[?#].*$", "")
    return F.coalesce(F.lower(mime).contains("pdf"), F.lit(False)) | F.coalesce(F.lower(path).endswith(".pdf"), F.lit(False))


def pdf_pages(documents: DataFrame, sizes: str = "sizes") -> DataFrame:
    """A row for each page of an array of sizes (width, height): page_no from 1, scale, and the size to render."""
    out = documents.select(*(c for c in documents.columns if c != sizes), F.posexplode(sizes).alias("page_no", "_size"))
    scale = F.greatest(F.lit(2.0), F.least(F.lit(3.5), RENDERED / F.greatest("_size.width", "_size.height")))
    out = out.withColumns({"page_no": F.col("page_no") + 1, "scale": scale})
    return out.withColumns({"width": F.floor(F.col("_size.width") * F.col("scale")).cast("int"), "height": F.floor(F.col("_size.height") * F.col("scale")).cast("int")}).drop("_size")


def sample_size(width: Column, height: Column) -> Column:
    """The largest power of two by which the longer side stays at LARGEST or more; 1 for smaller or unknown ones."""
    times = F.floor(F.greatest(width, height) / LARGEST)
    return F.when((width > 0) & (height > 0) & (times > 1), F.pow(F.lit(2), F.length(F.bin(times)) - 1).cast("int")).otherwise(1)


def rotation(orientation: Column) -> Column:
    """S7"""
    out = F.lit(0)
    for value, degrees in ROTATIONS.items():
        out = F.when(orientation == value, degrees).otherwise(out)
    return out


def code_of(codes: Column) -> Column:
    """Of an array of (value, format), the first QR code's value, else the first one's; null without codes."""
    return F.coalesce(first(F.filter(codes, lambda c: c["format"] == "QR_CODE")), first(codes))["value"]


def read_ocr(text: Column) -> Column:
    """A recognised page from JSON: blocks with text, box and lines; what is missing is empty or zero."""

    def flat(x: Column) -> list[Column]:
        return [F.coalesce(x["text"], F.lit("")).alias("text"), *(F.coalesce(x["boundingBox"][c], F.lit(0)).alias(c) for c in ("left", "top", "right", "bottom"))]

    parsed = F.from_json(text, OCR)
    none = F.array().cast("array<struct<text:string,left:int,top:int,right:int,bottom:int>>")
    blocks = F.transform(F.filter(parsed["blocks"], lambda b: b.isNotNull()), lambda b: F.struct(*flat(b), F.coalesce(F.transform(F.filter(b["lines"], lambda x: x.isNotNull()), lambda x: F.struct(*flat(x))), none).alias("lines")))
    return F.struct(F.coalesce(parsed["rawText"], F.lit("")).alias("text"), F.coalesce(blocks, F.array().cast("array<struct<text:string,left:int,top:int,right:int,bottom:int,lines:array<struct<text:string,left:int,top:int,right:int,bottom:int>>>>")).alias("blocks"))


def written(*columns: str) -> Column:
    """A row's columns as JSON, nulls written out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def download(done: Column, total: Column, before: Column, seconds: Column) -> Column:
    """(done_mb, total_mb, percent, speed, left_s) of a download: speed in MB a second once half a second has gone by with news."""
    mb = float(1 << 20)
    speed = F.when((seconds >= 0.5) & (done > before), half_up((done - before) / mb / seconds, 1))
    left = F.when(speed > 0, F.floor(F.greatest(total - done, F.lit(0)) / (speed * mb) + 0.5).cast("bigint"))
    return F.struct(half_up(done / mb, 1).alias("done_mb"), half_up(total / mb, 1).alias("total_mb"), half_up(100 * done / F.nullif(total, F.lit(0)), 1).alias("percent"), speed.alias("speed"), left.alias("left_s"))
