"""Two recognition passes of a page into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions.text import devanagari_count
from inkwell.operators.contacts import phones
from inkwell.operators.lines import is_garbled, is_status_bar

BLOCK = "struct<text:string,left:int,top:int,right:int,bottom:int>"
OVERLAP = 0.3


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, 0 without a union."""
    width = F.greatest(F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]), F.lit(0)).cast("bigint")
    height = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0))

    def area(x: Column) -> Column:
        return F.greatest(x["right"] - x["left"], F.lit(0)).cast("bigint") * F.greatest(x["bottom"] - x["top"], F.lit(0))

    union = area(a) + area(b) - width * height
    return F.when(union > 0, width * height / union).otherwise(F.lit(0.0))


def fused_blocks(latin: Column, deva: Column) -> Column:
    """Each Latin block takes the free Devanagari block that it overlaps most; the one richer in
    Devanagari stays if they overlap enough. Blocks that none took follow; all are sorted by top.
    """
    none = F.array().cast(f"array<{BLOCK}>")
    a, b = F.coalesce(latin, none), F.coalesce(deva, none)

    def step(acc: Column, x: Column) -> Column:
        scored = F.transform(acc["free"], lambda y, i: F.struct(iou(x, y).alias("s"), (-i).alias("i"), y.alias("y")))
        best = F.array_max(F.filter(scored, lambda z: z["s"] > OVERLAP))
        kept = F.when(best.isNotNull() & (devanagari_count(best["y"]["text"]) > devanagari_count(x["text"])), best["y"]).otherwise(x)
        free = F.filter(acc["free"], lambda y, i: best.isNull() | (i != -best["i"]))
        return F.struct(F.concat(acc["out"], F.array(kept)).alias("out"), free.alias("free"))

    greedy = F.aggregate(a, F.struct(none.alias("out"), b.alias("free")), step, lambda acc: F.concat(acc["out"], acc["free"]))
    ordered = F.transform(F.array_sort(F.transform(greedy, lambda x, i: F.struct(x["top"].alias("top"), i.alias("i"), x.alias("x")))), lambda z: z["x"])
    return F.when(F.size(b) == 0, a).when(F.size(a) == 0, b).otherwise(ordered)


def fused_text(latin: Column, deva: Column) -> Column:
    """All lines of the Devanagari pass, then the Latin ones that aren't noise, say something Latin can, and aren't there already."""

    def lines(c: Column) -> Column:
        return F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")

    def says(x: Column) -> Column:
        worded = F.forall(F.split(x, r"\s+"), lambda w: (F.length(w) > 1) & w.rlike(r"^[\p{L}.]+$"))
        return F.contains(x, F.lit("@")) | x.rlike("(?i)www\\.|http") | x.rlike(fixed.GSTIN) | (F.size(phones(x)) > 0) | worded

    own = lines(deva)
    good = F.filter(lines(latin), lambda x: ~is_status_bar(x) & ~is_garbled(x) & says(x))
    return F.when(F.trim(latin) == "", deva).when(F.trim(deva) == "", latin).otherwise(F.array_join(F.array_union(own, good), "\n"))


def fuse_pages(pages: DataFrame) -> DataFrame:
    """pages (latin_blocks, deva_blocks, latin_text, deva_text) with ``blocks`` and ``raw_text``."""
    return pages.withColumns({"blocks": fused_blocks(F.col("latin_blocks"), F.col("deva_blocks")), "raw_text": fused_text(F.coalesce("latin_text", F.lit("")), F.coalesce("deva_text", F.lit("")))})
