"""Normalisation, similarity and money: scalar functions of columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import fixed
from inkwell.functions.exprs import bind, matches


def clean_ocr(text: Column) -> Column:
    """repairs of recognised addresses, in the order that they are listed."""
    pattern, put = fixed.AT_SIGNS
    start = F.regexp_replace(text, pattern, put)

    def close_up(t: Column) -> Column:
        parts = F.arrays_zip(F.split(t, fixed.SPACED_EMAIL, -1).alias("p"), matches(t, fixed.SPACED_EMAIL).alias("m"))
        joined = F.array_join(F.transform(parts, lambda x: F.concat(x["p"], F.coalesce(F.regexp_replace(x["m"], r"\s", ""), F.lit("")))), "")
        return F.when(t.contains("@") & t.rlike(fixed.SPACED_EMAIL), joined).otherwise(t)

    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), fixed.REPAIRS, bind(start, close_up))


def indic_digits(text: Column, scripts: tuple[str, ...] = tuple(fixed.INDIC_ZEROS)) -> Column:
    """digits of Indic scripts as ASCII digits."""
    return F.translate(text, "".join(chr(fixed.INDIC_ZEROS[s] + i) for s in scripts for i in range(10)), "0123456789" * len(scripts))


def devanagari_digits(text: Column) -> Column:
    return indic_digits(text, ("devanagari",))


def skeleton(text: Column) -> Column:
    """letters and digits without marks, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\p{M}", ""), r"[^\p{L}\p{N}]", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts, 0 for one."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def character_error(gold: Column, predicted: Column) -> Column:
    """edit distance over the gold length, 1 at most; an empty gold text is 0 against an empty one, else 1."""
    return F.when(F.length(gold) == 0, (F.length(predicted) > 0).cast("double")).otherwise(F.least(F.lit(1.0), F.levenshtein(gold, predicted) / F.length(gold)))


def clean_url(url: Column) -> Column:
    """F13"""
    return F.lower(F.regexp_replace(F.trim(url), r"[.,;:)\]>/]+$", ""))


def amount(text: Column) -> Column:
    """money without its signs as a double, null if that is no number."""
    return F.regexp_replace(text, r"[$₹€£\s,]", "").try_cast("double")


def half_up(x: Column, places: int = 2) -> Column:
    """Rounding that takes halves upwards."""
    return F.floor(x * 10**places + 0.5) / 10**places


def devanagari_count(text: Column) -> Column:
    """characters of the Devanagari blocks."""
    return F.length(F.regexp_replace(text, "[^ऀ-ॿ꣠-ꣿ]", ""))


def gstin_check(code: Column) -> Column:
    """whether a 15-character tax id ends in its check character (base 36, weights 1 and 2)."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def step(total: Column, i: Column) -> Column:
        product = (F.position(F.substr(code, i, F.lit(1)), F.lit(alphabet)) - 1) * (F.pmod(i + 1, F.lit(2)) + 1)
        return total + F.floor(product / 36).cast("int") + F.pmod(product, F.lit(36))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), step)
    return F.substr(F.lit(alphabet), F.pmod(36 - F.pmod(total, F.lit(36)), F.lit(36)) + 1, F.lit(1)) == F.substr(code, F.lit(15), F.lit(1))
