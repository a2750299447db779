"""Card or bill."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions import fixed


def _pattern(word: str) -> str:
    return r"(?i)(?:^|[^\p{L}\p{N}])" + re.sub(r"([.#-])", r"\\\1", word) + r"(?:$|[^\p{L}\p{N}])"


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words stand in the text, apart from letters and digits."""
    total = F.lit(0)
    for word in words:
        total = total + (text.contains(word) & text.rlike(_pattern(word))).cast("int")
    return total


def document_type(text: Column) -> Column:
    """'bill' or 'card': a strong word makes a bill, or two general ones and more than a card has."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    bill = hits(upper, fixed.BILL_WORDS)
    return F.when(hits(upper, fixed.STRONG_BILL_WORDS) > 0, F.lit("bill")).when((bill >= 2) & (bill > hits(upper, fixed.CARD_WORDS)), F.lit("bill")).otherwise(F.lit("card"))


def routed_type(text: Column) -> Column:
    """The one-pattern rule for several pages."""
    rule = r"(?i)invoice|bill\s*(?:#|no|number)|tax\s*invoice|subtotal|amount\s*due|due\s*date|line\s*items"
    return F.when(F.coalesce(text, F.lit("")).rlike(rule), F.lit("bill")).otherwise(F.lit("card"))
