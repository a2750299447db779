"""Lookups and gazetteers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.exprs import bind, first, words
from inkwell.functions.text import similarity, skeleton

# Script families and the languages that each serves; anything else is devanagari.
SCRIPTS = {
    "devanagari": ("mr", "marathi", "hi", "hindi", "ne", "nepali", "sa", "sanskrit", "kok", "konkani", "bho", "bhojpuri", "devanagari"),
    "latin": ("en", "english", "es", "spanish", "fr", "french", "de", "german", "it", "italian", "pt", "portuguese", "nl", "dutch", "id", "indonesian", "ms", "malay", "tr", "turkish", "vi", "vietnamese", "pl", "polish", "sv", "swedish", "latin"),
    "ch": ("zh", "cn", "chinese", "ja", "japanese", "japan", "ch"),
    "korean": ("ko", "korean"),
    "arabic": ("ar", "arabic", "fa", "persian", "ur", "urdu"),
    "cyrillic": ("ru", "russian", "uk", "ukrainian", "be", "belarusian", "bg", "bulgarian", "sr", "serbian", "cyrillic", "eslav"),
    "tamil": ("ta", "tamil"),
    "telugu": ("te", "telugu"),
    "thai": ("th", "thai"),
    "greek": ("el", "greek"),
}
# Cities, in the order that a scan tries them.
CITIES = (
    "Mumbai", "Delhi", "Bangalore", "Bengaluru", "Hyderabad", "Ahmedabad", "Chennai", "Kolkata", "Surat", "Pune", "Jaipur", "Lucknow",
    "Kanpur", "Nagpur", "Indore", "Thane", "Bhopal", "Visakhapatnam", "Pimpri-Chinchwad", "Patna", "Vadodara", "Ghaziabad", "Ludhiana",
    "Agra", "Nashik", "Faridabad", "Meerut", "Rajkot", "Varanasi", "Srinagar", "Aurangabad", "Dhanbad", "Amritsar", "Navi Mumbai",
    "Allahabad", "Prayagraj", "Howrah", "Ranchi", "Gwalior", "Jabalpur", "Coimbatore", "Vijayawada", "Jodhpur", "Madurai", "Raipur",
    "Kota", "Guwahati", "Chandigarh", "Solapur", "Hubli", "Dharwad", "Bareilly", "Mysore", "Tiruchirappalli", "Gurgaon", "Gurugram",
    "Noida", "Dehradun", "Jalandhar", "Udaipur", "Jammu", "Mangalore",
)

# White space between tokens, and the punctuation around them.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
PUNCTUATION = ".,;:-()[]"


def script_family(language: Column) -> Column:
    """J14"""
    clean = F.lower(F.trim(language))
    out = F.lit("devanagari")
    for script, names in SCRIPTS.items():
        out = F.when(clean.isin(*names), F.lit(script)).otherwise(out)
    return out


def first_place(text: Column, places: tuple[str, ...] = CITIES) -> Column:
    """The first place of the list that stands in the text as a word."""
    return first(F.filter(words(places), lambda p: F.rlike(text, F.concat(F.lit(r"(?i)\b"), F.replace(p, F.lit("-"), F.lit(r"\-")), F.lit(r"\b")))))


def snap(value: Column, vocabulary: tuple[str, ...], threshold: float) -> Column:
    """The vocabulary's first most similar word, the value itself below the threshold."""

    def nearest(v: Column) -> Column:
        scored = F.transform(words(vocabulary), lambda w: F.struct(similarity(v, skeleton(w)).alias("s"), w.alias("w")))
        return F.reduce(scored, F.struct(F.lit(-1.0).alias("s"), F.lit(None).cast("string").alias("w")), lambda a, x: F.when(x["s"] > a["s"], x).otherwise(a))

    return bind(bind(skeleton(value), nearest), lambda b: F.when(b["s"] >= threshold, b["w"]).otherwise(value))


def aliased(text: Column, aliases: dict[str, str]) -> Column:
    """F8: aliases put in place one after another, wherever they stand."""
    return reduce(lambda t, a: F.replace(t, F.lit(a[0]), F.lit(a[1])), aliases.items(), text)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def apply_aliases(text: Column, aliases: dict[str, str]) -> Column:
    """Tokens that are an alias but for the punctuation around them, joined by single spaces."""
    table = F.create_map(*(F.lit(x) for a in aliases.items() if a[1] for x in a))

    def put(token: Column) -> Column:
        core = F.btrim(token, F.lit(PUNCTUATION))
        return F.coalesce(F.replace(token, core, F.try_element_at(table, core)), token)

    return F.array_join(F.transform(_tokens(text), put) if any(aliases.values()) else _tokens(text), " ")


def snap_tokens(text: Column, vocabulary: tuple[str, ...], aliases: dict[str, str], threshold: float = 0.78) -> Column:
    """Aliases, then each token snapped on its own."""
    return F.array_join(F.transform(_tokens(apply_aliases(text, aliases)), lambda t: snap(t, vocabulary, threshold)), " ")


def text_lines(text: Column) -> Column:
    """Trimmed lines, without blank ones and page markers."""
    return F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^-+\s*(?i:page)\s*\d+\s*-+$"))


def boxed_lines(text: Column) -> Column:
    """A text's lines as boxes below each other."""
    return F.transform(text_lines(text), lambda x, i: F.struct(x.alias("text"), F.lit(20).alias("left"), (40 * i).alias("top"), F.lit(600).alias("right"), (40 * i + 30).alias("bottom")))


def primary_pages(pages: DataFrame) -> DataFrame:
    """Of each doc_id the page that scores most; of equal scores the first. pages has doc_id, page_no and score."""
    return pages.groupBy("doc_id").agg(F.max_by(F.struct(*pages.columns), F.struct("score", -F.col("page_no"))).alias("p")).select("p.*")
