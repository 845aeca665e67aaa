"""Text expressions. All are built-in functions on columns; arrays stay in their row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONJUNCTIONS, NOT_AUTHORS, PREPOSITIONS, PRONOUNS

HEADING = r"(?i)^\s*(references|bibliography|works cited|cited works|literature cited)\s*$"
ENTRY_START = r"^(\[\d+\]|[•–—-]|\d+\.)\s"
# White space as Python's str methods and Unicode patterns have it.
SPACE = r"[\s\x1C-\x1F]"
#: What SPACE matches with Unicode classes, for trimming.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SENTENCE_GAP = r"(?<=[.!?])\s+"
ALPHA = r"\p{L}+"
ANY_TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
PASSIVE = r"(?:^|[^\p{L}])(?:am|is|are|was|were|be|been|being|get|gets|got|gotten|getting)\s+(?:\p{L}+\s+)?\p{L}+(?:ed|en)(?:[^\p{L}]|$)"

# The language of citations. Author: surname, perhaps a second one, perhaps "et al."; white space is free
# between these, around the comma and the semicolon, and before a narrative year's bracket, but not inside brackets' edges.
SURNAME = r"[A-Z][A-Za-z'’`-]+"
YEAR = r"(?:19|20)\d{2}"
AUTHOR = rf"{SURNAME}(?:{SPACE}+(?:and|&){SPACE}+{SURNAME})?(?:{SPACE}+et{SPACE}+al\.?)?"
CITE = rf"{AUTHOR}{SPACE}*,{SPACE}*{YEAR}"
PARENTHETICAL = rf"(?U)\({CITE}(?:{SPACE}*;{SPACE}*{CITE})*\)"
NARRATIVE = rf"(?U)(?<![(\w]){AUTHOR}{SPACE}*\({YEAR}\)"


def strip(text) -> Column:
    return F.trim(text, F.lit(SPACES))


def clean(text) -> Column:
    """Joins words broken over lines, then collapses white space."""
    joined = F.regexp_replace(F.regexp_replace(text, r"-[ \t]*\n[ \t]*", ""), rf"(?U)-{SPACE}+", "")
    return strip(F.regexp_replace(joined, rf"(?U){SPACE}+", " "))


def words(text) -> Column:
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def word_count(text) -> Column:
    return F.size(words(text))


def alpha_words(text) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(ALPHA), F.lit(0))


def sentences(text) -> Column:
    return F.filter(F.split(text, SENTENCE_GAP), lambda s: s != "")


def token_count(text) -> Column:
    return F.regexp_count(text, F.lit(ANY_TOKEN))


def fingerprint(text) -> Column:
    return F.lower(strip(F.substring(text, 1, 60)))


def is_heading(text) -> Column:
    return F.col(text).rlike(HEADING)


def starts_entry(text) -> Column:
    return F.col(text).rlike(ENTRY_START)


def share_of(array, members: tuple[str, ...], total) -> Column:
    return F.size(F.filter(array, lambda w: w.isin(*members))) / F.greatest(total, F.lit(1))


def pos_ratios(array, total) -> dict[str, Column]:
    return {"pronoun_ratio": share_of(array, PRONOUNS, total), "preposition_ratio": share_of(array, PREPOSITIONS, total), "conjunction_ratio": share_of(array, CONJUNCTIONS, total)}


def parenthetical(text) -> Column:
    return F.regexp_extract_all(text, F.lit(PARENTHETICAL), F.lit(0))


def narrative(text) -> Column:
    return F.regexp_extract_all(text, F.lit(NARRATIVE), F.lit(0))


def true_citations(array) -> Column:
    return F.filter(array, lambda c: ~F.lower(F.regexp_extract(c, "[A-Za-z]+", 0)).isin(*NOT_AUTHORS))


def citations(text) -> Column:
    """Parenthetical ones with their repeats, then narrative ones not listed yet."""
    own = true_citations(parenthetical(text))
    return F.concat(own, F.filter(F.array_distinct(true_citations(narrative(text))), lambda c: ~F.array_contains(own, c)))


def years(array, low: int = 1900, high: int = 2030) -> Column:
    found = F.flatten(F.transform(array, lambda c: F.regexp_extract_all(c, F.lit(YEAR), F.lit(0))))
    return F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: (y >= low) & (y <= high))


def severity(difference) -> Column:
    return F.when(difference > 20, "high").when(difference > 10, "medium").otherwise("low")


def cluster_label(cluster) -> Column:
    return F.when(cluster == -1, "ANOMALY").otherwise(F.concat(F.lit("Author "), (cluster + 1).cast("string")))


def feature_title(name) -> Column:
    return F.replace(F.replace(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit("Pct"), F.lit("%")), F.lit("Avg"), F.lit("Avg."))


def file_size(size) -> Column:
    kb, mb = size / 1024.0, size / (1024.0 * 1024.0)
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def snippet(text) -> Column:
    return F.concat(F.substring(text, 1, 300), F.lit("..."))
