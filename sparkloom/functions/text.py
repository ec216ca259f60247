"""Text functions as Column expressions; nothing here needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, but for the line feed, as a Java character class.
INNER_SPACE = r"[\t\x0b\f\r \x1c-\x1f\x85   -     　]+"


def folded_text(text: Column) -> Column:
    """Lower case, one space for inner white space, ``0`` for each run of ASCII digits; line feeds stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), INNER_SPACE, " "), "[0-9]+", "0")


def folded_lines(text: Column) -> Column:
    """The lines of a text in the form in which they are compared, in order, blank ones kept as ``''``."""
    return F.split(F.trim(folded_text(text)), " ?\n ?")


def word_array(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def white_words(text: Column) -> Column:
    """The pieces between white space, as ``str.split()`` gives them."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def occurrences(text: Column, literal: str) -> Column:
    """How often ``literal`` stands in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast("int")


def host(url: Column) -> Column:
    """The authority of an address, in lower case; null for a null address."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
