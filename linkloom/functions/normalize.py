"""Normalization and tokenizers. Null counts as empty; no function returns null.

Three families of text are kept apart, as results depend on which one an operator uses: basic (lower case, trimmed),
ascii (everything but a-z and 0-9 separates) and canonical (NFKC, Unicode letters kept, legal suffixes and address
abbreviations known).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of legal suffixes, address abbreviations and country aliases.
LEGAL_SUFFIXES = (
    "private limited", "pvt ltd", "public limited company", "plc", "limited liability company",
    "limited liability partnership", "llp", "llc", "incorporated", "inc", "corporation", "corp", "company", "co",
    "limited", "ltd", "gmbh", "ag", "kg", "sarl", "srl", "spa", "bv", "nv", "sa", "pty ltd", "pty",
)
ADDRESS_WORDS = {
    "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "rd": "road", "blvd": "boulevard", "dr": "drive",
    "ln": "lane", "ct": "court", "pl": "place", "sq": "square", "apt": "apartment", "ste": "suite", "fl": "floor",
    "bldg": "building", "hwy": "highway", "pkwy": "parkway", "ter": "terrace", "n": "north", "s": "south", "e": "east",
    "w": "west", "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest", "mt": "mount",
    "ft": "fort", "jn": "junction", "nr": "near", "opp": "opposite",
}
COUNTRY_ALIASES = {
    "us": "US", "u.s.": "US", "u.s.a.": "US", "usa": "US", "united states": "US", "united states of america": "US",
    "in": "IN", "india": "IN", "bharat": "IN", "fr": "FR", "france": "FR",
    "uk": "GB", "u.k.": "GB", "united kingdom": "GB", "great britain": "GB", "de": "DE", "germany": "DE", "deutschland": "DE",
}

#: Letters, digits and the underscore as Unicode has them, without combining marks; white space as Unicode has it.
_WORDS = r"\p{L}\p{N}_"
_BLANK = r"\p{IsWhite_Space}\x1c-\x1f"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{_BLANK}]+", " "))


def basic(c: Column) -> Column:
    """Lower case, trimmed, `&` as `and`; punctuation and inner spaces stay."""
    return F.replace(F.regexp_replace(F.lower(text(c)), f"^[{_BLANK}]+|[{_BLANK}]+$", ""), F.lit("&"), F.lit("and"))


def ascii_text(c: Column) -> Column:
    """Lower case with every run of anything but a-z and 0-9 as one space; `a&b` is `aandb`."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text(c)), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))


def first_number(c: Column) -> Column:
    """The first house number of a normalized address, `12` or `12b`; empty if it has none."""
    return F.regexp_extract(text(c), r"\b\d+[a-z]?\b", 0)


def first_number_unicode(c: Column) -> Column:
    return F.regexp_extract(text(c), rf"(?<![{_WORDS}])\p{{Nd}}+[a-z]?(?![{_WORDS}])", 0)


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark lacks."""
    return values.map(lambda v: unicodedata.normalize("NFKC", v) if v else "")


@F.pandas_udf(T.StringType())
def title(values: pd.Series) -> pd.Series:
    """Upper case after anything but a letter; initcap knows only spaces."""
    return values.map(lambda v: v.title() if v else "")


def composed(c: Column) -> Column:
    """NFKC; texts of ASCII alone, which it leaves as they are, don't go through Python."""
    plain = text(c)
    return F.when(plain.rlike(r"^[\x00-\x7F]*$"), plain).otherwise(nfkc(plain))


def canonical_name(c: Column) -> Column:
    spaced = F.replace(F.lower(composed(c)), F.lit("&"), F.lit(" and "))
    return collapse(F.regexp_replace(spaced, f"[^{_WORDS}{_BLANK}]", " "))


def legal_suffix(name: Column) -> Column:
    """The longest legal suffix, in words, at the end of a canonical name; empty if there is none."""
    longest_first = sorted(LEGAL_SUFFIXES, key=lambda s: -len(s.split()))
    return F.regexp_extract(name, f"(?:^| )({'|'.join(longest_first)})$", 1)


def name_core(name: Column, suffix: Column) -> Column:
    """A canonical name without its legal suffix; empty if it is nothing else."""
    return F.trim(F.substring(name, F.lit(1), F.length(name) - F.length(suffix)))


def canonical_address(c: Column) -> Column:
    """Keeps `#`; expands abbreviations that are whole words."""
    words = F.split(collapse(F.regexp_replace(F.lower(composed(c)), f"[^{_WORDS}{_BLANK}#]", " ")), " ")
    table = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def canonical_country(c: Column) -> Column:
    """A short code for known aliases and codes of two letters, else the label in title case."""
    label = collapse(F.lower(composed(c)))
    table = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair])
    known = F.try_element_at(table, label)
    return F.coalesce(known, F.when(label.rlike(r"^\p{L}{2}$"), F.upper(label)).otherwise(F.when(label == "", label).otherwise(title(label))))


def tokens(c: Column, least: int = 1, distinct: bool = True, at: str = " ") -> Column:
    """The parts of a text that have at least so many characters. at: a space, or a regular expression."""
    found = F.filter(F.split(c, at), lambda t: F.length(t) >= max(1, least))
    return F.array_distinct(found) if distinct else found


def basic_tokens(c: Column, least: int = 4) -> Column:
    return tokens(basic(c), least, at=f"[{_BLANK}]+")


def alnum_tokens(c: Column, least: int = 2) -> Column:
    return tokens(F.lower(text(c)), least, at="[^0-9A-Za-z]+")


def id_list(c: Column, separators: str = ",") -> Column:
    """The parts of a list of identifiers, trimmed, without empty ones; in order, repeats kept."""
    return F.filter(F.transform(F.split(text(c), f"[{separators}]"), lambda x: F.trim(x)), lambda x: x != "")
