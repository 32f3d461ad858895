"""Text normalisation and record preparation as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Legal-form words, address abbreviations with their words, and words that say nothing
# about a place.
LEGAL = tuple("ltd limited llc inc incorporated corp corporation co company plc pvt private llp sarl sas sa sci eurl pte bv gmbh and the".split())
ADDRESS_WORDS = {
    "rd": "road", "st": "street", "ave": "avenue", "av": "avenue", "blvd": "boulevard", "ln": "lane", "dr": "drive", "ct": "court",
    "cir": "circle", "hwy": "highway", "pkwy": "parkway", "ste": "suite", "apt": "apartment", "fl": "floor", "flr": "floor",
    "n": "north", "s": "south", "e": "east", "w": "west", "nr": "near", "opp": "opposite", "marg": "road", "r": "rue", "bd": "boulevard",
    "boul": "boulevard", "rte": "route", "imp": "impasse", "che": "chemin", "pl": "place", "res": "residence",
}
ADDRESS_STOP = tuple("no number near opposite unit building plot sector block floor de du des la le les et a au aux".split())
ADDRESS_COMMON = tuple(sorted({*ADDRESS_WORDS.values(), *ADDRESS_STOP}))

# Letters that do not decompose, with their usual spelling in plain letters.
PLAIN_SPELLING = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "þ": "th", "ð": "d", "ı": "i"}


def fold(text: str | None) -> str:
    """Compatibility decomposition, case folding, and marks of Latin letters dropped; other scripts keep
    their marks. What is neither letter, digit nor mark is a space, but `&` is the word "and"."""
    if not text:
        return ""
    on_latin, kept = False, []
    for c in unicodedata.normalize("NFKD", text).casefold():
        if unicodedata.combining(c):
            if not on_latin:
                kept.append(c)
            continue
        on_latin = unicodedata.name(c, "").find("LATIN") >= 0
        spaced = " and " if c == "&" else " "
        kept.append(c if c.isalnum() or unicodedata.category(c)[0] == "M" else spaced)
    return " ".join("".join(kept).split())


def _spelt(c: str) -> str:
    """A letter of another script by its Unicode name: DEVANAGARI LETTER KA is "ka"."""
    if c < "ɐ":
        return PLAIN_SPELLING.get(c, c)
    name = unicodedata.name(c, "")
    for role in (" LETTER ", " VOWEL SIGN ", " SYLLABLE "):
        if role in name:
            return name.split(role, 1)[1].split(" WITH ")[0].split(" ")[-1].lower()
    return c if c.isalnum() and c.isascii() else " " if not unicodedata.combining(c) else ""


def romanise(text: str | None) -> str:
    """Any script in plain Latin letters, folded."""
    return fold("".join(map(_spelt, fold(text))))


@F.pandas_udf(StringType())
def normalize_any(values: pd.Series) -> pd.Series:
    """`fold` for any script, in Arrow batches."""
    return values.map(fold, na_action=None)


@F.pandas_udf(StringType())
def latin_any(values: pd.Series) -> pd.Series:
    return values.map(romanise, na_action=None)


_ACCENTED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
_BARE = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"


def latin(text: Column) -> Column:
    """`romanise` for text in Latin letters, as plain expressions inside code generation."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _BARE)
    for letter, spelling in PLAIN_SPELLING.items():
        out = F.replace(out, F.lit(letter), F.lit(spelling))
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}\p{M}]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def canonical(latin_text: Column) -> Column:
    """Without legal-form words; order and repeats stay."""
    return F.array_join(F.filter(tokens(latin_text), lambda t: ~t.isin(*LEGAL)), " ")


def expand_address(latin_text: Column) -> Column:
    """Abbreviations replaced by their words."""
    pairs = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    return F.array_join(F.transform(tokens(latin_text), lambda t: F.coalesce(F.try_element_at(pairs, t), t)), " ")


def salient(text: Column, min_len: int = 3) -> Column:
    """Distinct words that tell something, the longest first, then by spelling."""
    told = F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) >= min_len) & ~t.rlike("^[0-9]+$") & ~t.isin(*LEGAL))
    return F.transform(F.array_sort(F.transform(told, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def prepared(records, transliterate: bool = False):
    """records(entity_id, business_name, business_address, country) with the derived columns, once each.

    transliterate: any script, by an Arrow function; otherwise Latin text by plain expressions."""
    to_latin = latin_any if transliterate else latin
    to_plain = normalize_any if transliterate else latin
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = records.select(
        *[c for c in records.columns if c not in ("business_name", "business_address", "country")],
        *[blank(c).alias(c) for c in ("business_name", "business_address", "country")],
    )
    out = out.withColumns(
        {"name": to_latin(F.col("business_name")), "unicode_name": to_plain(F.col("business_name")), "raw_address": to_latin(F.col("business_address")), "nation": to_latin(F.col("country"))}
    )
    out = out.withColumns({"core": canonical(F.col("name")), "address": expand_address(F.col("raw_address"))}).drop("raw_address")
    sets = {f"{f}_set": F.array_distinct(tokens(F.col(f))) for f in ("name", "core", "address")}
    runs = {"name_numbers": F.array_distinct(F.regexp_extract_all("name", F.lit(r"\d+"), 0)), "address_runs": F.regexp_extract_all("address", F.lit(r"\d+"), 0)}
    out = out.withColumns(sets | runs)
    return out.withColumns(
        {f"{f}_sorted": F.array_join(F.array_sort(f"{f}_set"), " ") for f in ("name", "core", "address")}
        | {
            "address_numbers": F.array_distinct("address_runs"),
            "house": F.coalesce(F.try_element_at("address_runs", F.lit(1)), F.lit("")),
            "postcodes": F.filter(F.array_distinct("address_runs"), lambda x: F.length(x).isin(5, 6)),
            "initials": F.array_join(F.transform(tokens(F.col("core")), lambda t: F.substring(t, 1, 1)), ""),
        }
    ).drop("address_runs")
