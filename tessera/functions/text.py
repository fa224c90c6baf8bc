"""Normalisation, tokens and blocking keys as column expressions.

All functions take and return Columns and stay in the JVM. A null is an empty string throughout; `null_as_nan` of
`full_string` gives the other convention, in which a missing field reads "nan".
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.constants import (
    ADDRESS_ABBREVIATIONS, CHANNEL_STOPWORDS, COMPACT_LEAST, FEATURE_STOPWORDS, INDIC_BLOCK, INDIC_FIRST, INDIC_LAST, INDIC_LATIN, NAME_ABBREVIATIONS, PHONETIC, TOKEN_STOPWORDS,
)


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def transliterate(c: Column) -> Column:
    """Letters of nine Indic blocks to Latin; other code points of those blocks are deleted."""
    latin = F.array(*(F.lit(INDIC_LATIN.get(k, "")) for k in range(INDIC_BLOCK)))
    code = lambda ch: F.ascii(ch)
    one = lambda ch: F.when(code(ch).between(INDIC_FIRST, INDIC_LAST), F.get(latin, (code(ch) - INDIC_FIRST) % INDIC_BLOCK)).otherwise(ch)
    return F.when(c.rlike(f"[\\u{INDIC_FIRST:04X}-\\u{INDIC_LAST:04X}]"), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


@lru_cache(maxsize=2)
def _fold_table(form: str) -> tuple[str, str]:
    """Characters that decompose to one character once their marks are gone, and those characters."""
    source, target = [], []
    for code in range(0x80, 0x10000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or unicodedata.combining(ch):
            continue
        plain = "".join(x for x in unicodedata.normalize(form, ch) if not unicodedata.combining(x))
        if plain != ch and len(plain) == 1:
            source.append(ch)
            target.append(plain)
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without marks, for characters that decompose to a single one."""
    source, target = _fold_table("NFKD")
    folded = F.regexp_replace(F.translate(c, source, target), r"\p{M}+", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


@F.pandas_udf(StringType())
def normal_form_c(s):  # noqa: ANN001, ANN201
    """Canonical composition, for text that isn't composed already; Spark has no such function."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Words between single spaces; none of an empty string."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def _expand(c: Column, table: dict[str, str]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_join(F.transform(words(c), lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def _plain(c: Column, ampersand: bool, compose: bool = True) -> Column:
    c = text(c)
    if compose:  # only texts with separate marks go to Python; the others are null there
        c = F.coalesce(normal_form_c(F.when(c.rlike(r"\p{M}"), c)), c)
    c = F.lower(transliterate(c))
    if ampersand:
        c = F.replace(c, F.lit("&"), F.lit(" and "))
    return _spaced(F.regexp_replace(c, r"(?U)[^\w\s]", " "))


def normalize_name(c: Column, expand: bool = True, compose: bool = True) -> Column:
    """compose: join separate combining marks with their letters first (in Arrow batches)."""
    c = _plain(c, True, compose)
    return _expand(c, NAME_ABBREVIATIONS) if expand else c


def normalize_address(c: Column, compose: bool = True) -> Column:
    return _expand(_plain(c, False, compose), ADDRESS_ABBREVIATIONS)


def _without(tokens: Column, stop: Iterable[str], least: int) -> Column:
    stop = list(stop)
    return F.filter(tokens, lambda w: (F.length(w) >= least) & (~w.isin(stop) if stop else F.lit(True)))


def name_tokens(c: Column) -> Column:
    return _without(words(normalize_name(c)), FEATURE_STOPWORDS, 2)


def address_tokens(c: Column) -> Column:
    return _without(words(normalize_address(c)), (), 2)


def numeric_tokens(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"(?U)\d{3,}"), F.lit(0))


def combined_text(name: Column, address: Column, repeat: int = 2) -> Column:
    return F.concat_ws(" ", *[text(name)] * repeat, text(address))


def clean(c: Column) -> Column:
    """Transliterated, without accents, lower case; punctuation stays."""
    return F.lower(strip_accents(transliterate(text(c))))


def index_tokens(c: Column, stop: Iterable[str] = TOKEN_STOPWORDS, cleaned: bool = True) -> Column:
    """Distinct tokens of three or more of a-z0-9, without stop words and web addresses."""
    c = clean(c) if cleaned else F.lower(text(c))
    c = F.regexp_replace(c, r"https?://\S+|www\.\S+", " ")
    c = F.regexp_replace(c, r"\.com|\.org|\.net", " ")
    return F.array_distinct(_without(words(F.regexp_replace(c, "[^a-z0-9]+", " ")), stop, 3))


def phonetic(c: Column) -> Column:
    c = whole = F.lower(text(c))
    for said, meant in PHONETIC.items():
        c = F.regexp_replace(c, rf"(?U)\b{said}\b", meant)
    # Most texts hold none of the words: one look instead of a dozen.
    return F.when(whole.rlike(rf"(?U)\b(?:{'|'.join(PHONETIC)})\b"), c).otherwise(whole)


def _key_text(c: Column) -> Column:
    return F.regexp_replace(phonetic(clean(c)), "[^a-z0-9]+", " ")


def channel_name_tokens(name: Column) -> Column:
    return F.array_distinct(_without(words(_key_text(name)), CHANNEL_STOPWORDS, 3))


def number_street_keys(address: Column) -> Column:
    """The first number of two to six digits, without leading zeros, with every other token of the address."""
    plain = _key_text(address)
    tokens = F.filter(_without(words(plain), CHANNEL_STOPWORDS, 3), lambda w: ~w.rlike("^[0-9]+$"))
    numbers = F.filter(F.regexp_extract_all(plain, F.lit(r"\b\d{1,6}\b"), F.lit(0)), lambda n: F.length(n) >= 2)
    first = F.try_element_at(numbers, F.lit(1)).cast("long").cast("string")
    keys = F.array_distinct(F.transform(tokens, lambda t: F.concat(first, F.lit("_"), t)))
    return F.when(F.size(numbers) > 0, keys).otherwise(F.array().cast("array<string>"))


def compact_key(name: Column) -> Column:
    """The letters and digits of the name without one trailing com, org or net."""
    return F.regexp_replace(F.regexp_replace(phonetic(clean(name)), "[^a-z0-9]", ""), "(com|org|net)$", "")


def full_string(name: Column, address: Column, null_as_nan: bool = False) -> Column:
    missing = F.lit("nan" if null_as_nan else "")
    return phonetic(clean(F.concat(F.coalesce(name, missing), F.lit(" "), F.coalesce(address, missing))))


def letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def simple_clean(c: Column) -> Column:
    """Lower case, all but a-z, 0-9 and white space to spaces, trimmed; no accents are folded."""
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9\s]", " "), r"^\s+|\s+$", "")


def simple_compact(c: Column) -> Column:
    return letters(simple_clean(c))


def pure_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def id_list(c: Column) -> Column:
    """Ids of a comma-separated list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(_spaced(text(c))))


def channel_keys(name: Column, address: Column) -> Column:
    """Array of (channel, key) of the three channels; a compact key needs five characters."""
    compact = compact_key(name)
    tag = lambda channel, keys: F.transform(keys, lambda k: F.struct(F.lit(channel).alias("channel"), k.alias("key")))
    return F.concat(tag("compact", F.when(F.length(compact) >= COMPACT_LEAST, F.array(compact)).otherwise(F.array().cast("array<string>"))), tag("numaddr", number_street_keys(address)), tag("name", channel_name_tokens(name)))


def token_keys(name: Column, address: Column) -> Column:
    """Array of (channel, key) of the pooled token index."""
    tag = lambda channel, keys: F.transform(keys, lambda k: F.struct(F.lit(channel).alias("channel"), k.alias("key")))
    return F.concat(tag("name", index_tokens(name)), tag("addr", index_tokens(address)))
