"""Text expressions. All of them are JVM-side; none needs a Python worker."""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 white-space characters of the BMP, as a character class.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same characters as the JVM names them; a fixed class is matched fastest.
_JVM_SPACE = r"\s\x1c-\x1f"
# The same characters one by one.
SPACE_CHARACTERS = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
            *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
        ],
    )
)
# Fixed value: a word is a run of ASCII letters with at most one apostrophe part.
WORD = r"[a-zA-Z]+(?:'[a-zA-Z]+)?"
# Fixed value: characters an essay keeps besides letters, digits and spaces.
KEPT_PUNCTUATION = r".,!?;:'\"()\-/"
# A token is a run of letters and digits, or one other visible character.
TOKEN = rf"[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{SPACE}]"
TOKENIZER = "letters-digits-or-symbol"


def _possessive(pattern: str) -> str:
    """The same matches without giving characters back, which these never need."""
    return pattern.replace("]+", "]++")


def collapse_space(text: Column) -> Column:
    """Every run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U)[{_JVM_SPACE}]+", " "))


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends only."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def clean_document(text: Column) -> Column:
    """NUL characters count as spaces; then collapse."""
    return collapse_space(F.replace(text, F.lit("\0"), F.lit(" ")))


def keep_essay_characters(text: Column) -> Column:
    """Replace everything outside the essay alphabet by single spaces."""
    # Single characters instead of ranges: one table lookup per character.
    kept = string.ascii_letters + string.digits + KEPT_PUNCTUATION
    return F.trim(F.regexp_replace(text, f"[^{kept}]+", " "))


def drop_undecodable(text: Column) -> Column:
    """Remove bytes that are not valid UTF-8."""
    repaired = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def words(text: Column, lowercase: bool = True) -> Column:
    """Array of words; NULL text has none."""
    source = F.lower(text) if lowercase else text
    found = F.regexp_extract_all(source, F.lit(_possessive(WORD)), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def without_stop_words(tokens: Column, stop_words: list[str], min_length: int = 3) -> Column:
    """Drop stop words (in any case) and words shorter than ``min_length``."""
    return F.filter(
        tokens,
        lambda w: (F.length(w) >= min_length) & ~F.lower(w).isin(list(stop_words)),
    )


def word_count(text: Column) -> Column:
    """Number of words between white space or NUL characters."""
    return F.regexp_count(text, F.lit(rf"(?U)[^{_JVM_SPACE}\x00]++"))


def tokens(text: Column) -> Column:
    """Array of the default tokens."""
    return F.regexp_extract_all(text, F.lit(_possessive(TOKEN)), F.lit(0))


def token_length(text: Column) -> Column:
    """Number of default tokens, without special tokens and without truncation."""
    return F.regexp_count(text, F.lit(_possessive(TOKEN)))


def length_by(count: Callable[[list[str]], Sequence[int]]) -> Callable[[Column], Column]:
    """Token lengths by a caller's tokenizer, which counts a batch of texts at a time.

    For lengths that the default tokens cannot give; batches go to Python workers.
    """

    def lengths(texts: pd.Series) -> pd.Series:
        return pd.Series(list(count(texts.tolist())), index=texts.index)

    return F.pandas_udf(lengths, "bigint")


def safe_key(value: Column, fallback: Column) -> Column:
    """A name usable as a file name: at most 120 of the characters A-Z a-z 0-9 _ . -"""
    plain = F.btrim(F.regexp_replace(value.cast("string"), "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.substring(F.when(plain == "", fallback.cast("string")).otherwise(plain), 1, 120)


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def decoded_path(path: Column) -> Column:
    """A file path without URL escapes; a plus sign stays a plus sign."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def normal_level(level: Column) -> Column:
    """Proficiency label in upper case, without surrounding space."""
    return strip(F.upper(level.cast("string")))


def to_number(value: Column) -> Column:
    """Number, or NULL where the text is not one (a suffix as in ``7f`` is not)."""
    text = strip(value.cast("string"))
    numeric = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return F.when(text.rlike(numeric), text.try_cast("double"))
