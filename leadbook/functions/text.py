"""Text expressions: cleaning, encoding repair, styled letters, form slugs."""

from __future__ import annotations

import string
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that mean "nothing recorded", compared case-sensitively.
NULL_TOKENS = ("", "nan", "None", "NaT", "-", "NA", "N/A")

_NULL_TOKEN_ARRAY = "array(" + ", ".join(f"'{t}'" for t in NULL_TOKENS) + ")"

# Cell texts the spreadsheet reader itself turns into nulls.
READER_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Every character Unicode counts as white space.
WHITE_SPACE = "".join(chr(p) for p in range(sys.maxunicode + 1) if chr(p).isspace())


def trimmed(c: Column) -> Column:
    """Strip every kind of Unicode white space; plain `trim` only takes blanks."""
    return F.trim(c, F.lit(WHITE_SPACE))


def clean(c: Column) -> Column:
    """The stripped text, or null when it is one of the null tokens."""
    text = trimmed(c)
    return F.when(~F.array_contains(F.expr(_NULL_TOKEN_ARRAY), text), text)


def present(c: Column) -> Column:
    """The stripped text, or null when nothing is left of it."""
    text = trimmed(c)
    return F.when(text != "", text)


def fold_key(c: Column) -> Column:
    """Lowercase alphanumerics only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def phrase_key(c: Column) -> Column:
    """Lowercase words separated by single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


# ── text decoded with the wrong code page ────────────────────────────────────

def _code_page_char(byte: int) -> str:
    # The five bytes code page 1252 leaves open come through as C1 controls.
    return bytes([byte]).decode("cp1252", errors="ignore") or chr(byte)


_HIGH_CHARS = [_code_page_char(b) for b in range(0x80, 0x100)]
_MOVED = [(c, chr(b)) for b, c in enumerate(_HIGH_CHARS, start=0x80) if c != chr(b)]
# The upper half of Latin-1 is one range; the rest are single characters.
_SUSPECT_CLASS = "[\\xA0-\\xFF" + "".join(f"\\x{{{ord(c):X}}}" for c in _HIGH_CHARS[:0x20]) + "]"
SUSPECT_RUN = f"{_SUSPECT_CLASS}{{2,}}"


# UTF-8 of more than one byte opens with one of C2 to F4, and one of 80 to BF follows, which may be a moved character.
_OPENING_PAIR = r"[\xC2-\xF4][^\x00-\x7F\xC0-\xFF]"
# Controls that the moved characters would be mistaken for.
_TAKEN = "[" + "".join(f"\\x{ord(b):X}" for _, b in _MOVED) + "]"


def _one_byte_chars(c: Column) -> Column:
    return F.translate(c, "".join(c for c, _ in _MOVED), "".join(b for _, b in _MOVED))


def _computed_once(c: Column, use: Callable[[Column], Column]) -> Column:
    """`use(c)` with `c` evaluated a single time, however often it is used."""
    return F.get(F.transform(F.array(c), use), 0)


def _read_as_utf8(one_byte_chars: Column) -> Column:
    """The UTF-8 text of characters up to FF taken as bytes, null where those are not UTF-8."""
    decoded = F.encode(one_byte_chars, "ISO-8859-1").cast("string")
    return _computed_once(decoded, lambda d: F.when(F.is_valid_utf8(d), d))


def _repair_whole(c: Column) -> Column:
    """A text in which every run is damage, read as UTF-8 in one go; null for any other text."""
    fits = lambda m: F.when(~m.rlike(r"[^\x00-\xFF]"), m)
    moved = _computed_once(F.when(~c.rlike(_TAKEN), _one_byte_chars(c)), fits)
    return _read_as_utf8(moved)


def _repair_runs(c: Column) -> Column:
    """Each suspect run read as UTF-8, or left as it is if its bytes are not UTF-8."""
    runs = F.regexp_extract_all(c, F.lit(f"({SUSPECT_RUN})"), F.lit(1))
    between = F.split(c, SUSPECT_RUN, -1)
    fixed = F.transform(runs, lambda run: F.coalesce(_read_as_utf8(_one_byte_chars(run)), run))
    pieces = F.zip_with(between, fixed, lambda text, run: F.concat(text, F.coalesce(run, F.lit(""))))
    return F.array_join(pieces, "")


def repair_encoding(c: Column) -> Column:
    """Undo UTF-8 read as code page 1252, one damaged run at a time.

    Most texts have no two characters that could be the bytes of one, and most others are
    damaged throughout: reading those whole gives what reading run by run gives.
    """
    return F.when(~c.rlike(_OPENING_PAIR), c).otherwise(F.coalesce(_repair_whole(c), _repair_runs(c)))


def damage_encoding(c: Column) -> Column:
    """The damage itself: UTF-8 bytes read as code page 1252 (used to test the repair)."""
    as_latin = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.translate(as_latin, "".join(b for _, b in _MOVED), "".join(c for c, _ in _MOVED))


# ── styled Unicode letters ───────────────────────────────────────────────────

_CASED_OR_DIGIT = {"Lu", "Ll", "Nd"}
_ASCII_ALNUM = set(string.ascii_letters + string.digits)


@cache
def styled_table() -> tuple[str, str]:
    """Every cased letter or decimal digit whose NFKC form is one ASCII alphanumeric."""
    beyond = (chr(point) for point in range(0x80, sys.maxunicode + 1))
    forms = {c: unicodedata.normalize("NFKC", c) for c in beyond if unicodedata.category(c) in _CASED_OR_DIGIT}
    table = {c: form for c, form in forms.items() if form in _ASCII_ALNUM}
    return "".join(table), "".join(table.values())


def fold_styled(c: Column) -> Column:
    """Replace styled letters and digits by their plain ASCII form."""
    styled, plain = styled_table()
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, styled, plain)).otherwise(c)


def style_ascii(c: Column) -> Column:
    """ASCII letters as mathematical bold italic (used to test the fold)."""
    upper = "".join(chr(0x1D468 + i) for i in range(26))
    lower = "".join(chr(0x1D482 + i) for i in range(26))
    ascii_letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return F.translate(c, ascii_letters, upper + lower)


# ── form answers written as slugs ────────────────────────────────────────────

# Unit words written in capitals inside a form answer.
UNIT_WORDS = ("bhk", "cr", "rk", "inr", "eoi", "nri")


def deslug(c: Column) -> Column:
    """Make `inr_4_cr_to_6_cr` readable; leave text that is not a slug alone."""
    return _computed_once(F.regexp_replace(trimmed(c), r"(?U)\s+", " "), _readable)


def _readable(text: Column) -> Column:
    words = F.translate(F.regexp_replace(text, r"(?i)^(?:inr|rs)[_\s]+", ""), "_", " ")
    words = F.trim(F.regexp_replace(words, r"\s+", " "))
    for unit in UNIT_WORDS:
        words = F.regexp_replace(words, rf"(?i)(?<![a-z]){unit}(?![a-z])", unit.upper())
    sentence = _computed_once(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1)))
    return F.when(text.rlike(r"(?i)_|^(?:inr|rs)[_\s]"), sentence).otherwise(text)
