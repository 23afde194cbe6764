"""Identity expressions: standard mobile numbers and name keys.

Both are single passes of regular expressions, without array functions, so a
projection that uses them stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadbook.functions.text import fold_styled, trimmed

# A part is an optional trunk zero, an optional country code (91, or 1 typed for
# it) with its own trunk zeros, and ten digits starting 6 to 9, with nothing left over.
_MOBILE_PART = r"(?:^|\|)0*(?:(?:91|1)0*)?([6-9][0-9]{9})(?=\||$)"

# Titles that carry no identity.
TITLES = ("mr", "mrs", "ms", "dr", "shri", "smt", "miss")


# A cell that is one mobile and nothing else, as nearly all are.
_PLAIN_MOBILE = r"^\+?0*+(?:(?:91|1)0*+)?([6-9][0-9]{9})(?:\.0)?$"


def normalize_phone(c: Column) -> Column:
    """The first valid ten-digit mobile in the cell, or null."""
    return F.when(c.rlike(_PLAIN_MOBILE), F.regexp_extract(c, _PLAIN_MOBILE, 1)).otherwise(_searched_mobile(c))


def _searched_mobile(c: Column) -> Column:
    text = F.regexp_replace(F.lower(trimmed(c)), r"\.0$", "")
    parts = F.translate(F.replace(text, F.lit(" or "), F.lit("|")), ",;/", "|||")
    digits = F.regexp_replace(parts, r"[^0-9|]+", "")
    return F.nullif(F.regexp_extract(digits, _MOBILE_PART, 1), F.lit(""))


def phone_status(c: Column, mobile: Column | None = None) -> Column:
    """`missing` for a blank cell, `invalid` for one without a mobile, else `valid`.

    `mobile` is the cell's standard mobile where that is known already.
    """
    found = normalize_phone(c) if mobile is None else mobile
    blank = c.isNull() | (trimmed(c) == "")
    return F.when(found.isNotNull(), "valid").when(blank, "missing").otherwise("invalid")


def _title_words() -> str:
    # A word is a title when its letters alone spell one: `Mr.`, `m.r.`, `(Dr)`.
    other = r"[^a-z\s]*"
    spelled = [other + other.join(title) + other for title in TITLES]
    return rf"(?U)(?<!\S)(?:{'|'.join(spelled)})(?!\S)"


def name_key(c: Column) -> Column:
    """Lowercase letters of the name without titles; empty when there is no name."""
    text = F.lower(fold_styled(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(text, _title_words(), ""), "[^a-z]", "")


def e164(c: Column) -> Column:
    """`+91` and the mobile, or an empty text."""
    return F.coalesce(F.concat(F.lit("+91"), normalize_phone(c)), F.lit(""))


def name_parts(c: Column) -> tuple[Column, Column]:
    """First word and remaining words; both empty when the name has no letters."""
    text = trimmed(F.regexp_replace(fold_styled(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    usable = F.lower(text).rlike("[a-z]")
    first = F.regexp_extract(text, r"^[^ ]*", 0)
    rest = F.regexp_extract(text, r"^[^ ]* (.*)$", 1)
    return F.when(usable, first).otherwise(""), F.when(usable, rest).otherwise("")
