"""Timestamp expressions: mixed-format parsing and clock-time tests.

A cell is rewritten step by step into one form, year first, and parsed once.
Each step refers to the one before it once, so the expression stays small, and
only text that has the final form reaches the parser: the many cells that are
not dates raise no parser errors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadbook.functions.text import trimmed

_MONTH = (
    "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    "(?:uary|ruary|ch|il|e|y|ust|tember|t|ober|ember)?"
)

# How dates are written.  Numbers with the year last are day first,
# and a two-digit year of 69 or more belongs to the last century.
_STEPS: tuple[tuple[str, str], ...] = (
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})(?!\d)", "$1-$2-$3"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)", "$3-$2-$1"),
    (rf"(?i)^(\d{{1,2}})[- ]{_MONTH}[-, ]{{1,2}}(\d{{4}}|\d{{2}})(?!\d)", "$3-$2-$1"),
    (rf"(?i)^{_MONTH} (\d{{1,2}}),? (\d{{4}})(?!\d)", "$3-$1-$2"),
    (r"^(69|[7-9]\d)-", "19$1-"),
    (r"^(\d{2})-", "20$1-"),
    # A month beyond 12 means the cell was month first after all.
    (r"^(\d{4})-(1[3-9]|2\d|3[01])-(0?[1-9]|1[0-2])(?!\d)", "$1-$3-$2"),
    # Separators between date and time: ` - `, `, `, `T` or a blank.
    (r"^(\d{4}-[^ ,T]+)(?: - |, | |T)(?=\d)", "$1 "),
    (r"(?i)(\d) ?([ap]m)$", "$1 $2"),
)
_READY = r"(?i)^\d{4}-(?:\d{1,2}|[a-z]{3})-\d{1,2}(?: \d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d{1,6})?)?(?: [ap]m)?)?$"
_PATTERN = "yyyy-[M][MMM]-d[ h:m[:s][.SSSSSS] a][ H:m[:s][.SSSSSS]]"


def parse_timestamp(c: Column) -> Column:
    """A mixed-format date cell as a timestamp, null when no format fits."""
    text = trimmed(c)
    for shape, order in _STEPS:
        text = F.regexp_replace(text, shape, order)
    return F.when(text.rlike(_READY), F.try_to_timestamp(text, F.lit(_PATTERN)))


def has_clock_time(stamp: Column) -> Column:
    """True when the timestamp carries more than a midnight."""
    return F.coalesce((F.hour(stamp) != 0) | (F.minute(stamp) != 0), F.lit(False))
