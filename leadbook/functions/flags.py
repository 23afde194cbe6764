"""Yes/no expressions: priority clients and warm leads."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadbook.functions.text import clean

# Wording that marks a lead as not warm; checked first, anywhere in the text.
NEGATIVE_WORDING = (
    "not interested", "no interest", "not looking", "cold", "lost", "dead",
    "junk", "invalid", "drop", "dnd", "wrong", "cancel", "postpone", "low",
    "no response", "not picking", "not reachable", "switched off",
)
# Wording that marks a lead as warm.
POSITIVE_WORDING = (
    "hot", "warm", "high", "interested", "booked", "booking", "closed", "won",
    "finali", "ready", "confirmed", "negoti", "token", "visit done", "medium",
)
QUALITY_FIELDS = ("buying_status", "interest_level")


def hwc_flag(hwc: Column, client_status: Column) -> Column:
    """Any priority mark, or a client status with the word hot, warm or cold."""
    by_status = F.lower(clean(client_status)).rlike(r"\b(?:hot|warm|cold)\b")
    return clean(hwc).isNotNull() | F.coalesce(by_status, F.lit(False))


def is_warm(c: Column) -> Column:
    text = F.lower(clean(c))
    warm = text.rlike("|".join(POSITIVE_WORDING)) & ~text.rlike("|".join(NEGATIVE_WORDING))
    return F.coalesce(warm, F.lit(False))


def quality_flag(*fields: Column) -> Column:
    """Warm wording in any of the fields."""
    return reduce(or_, (is_warm(c) for c in fields), F.lit(False))
