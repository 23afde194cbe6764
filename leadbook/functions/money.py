"""Budget expressions: free text to Lakh, price bands, display units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number-and-unit pattern.  Alternatives are tried in order, so
# `cr` wins over `crore` and `l` over `lakh`; the meaning is the same.
NUMBER_AND_UNIT = r"(?i)(\d+(?:[.,]\d+)?)\s*(cr|crore|crores|c|l|lac|lacs|lakh|lakhs|k)?"
CRORE_UNITS = ("cr", "crore", "crores", "c")
LAKH_UNITS = ("l", "lac", "lacs", "lakh", "lakhs")
MAX_PLAUSIBLE_LAKH = 5000.0

# Price bands in Lakh, lower bound included, upper bound excluded.
BANDS: tuple[tuple[str, float, float | None], ...] = (
    ("< 1 Cr", 0, 100),
    ("1–2 Cr", 100, 200),
    ("2–3 Cr", 200, 300),
    ("3–4 Cr", 300, 400),
    ("4–5 Cr", 400, 500),
    ("5–7 Cr", 500, 700),
    ("7–10 Cr", 700, 1000),
    ("10+ Cr", 1000, None),
)
BAND_LABELS = tuple(label for label, _, _ in BANDS)


def _lakh(number: Column, unit: Column) -> Column:
    bare = (
        F.when(number <= 20, number * 100.0)
        .when(number <= 1000, number)
        .otherwise(number / 100000.0)
    )
    return (
        F.when(unit.isin(*CRORE_UNITS), number * 100.0)
        .when(unit.isin(*LAKH_UNITS), number)
        .when(unit == "k", number / 100.0)
        .otherwise(bare)
    )


def parse_budget(c: Column) -> Column:
    """Budget text in Lakh; a range gives the midpoint of its ends.

    Each number takes its own unit; zero and implausibly large amounts are
    ignored.  Results are rounded to two decimals and bounded by the cap, so a
    column holds at most 500,000 distinct budgets at any data size.
    """
    numbers = F.regexp_extract_all(c, F.lit(NUMBER_AND_UNIT), F.lit(1))
    units = F.regexp_extract_all(c, F.lit(NUMBER_AND_UNIT), F.lit(2))
    amounts = F.zip_with(
        numbers,
        units,
        lambda n, u: F.struct(F.translate(n, ",", ".").try_cast("double").alias("n"), F.lower(u).alias("u")),
    )
    positive = F.filter(amounts, lambda a: a["n"] > 0)
    lakhs = F.filter(
        F.transform(positive, lambda a: _lakh(a["n"], a["u"])), lambda v: v <= MAX_PLAUSIBLE_LAKH
    )
    return F.round((F.array_min(lakhs) + F.array_max(lakhs)) / 2, 2)


def budget_band(lakh: Column) -> Column:
    """The label of the half-open price band holding the amount."""
    chain = None
    for label, _, upper in BANDS:
        if upper is None:
            break
        chain = F.when(lakh < upper, label) if chain is None else chain.when(lakh < upper, label)
    return F.when(lakh.isNotNull(), chain.otherwise(BANDS[-1][0]))


def band_position(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BAND_LABELS]), label)


def crore(lakh: Column) -> Column:
    return F.round(lakh / 100.0, 2)


def rupees(lakh: Column) -> Column:
    return F.round(lakh * 100000.0, 0).cast("bigint")
