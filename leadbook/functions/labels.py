"""Label expressions: unit-type spelling and fixed business synonyms."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadbook.functions.text import clean, phrase_key, trimmed

# Unit types, matched per comma-separated token.
CONFIGURATION_SYNONYMS = {
    "bungalow": "Bungalow",
    "bungalows": "Bungalow",
    "bungalow only": "Bungalow",
    "villa": "Bungalow",
    "plot": "Plot",
    "plots": "Plot",
    "land": "Plot",
    "land plot": "Plot",
    "land and plot": "Plot",
    "penthouse": "Penthouse",
    "penthouses": "Penthouse",
    "duplex": "Duplex",
    "duplexes": "Duplex",
    "commercial": "Commercial",
}

# Status wordings, matched on the whole cell.
STATUS_SYNONYMS = {
    "buying_status": {
        "postponed": "Postponed",
        "postponed for now": "Postponed",
        "postpone": "Postponed",
        "not intrested": "Not interested",
        "not interested": "Not interested",
        "still searching": "Still searching",
        "searching": "Still searching",
        "bought already": "Bought already",
        "already bought": "Bought already",
        "interested": "Interested",
    },
    "call_status": {
        "spoken": "Spoken",
        "not spoken": "Not spoken",
        "call back later": "Call back later",
        "callback later": "Call back later",
        "call later": "Call back later",
    },
}


def _synonym(table: dict[str, str], c: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(entries, phrase_key(c)), c)


def normalize_configuration(c: Column) -> Column:
    """One spelling per unit type: `4 bhk`, `4bhk`, `4 K` all give `4BHK`."""
    text = F.regexp_replace(trimmed(c), r"(?i)(\d+)\s*bhk", "$1BHK")
    text = F.regexp_replace(text, r"(?i)\b(\d+)\s*k\b", "$1BHK")
    text = F.regexp_replace(text, r"\s*,\s*", ", ")
    tidy = trimmed(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(trimmed(c) == "", c).otherwise(tidy)


def configuration_synonyms(c: Column) -> Column:
    """Fold each comma token, keep the first of equal tokens, keep their order."""
    value = clean(c)
    tokens = F.filter(F.transform(F.split(value, ","), trimmed), lambda t: t != "")
    folded = F.array_distinct(F.transform(tokens, lambda t: _synonym(CONFIGURATION_SYNONYMS, t)))
    return F.when(F.size(tokens) > 0, F.array_join(folded, ", ")).otherwise(value)


def status_synonyms(c: Column, field: str) -> Column:
    """Fold a whole status value; fields without a table come back unchanged."""
    table = STATUS_SYNONYMS.get(field)
    return _synonym(table, clean(c)) if table else c
