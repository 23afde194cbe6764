"""Exact values of the expressions, one list per operator."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadbook.functions import flags, identity, labels, money, text, timing
from leadbook.operators.sheets import property_type

CASES = {
    identity.normalize_phone: {
        "+919825042217": "9825042217", "+9109825171429": "9825171429", "+19737364488": "9737364488",
        "09824039892": "9824039892", "9099903250, 9824039892": "9099903250", "9824233538.0": "9824233538",
        "1524279386": None, "20-0010511": None, "#REF!": None, "landline or 98240 39892": "9824039892",
        "9199999999": "9199999999", "9111234567890": None, "5/9824039892": "9824039892", "": None, None: None,
    },
    identity.phone_status: {"9824039892": "valid", "#REF!": "invalid", " ": "missing", " ": "missing", None: "missing"},
    identity.name_key: {
        "Mr. Shravan Modi": "shravanmodi", "shravan  modi": "shravanmodi", "𝑹𝒂𝒏𝒋𝒊𝒕": "ranjit",
        "Mrinal Shah": "mrinalshah", "m.r. Shah": "shah", "Dr Patel": "patel", "123": "", None: "",
    },
    text.clean: {" a ": "a", "-": None, "N/A": None, "n/a": "n/a", " ": None, "nan": None, "NaT": None, None: None},
    text.repair_encoding: {
        "a â€” b": "a — b", "â‚¹80": "₹80", "é": "é", "—": "—",
        "ð\u009d‘¹": "𝑹", "Ã© and ÃÃ": "é and ÃÃ",
        "àª•": "ક", "plain": "plain", "": "", None: None,
    },
    text.fold_styled: {"𝑹 Ａ９": "R A9", "ªº¹¾₹—é": "ªº¹¾₹—é", "plain": "plain", None: None},
    text.deslug: {
        "inr_4_cr_to_6_cr": "4 CR to 6 CR", "yes,_i_can_do_it_online": "Yes, i can do it online",
        "hemal@test.com": "hemal@test.com", "3_bhk": "3 BHK", "rs 5_cr": "5 CR", "two  words": "two words", "_": "",
    },
    money.parse_budget: {
        "1.5": 150.0, "450": 450.0, "7500000": 75.0, "80-90 lakhs": 85.0, "1 Cr - 2 Cr": 150.0, "5-7 lakh": 253.5,
        "75,00,000": 75.0, "60 cr": None, "0 Cr": None, "2.5cr": 250.0, "50k": 0.5, "soon": None, None: None,
    },
    labels.normalize_configuration: {
        "4 BHK": "4BHK", "4bhk": "4BHK", "4 K": "4BHK", "4 BHK , 5 BHK": "4BHK, 5BHK", "Villa": "Villa", "  ": "  ", None: None,
    },
    labels.configuration_synonyms: {
        "Bungalows, 5BHK": "Bungalow, 5BHK", "Bungalows, Bungalow only": "Bungalow", "Land & plot": "Plot", "-": None, ",": ",",
    },
    flags.is_warm: {"Not Interested": False, "Interested": True, "Follow Up": False, "HOT": True, "": False, None: False},
    property_type: {
        "Apartment Leads": "Apartment", "villas_2024": "Bungalow", "Q1 Export": None, "Land-bank": "Plot",
        "flatmates": None, "IVR": "Mixed / Other",
    },
    timing.parse_timestamp: {
        "2026-07-05 - 19:47": datetime(2026, 7, 5, 19, 47), "23-Jun-26": datetime(2026, 6, 23),
        "05 Jul 2026, 07:47 PM": datetime(2026, 7, 5, 19, 47), "2023-12-02 00:00:00": datetime(2023, 12, 2),
        "13/05/2024": datetime(2024, 5, 13), "04/05/2024": datetime(2024, 5, 4), "05/13/2024": datetime(2024, 5, 13),
        "1-Jan-75": datetime(1975, 1, 1), "1-Jan-68": datetime(2068, 1, 1), "31-Feb-24": None,
        "2024-01-01T10:11:12.5": datetime(2024, 1, 1, 10, 11, 12, 500000), "called at 5:30": None, "-": None, "7": None,
    },
}


@pytest.mark.parametrize("fn", CASES, ids=lambda f: f.__name__)
def test_golden(column, fn):
    cases = CASES[fn]
    assert dict(zip(cases, column(fn, list(cases)))) == cases


def test_status_synonyms(column):
    fold = lambda c: labels.status_synonyms(c, "buying_status")
    assert column(fold, ["Not intrested", "Postponed for now", "Maybe", None]) == ["Not interested", "Postponed", "Maybe", None]
    assert column(lambda c: labels.status_synonyms(c, "stage"), ["New "]) == ["New "]


def test_bands_are_half_open(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.0,), (99.99,), (100.0,), (700.0,), (1000.0,), (None,)], "v double")
    assert [r[0] for r in df.select(money.budget_band(F.col("v"))).collect()] == [
        "< 1 Cr", "< 1 Cr", "1–2 Cr", "7–10 Cr", "10+ Cr", None,
    ]


def test_styled_table_follows_the_rule():
    styled, plain = text.styled_table()
    assert len(styled) == len(plain) == 807
    assert not set("ªº¹¾₹—é") & set(styled)


def test_hwc_words(spark):
    from pyspark.sql import functions as F

    rows = [("VIP", None), ("-", None), (None, "Hot lead"), (None, "hotel"), (None, "COLD"), (None, None)]
    df = spark.createDataFrame(rows, "h string, s string")
    out = df.select(flags.hwc_flag(F.col("h"), F.col("s")))
    assert [r[0] for r in out.collect()] == [True, False, True, False, True, False]


def test_repair_whole_equals_repair_by_runs(column):
    """Damage, clean accents and characters that only look like damage, in every mixture."""
    rng = random.Random(8)
    parts = ["a", " ", "é", "Ã", "©", "Ã©", "â‚¬", "â", "‚", "¬", "\x81", "\x80", "Ã\x81", "漢", "ð\x9fŸ", "ðŸ˜€", "\xa0", "Â°"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)] + [None, ""]
    assert column(text.repair_encoding, texts) == column(lambda c: F.coalesce(text._repair_runs(c), c), texts)
