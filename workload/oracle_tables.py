"""DuckDB common table expressions for the oracles, written independently of Spark."""

from __future__ import annotations

from leadbook.functions.flags import NEGATIVE_WORDING, POSITIVE_WORDING
from leadbook.functions.labels import CONFIGURATION_SYNONYMS, STATUS_SYNONYMS
from leadbook.functions.money import BANDS
from workload.lead_export import duck_lead_export

FIELDS = [
    "campaign", "name", "phone", "budget", "configuration_required", "call_status", "buying_status", "hwc",
    "client_status", "email", "interest_level", "facebook_page", "facebook_ad_set", "lead_for_project",
    "current_city", "first_call_date", "date", "qualitative_remarks",
]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def clean(c: str) -> str:
    return f"(CASE WHEN trim({c}) IN ('', 'nan', 'None', 'NaT', '-', 'NA', 'N/A') THEN NULL ELSE trim({c}) END)"


def phone(c: str) -> str:
    parts = f"string_split_regex(lower(regexp_replace(trim({c}), '\\.0$', '')), '[,;/|]| or ')"
    digits = f"list_transform({parts}, lambda p: ltrim(regexp_replace(p, '[^0-9]', '', 'g'), '0'))"
    stripped = (
        f"list_transform({digits}, lambda d: CASE"
        " WHEN length(d) > 10 AND starts_with(d, '91') AND length(ltrim(substr(d, 3), '0')) = 10 THEN ltrim(substr(d, 3), '0')"
        " WHEN length(d) > 10 AND starts_with(d, '1') AND length(ltrim(substr(d, 2), '0')) = 10 THEN ltrim(substr(d, 2), '0')"
        " ELSE d END)"
    )
    return f"list_filter({stripped}, lambda d: regexp_full_match(d, '[6-9][0-9]{{9}}'))[1]"


def name_key(c: str) -> str:
    words = f"string_split_regex(lower(trim(coalesce({c}, ''))), '\\s+')"
    titles = "('mr', 'mrs', 'ms', 'dr', 'shri', 'smt', 'miss')"
    kept = f"list_filter({words}, lambda w: regexp_replace(w, '[^a-z]', '', 'g') NOT IN {titles})"
    return f"regexp_replace(array_to_string({kept}, ''), '[^a-z]', '', 'g')"


def budget(c: str) -> str:
    pattern = r"(\d+(?:[.,]\d+)?)\s*(cr|crore|crores|c|l|lac|lacs|lakh|lakhs|k)?"
    found = f"list_zip(regexp_extract_all({c}, '{pattern}', 1, 'i'), regexp_extract_all({c}, '{pattern}', 2, 'i'))"
    amounts = f"list_transform({found}, lambda z: {{'n': try_cast(replace(z[1], ',', '.') AS DOUBLE), 'u': lower(coalesce(z[2], ''))}})"
    lakhs = (
        f"list_transform(list_filter({amounts}, lambda a: a.n > 0), lambda a: CASE"
        " WHEN a.u IN ('cr', 'crore', 'crores', 'c') THEN a.n * 100.0"
        " WHEN a.u IN ('l', 'lac', 'lacs', 'lakh', 'lakhs') THEN a.n"
        " WHEN a.u = 'k' THEN a.n / 100.0"
        " WHEN a.n <= 20 THEN a.n * 100.0 WHEN a.n <= 1000 THEN a.n ELSE a.n / 100000.0 END)"
    )
    plausible = f"list_filter({lakhs}, lambda v: v <= 5000)"
    return f"round((list_min({plausible}) + list_max({plausible})) / 2, 2)"


def band(c: str) -> str:
    tests = " ".join(f"WHEN {c} >= {lo} AND {c} < {hi} THEN {text(label)}" for label, lo, hi in BANDS if hi is not None)
    return f"(CASE {tests} WHEN {c} >= {BANDS[-1][1]} THEN {text(BANDS[-1][0])} END)"


def configuration(c: str) -> str:
    spaced = f"regexp_replace(trim({c}), '(\\d+)\\s*bhk', '\\1BHK', 'gi')"
    short = f"regexp_replace({spaced}, '\\b(\\d+)\\s*k\\b', '\\1BHK', 'gi')"
    return f"trim(regexp_replace(regexp_replace({short}, '\\s*,\\s*', ', ', 'g'), '\\s+', ' ', 'g'))"


def phrase(c: str) -> str:
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


def synonym(table: dict[str, str], c: str) -> str:
    tests = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items())
    return f"(CASE {phrase(c)} {tests} ELSE {c} END)"


def configuration_tokens(c: str) -> str:
    tokens = f"list_filter(list_transform(string_split({c}, ','), lambda t: trim(t)), lambda t: t <> '')"
    folded = f"list_transform({tokens}, lambda t: {synonym(CONFIGURATION_SYNONYMS, 't')})"
    first = f"list_filter({folded}, lambda t, i: list_position({folded}, t) = i)"
    return f"CASE WHEN len({tokens}) > 0 THEN array_to_string({first}, ', ') ELSE {c} END"


def status(c: str, field: str) -> str:
    return synonym(STATUS_SYNONYMS[field], c)


def warm(c: str) -> str:
    value = f"lower({clean(c)})"
    bad = " OR ".join(f"contains({value}, {text(w)})" for w in NEGATIVE_WORDING)
    good = " OR ".join(f"contains({value}, {text(w)})" for w in POSITIVE_WORDING)
    return f"coalesce(({good}) AND NOT ({bad}), false)"


QUALITY = f"({warm('buying_status')} OR {warm('interest_level')})"
HWC = (
    f"({clean('hwc')} IS NOT NULL OR coalesce(regexp_matches(lower({clean('client_status')}), '\\b(hot|warm|cold)\\b'), false))"
)


def stamp(c: str) -> str:
    formats = ("%Y-%m-%d - %H:%M", "%Y-%m-%d - %H:%M:%S", "%d-%b-%y", "%d %b %Y, %I:%M %p", "%Y-%m-%d")
    return "coalesce(" + ", ".join(f"try_strptime(trim({c}), '{f}')" for f in formats) + ")"


def deslug(c: str) -> str:
    tidy = f"regexp_replace(trim({c}), '\\s+', ' ', 'g')"
    words = f"trim(regexp_replace(replace(regexp_replace({tidy}, '^(inr|rs)[_\\s]+', '', 'i'), '_', ' '), '\\s+', ' ', 'g'))"
    for unit in ("bhk", "cr", "rk", "inr", "eoi", "nri"):
        words = f"regexp_replace({words}, '(^|[^A-Za-z]){unit}($|[^A-Za-z])', '\\1{unit.upper()}\\2', 'gi')"
    sentence = f"(upper(substr({words}, 1, 1)) || substr({words}, 2))"
    return f"(CASE WHEN regexp_matches({tidy}, '_|^(inr|rs)[_\\s]', 'i') THEN {sentence} ELSE {tidy} END)"


def _richness() -> str:
    return " + ".join(f"({f} IS NOT NULL)::INT" for f in FIELDS)


def _merged_column(c: str) -> str:
    return f"arg_min({c}, richness_rank) FILTER ({c} IS NOT NULL) AS {c}"


def _folded(field: str) -> str:
    return (
        f"SELECT lower(v) AS k, v AS canonical FROM (SELECT v, row_number() OVER (PARTITION BY lower(v) ORDER BY n DESC, v) AS rn"
        f" FROM (SELECT {clean(field)} AS v, count(*) AS n FROM configured GROUP BY 1) WHERE v IS NOT NULL) WHERE rn = 1"
    )


FOLDED = ["call_status", "buying_status", "interest_level", "configuration_required"]
_SYNONYMS = {
    "call_status": status("f_call_status.canonical", "call_status"),
    "buying_status": status("f_buying_status.canonical", "buying_status"),
    "interest_level": "f_interest_level.canonical",
    "configuration_required": configuration_tokens("f_configuration_required.canonical"),
}

NOTE_LINES = (
    "SELECT row_ord, source_file, source_sheet, pos, trim(regexp_extract(line, '^[ \\t]*([^:]{2,60}?)[ \\t]*:[ \\t]*(.*)$', 1)) AS label,"
    " trim(regexp_extract(line, '^[ \\t]*([^:]{2,60}?)[ \\t]*:[ \\t]*(.*)$', 2)) AS value"
    " FROM (SELECT row_ord, source_file, source_sheet, unnest(string_split(qualitative_remarks, chr(10))) AS line,"
    " generate_subscripts(string_split(qualitative_remarks, chr(10)), 1) AS pos FROM leads)"
)

KNOWN_NOTE_SLUGS = ("city", "whatisyourbudget")

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "leads": ((), duck_lead_export()),
    "keyed": (
        ("leads",),
        f"SELECT *, {phone('phone')} AS phone_normalized, {name_key('name')} AS name_key, ({_richness()}) AS richness FROM leads",
    ),
    "valid": (("keyed",), "SELECT * FROM keyed WHERE phone_normalized IS NOT NULL"),
    "sole": (
        ("valid",),
        "SELECT phone_normalized, min(name_key) AS sole_key FROM valid WHERE name_key <> ''"
        " GROUP BY 1 HAVING count(DISTINCT name_key) = 1",
    ),
    "resolved": (
        ("valid", "sole"),
        "SELECT valid.*, CASE WHEN name_key = '' THEN coalesce(sole_key, '') ELSE name_key END AS lead_key,"
        " -richness::BIGINT * 1000000000000 + row_ord AS richness_rank"
        " FROM valid LEFT JOIN sole USING (phone_normalized)",
    ),
    "book": (
        ("resolved",),
        "SELECT phone_normalized, lead_key AS name_key, arg_min(row_ord, richness_rank) AS row_ord, "
        + ", ".join(_merged_column(c) for c in ["source_file", "source_sheet", *FIELDS])
        + ", count(*) AS merged_row_count, array_to_string(list_sort(list(DISTINCT source_file)), ' · ') AS merged_sources"
        " FROM resolved GROUP BY phone_normalized, lead_key",
    ),
    "configured": (
        ("book",),
        f"SELECT * REPLACE ({configuration('configuration_required')} AS configuration_required),"
        f" {budget(clean('budget'))} AS budget_value FROM book",
    ),
    **{f"f_{f}": (("configured",), _folded(f)) for f in FOLDED},
    "prepared": (
        ("configured", *[f"f_{f}" for f in FOLDED]),
        "SELECT c.* REPLACE (" + ", ".join(f"{_SYNONYMS[f]} AS {f}" for f in FOLDED) + f"), {band('budget_value')} AS budget_bucket"
        " FROM configured c " + " ".join(f"LEFT JOIN f_{f} ON lower({clean('c.' + f)}) = f_{f}.k" for f in FOLDED),
    ),
    "flagged": (("prepared",), f"SELECT *, {HWC} AS is_hwc, {QUALITY} AS is_quality FROM prepared"),
    "classified": (
        ("flagged",),
        f"""SELECT *, CASE
            WHEN {clean('buying_status')} = 'Interested' AND budget_bucket IN ('2–3 Cr', '4–5 Cr', '10+ Cr') THEN 1
            WHEN contains(lower({clean('call_status')}), 'not spoken') AND {clean('hwc')} IS NULL THEN 2
            WHEN {clean('buying_status')} NOT IN ('Interested', 'Postponed') THEN 3
            WHEN {clean('hwc')} IS NOT NULL AND {clean('facebook_page')} IS NULL THEN 4 ELSE 0 END AS rule_no FROM flagged""",
    ),
    "verdicts": (
        ("classified",),
        f"""SELECT *, CASE rule_no WHEN 1 THEN 'good' WHEN 2 THEN 'bad' WHEN 3 THEN 'bad' WHEN 4 THEN 'good' ELSE 'unclassified' END AS lead_class,
          CASE rule_no
            WHEN 1 THEN 'Rule #1: buying_status is one of Interested AND budget_bucket is one of 2–3 Cr, 4–5 Cr, 10+ Cr'
            WHEN 2 THEN 'Rule #2: call_status contains NOT SPOKEN AND hwc is empty'
            WHEN 3 THEN 'Rule #3: buying_status is not one of Interested, Postponed AND visit_status is empty'
            WHEN 4 THEN 'Rule #4: hwc has any value AND facebook_page is empty'
            ELSE (SELECT CASE len(b) WHEN 0 THEN 'Values did not match any rule'
                    WHEN 4 THEN 'No data in any rule field (' || array_to_string(b, ', ') || ')'
                    ELSE 'No data in ' || array_to_string(b, ', ') END
                  FROM (SELECT list_filter([
                    CASE WHEN budget_bucket IS NULL THEN 'budget_bucket' END,
                    CASE WHEN {clean('buying_status')} IS NULL THEN 'buying_status' END,
                    CASE WHEN {clean('call_status')} IS NULL THEN 'call_status' END,
                    CASE WHEN {clean('hwc')} IS NULL THEN 'hwc' END], lambda x: x IS NOT NULL) AS b))
          END AS lead_class_reason FROM classified""",
    ),
    "stamped": (("prepared",), f"SELECT *, {stamp('date')} AS stamp FROM prepared"),
    "note_lines": (("leads",), NOTE_LINES),
    "note_pairs": (
        ("note_lines",),
        "SELECT *, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS slug FROM note_lines"
        " WHERE label <> '' AND value <> '' AND regexp_full_match(label, '[A-Za-z][A-Za-z0-9 ''&/()?.,\\-₹ ]*')"
        " AND len(string_split_regex(label, '\\s+')) <= 10",
    ),
    "census": (
        ("note_pairs",),
        "SELECT source_file, source_sheet, slug, count(DISTINCT row_ord) AS rows, arg_min(label, row_ord * 1000 - pos) AS label"
        " FROM note_pairs GROUP BY ALL",
    ),
    "noted": (("leads",), "SELECT source_file, source_sheet, count(qualitative_remarks) AS noted_rows FROM leads GROUP BY ALL"),
    "kept": (
        ("census", "noted"),
        "SELECT census.*, noted_rows FROM census JOIN noted USING (source_file, source_sheet)"
        " WHERE rows >= greatest(2, floor(noted_rows * 0.02)) OR slug IN ('city', 'whatisyourbudget')",
    ),
    "cells": (
        ("flagged",),
        "SELECT section, row_label, col_label, count(*) AS n FROM (SELECT unnest(["
        " {'section': 'config_x_budget', 'row_label': configuration_required, 'col_label': budget_bucket},"
        " {'section': 'hwc_x_config', 'row_label': CASE WHEN is_hwc THEN 'HWC-marked' ELSE 'Not marked' END, 'col_label': configuration_required},"
        " {'section': 'hwc_x_budget', 'row_label': CASE WHEN is_hwc THEN 'HWC-marked' ELSE 'Not marked' END, 'col_label': budget_bucket},"
        " {'section': 'buying_status_x_config', 'row_label': buying_status, 'col_label': configuration_required},"
        " {'section': 'call_status_x_buying', 'row_label': call_status, 'col_label': buying_status}], recursive := true) FROM flagged)"
        " GROUP BY ALL",
    ),
    "class_cells": (
        ("verdicts",),
        "SELECT section, row_label, col_label, count(*) AS n FROM (SELECT unnest(["
        " {'section': 'lead_class_x_budget', 'row_label': verdict, 'col_label': budget_bucket},"
        " {'section': 'lead_class_x_config', 'row_label': verdict, 'col_label': configuration_required},"
        " {'section': 'lead_class_x_call_status', 'row_label': verdict, 'col_label': call_status}], recursive := true)"
        " FROM (SELECT *, CASE lead_class WHEN 'good' THEN 'Good' WHEN 'bad' THEN 'Bad' END AS verdict FROM verdicts))"
        " GROUP BY ALL",
    ),
    "counts": (
        ("prepared",),
        "SELECT field, value, count(*) AS \"count\" FROM (SELECT unnest(["
        + ", ".join(
            f"{{'field': '{label}', 'value': {clean(c)}}}"
            for label, c in {
                "hwc": "hwc", "call_status": "call_status", "buying_status": "buying_status",
                "configuration": "configuration_required", "pages": "facebook_page",
                "campaigns": "campaign", "ad_sets": "facebook_ad_set",
            }.items()
        )
        + "], recursive := true) FROM prepared) WHERE value IS NOT NULL GROUP BY ALL",
    ),
    "crosstab": (
        ("cells",),
        "SELECT section, row_label, col_label, n, sum(n) OVER (PARTITION BY section, row_label)::BIGINT AS row_total,"
        " sum(n) OVER (PARTITION BY section, col_label)::BIGINT AS col_total"
        " FROM cells WHERE row_label IS NOT NULL AND col_label IS NOT NULL",
    ),
}


# The select and the tables of every text that `oracle` gave.
_WRITTEN: dict[str, tuple[str, list[str]]] = {}


def _needed(name: str, order: list[str]) -> None:
    for dependency in TABLES[name][0]:
        _needed(dependency, order)
    if name not in order:
        order.append(name)


def oracle(select: str, *names: str) -> str:
    """`select` over the named tables and whatever they are built from."""
    order: list[str] = []
    for name in names:
        _needed(name, order)
    parts = ",\n".join(f"{name} AS ({TABLES[name][1]})" for name in order)
    text = f"WITH {parts}\n{select}"
    _WRITTEN[text] = (select, order)
    return text


def shared(sql: str, where: dict[str, str], *texts: str) -> str:
    """`sql` with the named `oracle` texts in it cut to their selects, over one set of tables.

    Each table is worked out once; one named in `where` keeps only the rows that meet its condition.
    """
    order: list[str] = []
    for text in texts:
        select, names = _WRITTEN[text]
        sql = sql.replace(text, select)
        order += [name for name in names if name not in order]
    kept = lambda name: f"SELECT * FROM ({TABLES[name][1]}) WHERE {where[name]}" if name in where else TABLES[name][1]
    parts = ",\n".join(f"{name} AS MATERIALIZED ({kept(name)})" for name in order)
    return f"WITH {parts}\n{sql}"
