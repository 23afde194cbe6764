"""Queries over derived columns, filters, rules, report sections and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook.functions import flags, identity, labels, money, text, timing
from leadbook.operators import arrivals, catalogue, crosstabs, distributions, export, rules, summaries
from leadbook.operators import labels as label_ops
from leadbook.operators.filters import Filters, apply_filters, apply_segment, value_list
from leadbook.plans import report as plan
from leadbook.plans.book import build_lead_book
from leadbook.runtime import scratch_path
from leadbook.sources.lead_table import write_export
from workload.lead_export import lead_export, table
from workload.oracle_tables import (
    FIELDS,
    FOLDED,
    HWC,
    QUALITY,
    band,
    budget,
    clean,
    configuration,
    configuration_tokens,
    oracle,
    phone,
    shared,
    stamp,
    status,
)
from workload.registry import ORACLES, query
from workload.tables import RULES, classified, lead_book, prepared, prepared_fields

BAND_POSITION = "list_position([" + ", ".join(f"'{b}'" for b in money.BAND_LABELS) + "], {})"


# ── derived columns ──────────────────────────────────────────────────────────

@query("B1 B2 B3", oracle(f"SELECT row_ord, v AS budget_value, {band('v')} AS budget_bucket, round(v / 100, 2) AS crore FROM (SELECT row_ord, {budget(clean('budget'))} AS v FROM leads)", "leads"))
def budgets_parsed(spark, sf_dir):
    out = label_ops.with_budget(lead_export(spark, sf_dir))
    return out.select("row_ord", "budget_value", "budget_bucket", money.crore(F.col("budget_value")).alias("crore"))


@query(
    "B2",
    f"SELECT o_orderkey, v AS lakh, {band('v')} AS band FROM (SELECT o_orderkey, floor(o_totalprice / 200) AS v FROM orders)",
)
def price_bands(spark, sf_dir):
    """Bands over the whole range of amounts, from the orders' totals."""
    lakh = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 200).cast("double").alias("lakh"))
    return lakh.withColumn("band", money.budget_band(F.col("lakh")))


@query("B4", oracle(f"SELECT row_ord, {configuration('configuration_required')} AS configuration FROM leads", "leads"))
def configurations_spelled(spark, sf_dir):
    return lead_export(spark, sf_dir).select("row_ord", labels.normalize_configuration(F.col("configuration_required")).alias("configuration"))


def _usual_spelling(field: str) -> str:
    return (
        f"SELECT lower(v) AS k, v AS canonical FROM (SELECT v, row_number() OVER (PARTITION BY lower(v) ORDER BY n DESC, v) AS rn"
        f" FROM (SELECT {clean(field)} AS v, count(*) AS n FROM leads GROUP BY 1) WHERE v IS NOT NULL) WHERE rn = 1"
    )


@query(
    "B5 J2",
    oracle(
        "SELECT row_ord, " + ", ".join(f"r_{f}.canonical AS {f}" for f in FOLDED) + " FROM leads "
        + " ".join(f"LEFT JOIN ({_usual_spelling(f)}) r_{f} ON r_{f}.k = lower({clean('leads.' + f)})" for f in FOLDED),
        "leads",
    ),
)
def case_variants_folded(spark, sf_dir):
    return label_ops.fold_case(lead_export(spark, sf_dir)).select("row_ord", *FOLDED)


@query("B6", oracle(f"SELECT row_ord, {configuration_tokens(clean('configuration_required'))} AS configuration FROM leads", "leads"))
def configuration_tokens_folded(spark, sf_dir):
    return lead_export(spark, sf_dir).select("row_ord", labels.configuration_synonyms(F.col("configuration_required")).alias("configuration"))


@query(
    "B7",
    oracle(
        f"SELECT row_ord, {status(clean('buying_status'), 'buying_status')} AS buying_status, {status(clean('call_status'), 'call_status')} AS call_status FROM leads",
        "leads",
    ),
)
def statuses_folded(spark, sf_dir):
    return lead_export(spark, sf_dir).select(
        "row_ord", *[labels.status_synonyms(F.col(f), f).alias(f) for f in ("buying_status", "call_status")]
    )


@query(
    "B8",
    oracle(f"SELECT phone_normalized, name_key, budget_value, budget_bucket, {', '.join(FIELDS)} FROM prepared", "prepared"),
)
def prepared_frame(spark, sf_dir):
    out = label_ops.prepare_frame(lead_book(spark, sf_dir))
    return out.select("phone_normalized", "name_key", "budget_value", "budget_bucket", *FIELDS)


@query("B9 B10", oracle(f"SELECT row_ord, {HWC} AS is_hwc, {QUALITY} AS is_quality FROM leads", "leads"))
def lead_flags(spark, sf_dir):
    hwc = flags.hwc_flag(F.col("hwc"), F.col("client_status"))
    quality = flags.quality_flag(F.col("buying_status"), F.col("interest_level"))
    return lead_export(spark, sf_dir).select("row_ord", hwc.alias("is_hwc"), quality.alias("is_quality"))


_EVENT_FORMATS = ("yyyy-MM-dd - HH:mm", "yyyy-MM-dd - HH:mm:ss", "d-MMM-yy", "dd MMM yyyy, hh:mm a", "dd/MM/yyyy HH:mm", "MMMM d, yyyy", "yyyy-MM-dd HH:mm:ss")


@query(
    "B11 B13",
    "SELECT event_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS stamp, (hour(s) <> 0 OR minute(s) <> 0) AS timed FROM (SELECT event_id,"
    " CASE event_id % 7 WHEN 1 THEN date_trunc('second', ts) WHEN 6 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts)"
    " WHEN 5 THEN date_trunc('day', ts) ELSE date_trunc('minute', ts) END AS s FROM events)",
)
def timestamps_parsed(spark, sf_dir):
    """Every event's time written in one of seven ways, then read back."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    written = reduce(
        lambda chain, i: chain.when(F.col("event_id") % 7 == i, F.date_format("ts", _EVENT_FORMATS[i])),
        range(1, 7),
        F.when(F.col("event_id") % 7 == 0, F.date_format("ts", _EVENT_FORMATS[0])),
    )
    read = table(spark, sf_dir, "events").select("event_id", timing.parse_timestamp(written).alias("s"))
    return read.select("event_id", F.date_format("s", "yyyy-MM-dd HH:mm:ss").alias("stamp"), timing.has_clock_time(F.col("s")).alias("timed"))


@query("B12", oracle(f"SELECT row_ord, strftime({stamp('first_call_date')}, '%Y-%m-%d') AS day FROM leads", "leads"))
def stamp_column_chosen(spark, sf_dir):
    """With no readable `date`, the whole frame falls back to the first call date."""
    df = lead_export(spark, sf_dir).withColumn("date", F.lit("soon"))
    return arrivals.with_stamp(df).select("row_ord", F.date_format("stamp", "yyyy-MM-dd").alias("day"))


# ── filters ──────────────────────────────────────────────────────────────────

@query(
    "F1 F3 J3",
    oracle(
        "SELECT phone_normalized, name_key, budget_value FROM flagged WHERE source_file = 'crm_a.csv' AND budget_value BETWEEN 80 AND 600"
        " AND configuration_required IN ('4BHK', '4BHK, 5BHK', 'Bungalow') AND call_status IN ('Spoken', 'Call back later')"
        " AND buying_status IN ('Interested', 'Not interested', 'Postponed')",
        "flagged",
    ),
)
def leads_filtered(spark, sf_dir):
    wanted = Filters(
        source_file="crm_a.csv", budget_min=0.8, budget_max=6.0,
        configuration=value_list(["4BHK", "4BHK, 5BHK", "Bungalow"]),
        call_status=value_list("Spoken, Call back later"),
        buying_status=value_list(("Interested", "Not interested", "Postponed")),
    )
    return apply_filters(prepared(spark, sf_dir), wanted).select("phone_normalized", "name_key", "budget_value")


@query(
    "F2 B9",
    oracle(
        "SELECT 'hwc' AS segment, count(*) AS leads FROM verdicts WHERE is_hwc UNION ALL"
        " SELECT lead_class, count(*) FROM verdicts WHERE lead_class IN ('good', 'bad') GROUP BY 1 UNION ALL"
        " SELECT 'other', count(*) FROM verdicts",
        "verdicts",
    ),
)
def segments(spark, sf_dir):
    """Each segment's size; an unknown segment keeps everything, good without rules nothing."""
    frame = prepared(spark, sf_dir)
    parts = [apply_segment(frame, s, RULES).select(F.lit(s).alias("segment")) for s in ("hwc", "good", "bad", "other")]
    parts.append(apply_segment(frame, "good", []).select(F.lit("none").alias("segment")))
    return reduce(DataFrame.unionByName, parts).groupBy("segment").agg(F.count(F.lit(1)).alias("leads"))


@query(
    "F4 Q7",
    oracle(
        "SELECT value, count(*) AS \"count\", round(count(*) / sum(count(*)) OVER (), 4) AS share FROM (SELECT configuration_required AS value"
        " FROM flagged WHERE is_hwc AND budget_value >= 200) WHERE value IS NOT NULL GROUP BY 1",
        "flagged",
    ),
)
def filtered_report(spark, sf_dir):
    """One section of the report of a slice, with the labels of the whole book."""
    sliced = apply_filters(prepared(spark, sf_dir), Filters(budget_min=2.0, hwc_only=True))
    return plan.full_report(sliced, staged=False)["distributions"].filter(F.col("field") == "configuration").drop("field")


@query("F7", oracle("SELECT row_ord, CASE WHEN name IS NULL THEN '' ELSE split_part(name, ' ', 1) END AS fn, CASE WHEN name IS NULL THEN '' ELSE trim(substr(name, length(split_part(name, ' ', 1)) + 1)) END AS ln FROM leads", "leads"))
def names_split(spark, sf_dir):
    styled = lead_export(spark, sf_dir).select("row_ord", text.style_ascii(F.col("name")).alias("name"))
    first, last = identity.name_parts(F.col("name"))
    return styled.select("row_ord", first.alias("fn"), last.alias("ln"))


@query(
    "F6 F8",
    oracle(
        f"SELECT row_ord, coalesce('+91' || {phone('phone')}, '') AS e164, CAST(round({budget('budget')} * 100000) AS BIGINT) AS rupees,"
        " coalesce(nullif(trim(lead_for_project), ''), nullif(trim(campaign), '')) AS first_present FROM leads",
        "leads",
    ),
)
def contact_values(spark, sf_dir):
    df = lead_export(spark, sf_dir)
    return df.select(
        "row_ord",
        identity.e164(F.col("phone")).alias("e164"),
        money.rupees(money.parse_budget(F.col("budget"))).alias("rupees"),
        F.coalesce(text.present(F.col("lead_for_project")), text.present(F.col("campaign"))).alias("first_present"),
    )


# ── rules ────────────────────────────────────────────────────────────────────

@query(
    "R2 R3",
    oracle(
        f"SELECT row_ord, coalesce({clean('call_status')} IN ('Spoken', 'Not spoken'), false) AS one_of,"
        f" coalesce({clean('call_status')} NOT IN ('Spoken'), false) AS not_one_of, {clean('hwc')} IS NULL AS is_blank,"
        f" {clean('hwc')} IS NOT NULL AS has_value, coalesce(contains(lower({clean('campaign')}), 'build') OR contains(lower({clean('campaign')}), 'auto'), false) AS has_text,"
        f" true AS absent_blank, false AS absent_value, coalesce({clean('call_status')} = 'Spoken', false) AND {clean('hwc')} IS NOT NULL AS both FROM leads",
        "leads",
    ),
)
def rule_predicates(spark, sf_dir):
    df = lead_export(spark, sf_dir)
    test = lambda field, op, *values: rules.condition_column(df, {"field": field, "op": op, "values": list(values)})
    both = rules.rule_column(
        df,
        {"conditions": [{"field": "call_status", "op": "is", "values": ["Spoken"]}, {"field": "hwc", "op": "is_not_empty", "values": []}]},
    )
    return df.select(
        "row_ord",
        test("call_status", "is", "Spoken", "Not spoken").alias("one_of"),
        test("call_status", "is_not", "Spoken").alias("not_one_of"),
        test("hwc", "is_empty").alias("is_blank"),
        test("hwc", "is_not_empty").alias("has_value"),
        test("campaign", "contains", "BUILD", "auto").alias("has_text"),
        test("visit_status", "is_empty").alias("absent_blank"),
        test("visit_status", "is_not", "x").alias("absent_value"),
        both.alias("both"),
    )


@query("R4 R5 U2", oracle("SELECT phone_normalized, name_key, lead_class, lead_class_reason FROM verdicts", "verdicts"))
def leads_classified(spark, sf_dir):
    out = rules.classify(prepared(spark, sf_dir), rules.validate_rules(RULES))
    return out.select("phone_normalized", "name_key", "lead_class", "lead_class_reason")


@query(
    "R6",
    oracle(
        "SELECT count(*) AS total, count(*) FILTER (WHERE lead_class = 'good') AS good, count(*) FILTER (WHERE lead_class = 'bad') AS bad,"
        " count(*) FILTER (WHERE lead_class = 'unclassified') AS unclassified,"
        " round(count(*) FILTER (WHERE lead_class <> 'unclassified') / count(*), 4) AS classified_share FROM verdicts",
        "verdicts",
    ),
)
def classification_counts(spark, sf_dir):
    return rules.classification_summary(classified(spark, sf_dir))


@query(
    "R5 R6 K6",
    oracle(
        "SELECT lead_class_reason AS reason, count(*) AS \"count\", round(count(*) / sum(count(*)) OVER (), 4) AS share FROM verdicts"
        " WHERE lead_class = 'unclassified' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8",
        "verdicts",
    ),
)
def unclassified_reasons(spark, sf_dir):
    return rules.unclassified_reasons(classified(spark, sf_dir))


_CATALOGUED = [f for f in FIELDS if f not in ("name", "email", "phone", "qualitative_remarks")]


def _catalogue_sql(select: str) -> str:
    cells = ", ".join(f"{{'field': '{f}', 'value': {clean(f)}}}" for f in [*_CATALOGUED, "source_file", "budget_bucket"])
    return oracle(
        "SELECT " + select + " FROM (SELECT field, value, count(*) AS n FROM (SELECT unnest([" + cells + "], recursive := true) FROM prepared)"
        " WHERE value IS NOT NULL GROUP BY ALL) WHERE field IN (SELECT field FROM (SELECT unnest([" + cells + "], recursive := true) FROM prepared)"
        " GROUP BY 1 HAVING count(DISTINCT value) BETWEEN 1 AND 300)",
        "prepared",
    )


@query("R7", _catalogue_sql("field, value, n"))
def field_values_offered(spark, sf_dir):
    return catalogue.field_values(prepared(spark, sf_dir))


@query(
    "R7",
    _catalogue_sql(
        "field, replace(field, '_', ' ') AS label, false AS from_notes, sum(n)::BIGINT AS filled,"
        " round(sum(n) / (SELECT count(*) FROM prepared), 4) AS fill_rate, array_to_string(list_sort(list(value)), ' | ') AS \"values\""
    ) + " GROUP BY field",
)
def field_catalogue(spark, sf_dir):
    return catalogue.field_catalogue(prepared(spark, sf_dir)).withColumn("values", F.array_join("values", " | "))


@query(
    "R8",
    oracle(
        "SELECT " + ", ".join(f"coalesce({f}, '') AS {f}" for f in rules.PREVIEW_FIELDS)
        + " FROM verdicts WHERE lead_class = 'good' ORDER BY row_ord LIMIT 25",
        "verdicts",
    ),
)
def good_leads_preview(spark, sf_dir):
    return rules.good_preview(classified(spark, sf_dir), 25)


@query(
    "R9",
    oracle(
        "SELECT CASE WHEN is_hwc THEN 'good' ELSE 'unclassified' END AS lead_class, count(*) AS leads FROM"
        f" (SELECT {clean('hwc')} IS NOT NULL AS is_hwc FROM prepared) GROUP BY 1",
        "prepared",
    ),
)
def rules_changed(spark, sf_dir):
    """Other rules over the same stored prepared frame."""
    others = [{"conditions": [{"field": "hwc", "op": "is_not_empty", "values": []}], "category": "good"}]
    out = rules.classify(prepared(spark, sf_dir), others)
    return out.groupBy("lead_class").agg(F.count(F.lit(1)).alias("leads"))


# ── distributions and cross-tabs ─────────────────────────────────────────────

@query(
    "A1 A9 A10",
    oracle("SELECT field, value, \"count\", round(\"count\" / sum(\"count\") OVER (PARTITION BY field), 4) AS share FROM counts", "counts"),
)
def distributions_all(spark, sf_dir):
    """All charted fields in one pass."""
    return distributions.distribution(plan.report_counts(prepared(spark, sf_dir)))


@query(
    "A5",
    oracle(
        "SELECT field, value, \"count\", share FROM (SELECT *, round(\"count\" / sum(\"count\") OVER (PARTITION BY field), 4) AS share,"
        " row_number() OVER (PARTITION BY field ORDER BY \"count\" DESC, value) AS rn FROM counts) WHERE rn <= 6",
        "counts",
    ),
)
def top_values(spark, sf_dir):
    return distributions.distribution(plan.report_counts(prepared(spark, sf_dir)), top=6)


@query(
    "K1",
    oracle(
        "SELECT field, CASE WHEN k <= 8 OR rn < 8 THEN value ELSE 'Other' END AS label, sum(\"count\")::BIGINT AS \"count\", min(least(rn, 8)) AS position,"
        " CASE WHEN k > 8 AND max(rn) >= 8 THEN count(*) ELSE 0 END AS folded FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY \"count\" DESC, value) AS rn,"
        " count(*) OVER (PARTITION BY field) AS k FROM counts) GROUP BY field, k, 2",
        "counts",
    ),
)
def chart_slices(spark, sf_dir):
    return distributions.fold_slices(plan.report_counts(prepared(spark, sf_dir)))


# What the cross-tabs and the rules read of a lead.
_AXIS_FIELDS = ("configuration_required", "budget", "hwc", "client_status", "buying_status", "call_status")
_RULE_FIELDS = ("buying_status", "budget", "call_status", "hwc", "visit_status", "facebook_page")


@query("A2 A11", oracle("SELECT * FROM crosstab", "crosstab"))
def crosstabs_all(spark, sf_dir):
    """The five fixed cross-tabs in one pass, non-empty cells with marginal totals."""
    return crosstabs.crosstab(plan.report_cells(prepared_fields(spark, sf_dir, _AXIS_FIELDS)))


@query(
    "A2 K4",
    oracle(
        "SELECT section, sum(CASE WHEN row_label IS NOT NULL AND col_label IS NOT NULL THEN n ELSE 0 END)::BIGINT AS counted, sum(n)::BIGINT AS total,"
        " sum(CASE WHEN row_label IS NULL THEN n ELSE 0 END)::BIGINT AS missing_rows, sum(CASE WHEN col_label IS NULL THEN n ELSE 0 END)::BIGINT AS missing_cols,"
        " sum(CASE WHEN row_label IS NOT NULL AND col_label IS NOT NULL THEN n ELSE 0 END) / sum(n) < 0.25 AS thin FROM cells GROUP BY 1",
        "cells",
    ),
)
def crosstab_coverage(spark, sf_dir):
    return crosstabs.coverage(plan.report_cells(prepared(spark, sf_dir)))


@query(
    "A2",
    oracle(
        "SELECT row_label, "
        + ", ".join(f"coalesce(sum(n) FILTER (WHERE col_label = '{b}'), 0)::BIGINT AS \"{b}\"" for b in money.BAND_LABELS)
        + " FROM cells WHERE section = 'config_x_budget' AND row_label IS NOT NULL AND col_label IS NOT NULL GROUP BY 1",
        "cells",
    ),
)
def configuration_by_budget_grid(spark, sf_dir):
    """One cross-tab as a full grid over the fixed price bands."""
    frame = prepared_fields(spark, sf_dir, ("configuration_required", "budget"))
    section = {"config_x_budget": plan.crosstab_sections(frame)["config_x_budget"]}
    return crosstabs.wide_crosstab(crosstabs.crosstab_cells(frame, section), "config_x_budget", list(money.BAND_LABELS))


@query(
    "A12",
    oracle(
        "SELECT section, row_label, col_label, n, sum(n) OVER (PARTITION BY section, row_label)::BIGINT AS row_total,"
        " sum(n) OVER (PARTITION BY section, col_label)::BIGINT AS col_total FROM class_cells WHERE row_label IS NOT NULL AND col_label IS NOT NULL",
        "class_cells",
    ),
)
def class_crosstabs(spark, sf_dir):
    fields = (*_AXIS_FIELDS, *(f for f in _RULE_FIELDS if f not in _AXIS_FIELDS))
    frame = rules.classify(prepared_fields(spark, sf_dir, fields), RULES)
    sections = {name: axes for name, axes in plan.crosstab_sections(frame).items() if name.startswith("lead_class")}
    return crosstabs.crosstab(crosstabs.crosstab_cells(frame, sections))


@query(
    "A12",
    oracle(
        "SELECT CASE lead_class WHEN 'good' THEN 'Good' ELSE 'Bad' END AS value, count(*) AS \"count\","
        " round(count(*) / sum(count(*)) OVER (), 4) AS share FROM verdicts WHERE lead_class <> 'unclassified' GROUP BY 1",
        "verdicts",
    ),
)
def class_distribution(spark, sf_dir):
    frame = classified(spark, sf_dir)
    return distributions.value_counts(frame, summaries.class_label(frame))


# City by day of first contact: axes long enough to fold on both sides.
_FOLDED_CELLS = (
    f"SELECT row_label, col_label, count(*) AS n FROM (SELECT {clean('current_city')} AS row_label,"
    f" {clean('facebook_ad_set')} AS col_label FROM prepared) WHERE row_label IS NOT NULL AND col_label IS NOT NULL GROUP BY ALL"
)


@query(
    "K2 K3",
    oracle(
        "SELECT 'city_x_ad_set' AS section, r.row_position, r.row_name AS row_label, c.col_position, c.col_name AS col_label,"
        " coalesce(sum(n), 0)::BIGINT AS n, round(coalesce(sum(n), 0) / max(r.row_sum) * 100, 2) AS row_percent"
        " FROM (SELECT DISTINCT row_position, row_name, sum(t) OVER (PARTITION BY row_position) AS row_sum FROM fr) r"
        " CROSS JOIN (SELECT DISTINCT col_position, col_name FROM fc) c"
        " LEFT JOIN (SELECT fr.row_position, fc.col_position, n FROM fcells JOIN fr USING (row_label) JOIN fc USING (col_label)) x"
        " ON x.row_position = r.row_position AND x.col_position = c.col_position GROUP BY ALL",
        "prepared",
    ).replace(
        "\nSELECT 'city_x_ad_set'",
        f",\nfcells AS ({_FOLDED_CELLS}),\n"
        "fr AS (SELECT row_label, t, CASE WHEN k > 11 THEN least(rn, 11) ELSE rn END AS row_position,"
        " CASE WHEN k > 11 AND rn >= 11 THEN 'Other (' || (k - 10) || ' categories)' ELSE row_label END AS row_name FROM (SELECT row_label, sum(n) AS t,"
        " row_number() OVER (ORDER BY sum(n) DESC, row_label) AS rn, count(*) OVER () AS k FROM fcells GROUP BY 1)),\n"
        "fc AS (SELECT col_label, CASE WHEN k > 8 THEN least(rn, 8) ELSE rn END AS col_position,"
        " CASE WHEN k > 8 AND rn >= 8 THEN 'Other' ELSE col_label END AS col_name FROM (SELECT col_label,"
        " row_number() OVER (ORDER BY sum(n) DESC, col_label) AS rn, count(*) OVER () AS k FROM fcells GROUP BY 1))"
        "\nSELECT 'city_x_ad_set'",
    ),
)
def chart_matrix(spark, sf_dir):
    """A cross-tab with both axes folded, as counts and as shares of each row."""
    frame = prepared(spark, sf_dir)
    section = {"city_x_ad_set": (F.col("current_city"), F.col("facebook_ad_set"))}
    return crosstabs.fold_matrix(crosstabs.crosstab_cells(frame, section))


# ── summary sections ─────────────────────────────────────────────────────────

@query("A3 A8", oracle("SELECT count(*) AS total_leads, round(avg(is_quality::INT), 4) AS quality_rate FROM flagged", "flagged"))
def report_meta(spark, sf_dir):
    return summaries.report_meta(prepared(spark, sf_dir))


@query("A8", oracle("SELECT DISTINCT 'source_file' AS kind, source_file AS value FROM book", "book"))
def report_scope(spark, sf_dir):
    return summaries.report_scope(prepared(spark, sf_dir))


@query("A3", oracle("SELECT round(avg(is_quality::INT), 4) AS quality_rate FROM flagged", "flagged"))
def quality_rate(spark, sf_dir):
    return summaries.quality_rate(prepared(spark, sf_dir))


@query(
    "A4 B3",
    oracle(
        "SELECT count(*) AS total_rows, count(budget_value) AS parsed_count, count(*) - count(budget_value) AS unparsed_count,"
        " round(min(budget_value) / 100, 2) AS min, round(max(budget_value) / 100, 2) AS max, round(median(budget_value) / 100, 2) AS median,"
        " round(avg(budget_value) / 100, 2) AS mean FROM prepared",
        "prepared",
    ),
)
def budget_summary(spark, sf_dir):
    return summaries.budget_summary(summaries.budget_counts(prepared(spark, sf_dir)))


@query(
    "A4",
    oracle(
        f"SELECT budget_bucket AS label, {BAND_POSITION.format('budget_bucket')} AS position, count(*) AS \"count\", round(min(budget_value) / 100, 2) AS min,"
        " round(max(budget_value) / 100, 2) AS max, round(avg(is_quality::INT), 4) AS quality_rate FROM flagged WHERE budget_bucket IS NOT NULL GROUP BY 1",
        "flagged",
    ),
)
def budget_bands(spark, sf_dir):
    return summaries.budget_bands(summaries.budget_counts(prepared(spark, sf_dir)))


@query("A5", oracle("SELECT count(*) AS total, count(*) FILTER (WHERE is_hwc) AS hwc, round(avg(is_hwc::INT), 4) AS hwc_share FROM flagged", "flagged"))
def priority_summary(spark, sf_dir):
    return summaries.core_summary(prepared(spark, sf_dir))


@query("A5", oracle("SELECT CASE WHEN is_hwc THEN 'HWC-marked' ELSE 'Not marked' END AS label, count(*) AS \"count\" FROM flagged GROUP BY 1", "flagged"))
def priority_split(spark, sf_dir):
    return summaries.hwc_split(prepared(spark, sf_dir))


@query(
    "A6",
    oracle(
        "SELECT coalesce(nullif(trim(name), ''), '(no name)') AS name, "
        + ", ".join(
            f"nullif(trim({c}), '') AS {a}"
            for c, a in (("phone", "phone"), ("hwc", "hwc"), ("budget", "budget"), ("configuration_required", "configuration"),
                         ("buying_status", "buying_status"), ("call_status", "call_status"), ("qualitative_remarks", "remarks"))
        )
        + " FROM flagged WHERE is_hwc ORDER BY budget_value DESC NULLS LAST, row_ord LIMIT 20",
        "flagged",
    ),
)
def call_list(spark, sf_dir):
    return summaries.call_list(prepared(spark, sf_dir))


@query(
    "A7",
    oracle(
        " UNION ALL ".join(
            f"SELECT '{f}' AS field, count({clean(f)}) AS filled, count(*) - count({clean(f)}) AS missing, round(count({clean(f)}) / count(*), 4) AS fill_rate FROM prepared"
            for f in summaries.TRACKED_FIELDS
        ),
        "prepared",
    ),
)
def data_quality(spark, sf_dir):
    return summaries.data_quality(prepared(spark, sf_dir))


@query(
    "A7",
    oracle("SELECT count(*) AS total_leads, count(*) FILTER (WHERE merged_row_count > 1) AS merged_leads, sum(merged_row_count - 1)::BIGINT AS rows_absorbed FROM book", "book"),
)
def merge_quality(spark, sf_dir):
    return summaries.merge_quality(lead_book(spark, sf_dir))


@query(
    "A13",
    oracle(
        "SELECT * FROM (VALUES ('budget', true), ('buying_status', true), ('buying_status_x_config', true), ('call_status', true),"
        " ('call_status_x_buying', true), ('classification', true), ('config_x_budget', true), ('configuration', true), ('hwc', true),"
        " ('hwc_x_budget', true), ('hwc_x_config', true), ('lead_class_x_budget', true), ('lead_class_x_call_status', true),"
        " ('lead_class_x_config', true), ('marketing', true), ('marketing_ad_sets', false), ('marketing_campaigns', true),"
        " ('marketing_pages', true), ('time', true), ('time_of_day', (SELECT count(*) >= 30 FROM stamped WHERE hour(stamp) <> 0 OR minute(stamp) <> 0))) v(section, available)",
        "stamped",
    ),
)
def sections_available(spark, sf_dir):
    """Which sections have data, for a book without its ad sets."""
    frame = classified(spark, sf_dir).withColumn("facebook_ad_set", F.lit(None).cast("string"))
    return plan.availability(
        plan.report_counts(frame),
        plan.report_cells(frame),
        summaries.budget_counts(frame),
        arrivals.arrival_header(arrivals.arrival_counts(arrivals.with_stamp(frame))),
        summaries.core_summary(frame),
    )


@query(
    "K5",
    oracle(
        "SELECT 'total_leads' AS tile, count(*)::VARCHAR AS value, NULL::DOUBLE AS detail FROM flagged UNION ALL"
        " SELECT 'hwc_marked', count(*) FILTER (WHERE is_hwc)::VARCHAR, round(avg(is_hwc::INT), 4) FROM flagged UNION ALL"
        " SELECT 'median_budget', round(median(budget_value) / 100, 2)::VARCHAR, count(budget_value) FROM flagged UNION ALL"
        " (SELECT 'top_configuration', value, round(\"count\" / (SELECT sum(\"count\") FROM counts WHERE field = 'configuration'), 4) FROM counts"
        " WHERE field = 'configuration' ORDER BY \"count\" DESC, value LIMIT 1)",
        "flagged", "counts",
    ),
)
def headline_tiles(spark, sf_dir):
    frame = prepared(spark, sf_dir)
    counts = distributions.field_counts(frame, {"configuration": F.col("configuration_required")})
    return summaries.headline(frame, summaries.budget_counts(frame), distributions.distribution(counts))


@query("K7", oracle("SELECT DISTINCT section, CASE section " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in plan.CAPTIONS.items()) + " END AS caption FROM crosstab", "crosstab"))
def chart_captions(spark, sf_dir):
    return plan.captions(plan.report_cells(prepared(spark, sf_dir)))


@query("K8", oracle("SELECT row_ord, substr(trim(qualitative_remarks), 1, 120) AS remark FROM prepared WHERE trim(qualitative_remarks) <> '' ORDER BY row_ord LIMIT 40", "prepared"))
def remark_sample(spark, sf_dir):
    return summaries.remark_sample(prepared(spark, sf_dir))


# ── arrivals ─────────────────────────────────────────────────────────────────

_DAYS = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"
_TIMED = "(hour(stamp) <> 0 OR minute(stamp) <> 0)"


def _arrivals(spark, sf_dir) -> DataFrame:
    return arrivals.arrival_counts(arrivals.with_stamp(prepared(spark, sf_dir)))


@query(
    "W3 W7 B12",
    oracle(
        f"SELECT count(stamp) AS dated_leads, count(*) AS total_leads, count(*) FILTER (WHERE {_TIMED}) AS timed_leads,"
        " strftime(min(stamp), '%Y-%m-%d %H:%M') AS range_start, strftime(max(stamp), '%Y-%m-%d %H:%M') AS range_end,"
        f" count(stamp) > 0 AS available, count(*) FILTER (WHERE {_TIMED}) >= 30 AS has_time_of_day, 30::BIGINT AS min_timed_leads FROM stamped",
        "stamped",
    ),
)
def arrival_header(spark, sf_dir):
    header = arrivals.arrival_header(_arrivals(spark, sf_dir))
    return header.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("range_start", "range_end")})


@query(
    "W1",
    oracle(
        f"SELECT d::INT AS weekday, {_DAYS}[d + 1] AS label, (SELECT count(*) FROM stamped WHERE isodow(stamp) = d + 1) AS \"count\" FROM range(7) t(d)",
        "stamped",
    ),
)
def arrivals_by_weekday(spark, sf_dir):
    return arrivals.by_weekday(_arrivals(spark, sf_dir))


@query("W2", oracle("SELECT strftime(stamp, '%Y-%m') AS label, count(*) AS \"count\" FROM stamped WHERE stamp IS NOT NULL GROUP BY 1", "stamped"))
def arrivals_by_month(spark, sf_dir):
    return arrivals.by_month(_arrivals(spark, sf_dir))


@query(
    "W4",
    oracle(
        f"SELECT h::INT AS hour, lpad(h::VARCHAR, 2, '0') || ':00' AS label, (SELECT count(*) FROM stamped WHERE {_TIMED} AND hour(stamp) = h) AS \"count\""
        f" FROM range(24) t(h) WHERE (SELECT count(*) FROM stamped WHERE {_TIMED}) >= 30",
        "stamped",
    ),
)
def arrivals_by_hour(spark, sf_dir):
    return arrivals.by_hour(_arrivals(spark, sf_dir))


@query(
    "W5",
    oracle(
        f"SELECT d::INT AS weekday, {_DAYS}[d + 1] AS day, h::INT AS hour, (SELECT count(*) FROM stamped WHERE {_TIMED} AND isodow(stamp) = d + 1 AND hour(stamp) = h) AS n"
        f" FROM range(7) t(d), range(24) u(h) WHERE (SELECT count(*) FROM stamped WHERE {_TIMED}) >= 30",
        "stamped",
    ),
)
def arrivals_weekday_by_hour(spark, sf_dir):
    return arrivals.weekday_by_hour(_arrivals(spark, sf_dir))


@query(
    "W6",
    oracle(
        f"SELECT * FROM (SELECT 'weekday' AS kind, {_DAYS}[isodow(stamp)] AS label, count(*) AS \"count\" FROM stamped WHERE stamp IS NOT NULL"
        " GROUP BY isodow(stamp) ORDER BY 3 DESC, isodow(stamp) LIMIT 1) UNION ALL SELECT * FROM (SELECT 'hour',"
        " lpad(hour(stamp)::VARCHAR, 2, '0') || ':00–' || lpad(((hour(stamp) + 1) % 24)::VARCHAR, 2, '0') || ':00', count(*) FROM stamped"
        f" WHERE {_TIMED} AND (SELECT count(*) FROM stamped WHERE {_TIMED}) >= 30 GROUP BY hour(stamp) ORDER BY 3 DESC, hour(stamp) LIMIT 1)",
        "stamped",
    ),
)
def arrival_peaks(spark, sf_dir):
    return arrivals.peaks(_arrivals(spark, sf_dir))


# ── whole report and exports ─────────────────────────────────────────────────

# Sections of the report that a query of its own covers: that query, and the columns as text, whole or decimal numbers.
_SECTIONS = {
    "scope": ("report_scope", "kind value", "", ""),
    "data_quality": ("data_quality", "field", "filled missing", "fill_rate"),
    "core": ("priority_summary", "", "total hwc", "hwc_share"),
    "hwc_split": ("priority_split", "label", "count", ""),
    "call_list": ("call_list", "name phone hwc budget configuration buying_status call_status remarks", "", ""),
    "budget": ("budget_summary", "", "total_rows parsed_count unparsed_count", "min max median mean"),
    "budget_bands": ("budget_bands", "label", "position count", "min max quality_rate"),
    "arrivals": ("arrival_header", "", "dated_leads total_leads timed_leads", ""),
    "by_weekday": ("arrivals_by_weekday", "label", "weekday count", ""),
    "by_month": ("arrivals_by_month", "label", "count", ""),
    "by_hour": ("arrivals_by_hour", "label", "hour count", ""),
    "weekday_by_hour": ("arrivals_weekday_by_hour", "day", "weekday hour n", ""),
    "peaks": ("arrival_peaks", "kind label", "count", ""),
    "headline": ("headline_tiles", "tile value", "", "detail"),
    "remarks": ("remark_sample", "remark", "row_ord", ""),
    "merge_quality": ("merge_quality", "", "total_leads merged_leads rows_absorbed", ""),
    "classification": ("classification_counts", "", "total good bad unclassified", "classified_share"),
    "unclassified_reasons": ("unclassified_reasons", "reason", "count", "share"),
}
# Tables of all fields or cross-tabs: the book's part, and the part that the classes add.
_TABLES = {
    "distributions": (("distributions_all", "class_distribution"), "field value", "count", "share"),
    "crosstabs": (("crosstabs_all", "class_crosstabs"), "section row_label col_label", "n row_total col_total", ""),
}


def _row_text(names: str, whole: str, decimal: str, text_of, number_of) -> list:
    """The cells of a row as texts, from functions that render a text, whole or decimal column."""
    return [text_of(c) for c in names.split()] + [number_of(c, 0) for c in whole.split()] + [number_of(c, 4) for c in decimal.split()]


def _section_sql(section: str, sources: tuple[str, ...], names: str, whole: str, decimal: str) -> str:
    text_of = lambda c: f"coalesce(CAST(\"{c}\" AS VARCHAR), '-')"
    number_of = lambda c, places: f"coalesce(CAST(CAST(\"{c}\" AS DECIMAL(20,{places})) AS VARCHAR), '-')"
    cells = " || '|' || ".join(_row_text(names, whole, decimal, text_of, number_of))
    parts = []
    for source in sources:
        extra = "'lead_class' AS field, " if source == "class_distribution" else ""
        parts.append(f"SELECT '{section}' AS section, {cells} AS cells FROM (SELECT {extra}* FROM ({ORACLES[source]}))")
    return " UNION ALL ".join(parts)


def _full_report_sql(leave_out: tuple[str, ...] = ()) -> str:
    sections = {name: ((source,), *kinds) for name, (source, *kinds) in _SECTIONS.items()} | _TABLES
    return " UNION ALL ".join(_section_sql(name, *spec) for name, spec in sections.items() if name not in leave_out)


# Sections whose SQL reads the book before it is prepared, which a filter does not narrow.
_UNFILTERED = ("scope", "merge_quality")


def _filtered_sql(condition: str) -> str:
    """The report's SQL with every section reading only the prepared leads that meet the condition."""
    sources = [s for name, (s, *_) in _SECTIONS.items() if name not in _UNFILTERED]
    sources += [s for both, *_ in _TABLES.values() for s in both]
    return shared(_full_report_sql(_UNFILTERED), {"prepared": condition}, *[ORACLES[s] for s in sources])


def _report_rows(report, wanted: set[str]) -> DataFrame:
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    number_of = lambda c, places: F.coalesce(F.col(c).cast(f"decimal(20,{places})").cast("string"), F.lit("-"))
    sections = {name: kinds for name, (_, *kinds) in (_SECTIONS | _TABLES).items() if name in wanted}
    rows = [
        report[name].select(F.lit(name).alias("section"), F.concat_ws("|", *_row_text(*kinds, text_of, number_of)).alias("cells"))
        for name, kinds in sections.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query("A14 R9", _full_report_sql())
def full_report(spark, sf_dir):
    """The rows of the classified report's sections, each as one text."""
    return _report_rows(plan.full_report(prepared(spark, sf_dir), RULES), set(_SECTIONS | _TABLES))


@query("F4 A14 Q7", _filtered_sql("budget_value BETWEEN 80 AND 600 AND source_file = 'crm_a.csv'"))
def filtered_sections(spark, sf_dir):
    """All sections of a filtered report, summed from the cube of the whole book."""
    wanted = Filters(budget_min=0.8, budget_max=6.0, source_file="crm_a.csv")
    cube = plan.report_cube(prepared(spark, sf_dir), RULES).staged()
    report = plan.report_sections(cube.sliced(wanted), apply_filters(prepared(spark, sf_dir), wanted))
    return _report_rows(report, set(_SECTIONS | _TABLES) - set(_UNFILTERED))


@query(
    "S8",
    oracle(
        "SELECT lead_class, name, phone, buying_status, lead_class_reason FROM verdicts",
        "verdicts",
    ),
)
def class_exports(spark, sf_dir):
    """Rows of each class written as CSV, one folder per class, and read back."""
    path = scratch_path(spark, "class_export")
    wanted = ["name", "no_such_column", "phone", "buying_status", "lead_class"]
    slices = [export.class_slice(prepared(spark, sf_dir), RULES, c) for c in rules.CLASSES]
    rows = reduce(DataFrame.unionByName, [export.export_rows(s, wanted) for s in slices])
    write_export(rows, path, partition_by=("lead_class",))
    schema = "name string, phone string, buying_status string, lead_class_reason string, lead_class string"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


@query(
    "S9 F6 F7 F8",
    oracle(
        f"""SELECT * FROM (SELECT lower(coalesce(trim(email), '')) AS email, coalesce('+91' || {phone('phone')}, '') AS phone,
          CASE WHEN name IS NULL THEN '' ELSE split_part(name, ' ', 1) END AS fn,
          CASE WHEN name IS NULL THEN '' ELSE trim(substr(name, length(split_part(name, ' ', 1)) + 1)) END AS ln,
          coalesce(trim(current_city), '') AS ct, '' AS st, 'IN' AS country, coalesce(v, '') AS value, CASE WHEN v IS NOT NULL THEN 'INR' ELSE '' END AS currency
          FROM (SELECT *, CAST(CAST(round({budget('budget')} * 100000) AS BIGINT) AS VARCHAR) AS v FROM leads)) WHERE phone <> '' OR email <> ''""",
        "leads",
    ),
)
def ad_audience(spark, sf_dir):
    return export.ad_audience(lead_export(spark, sf_dir))


@query(
    "flagship",
    oracle(
        "SELECT row_label, col_label, n, row_total, col_total FROM crosstab WHERE section = 'config_x_budget'",
        "crosstab",
    ),
)
def configuration_by_budget(spark, sf_dir):
    """Which unit types sit in which price bands, over unique leads: raw rows to cross-tab."""
    leads = label_ops.prepare_frame(build_lead_book(lead_export(spark, sf_dir)))
    cells = crosstabs.crosstab_cells(leads, {"config_x_budget": (F.col("configuration_required"), F.col("budget_bucket"))})
    return crosstabs.crosstab(cells).drop("section")
