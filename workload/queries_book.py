"""Queries over sources, headers, text repair, notes and identity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadbook.functions import identity as idf
from leadbook.functions import text as txt
from leadbook.operators import headers, notes, sheets, union
from leadbook.operators import identity as ident
from leadbook.operators.catalogue import upload_catalogue
from leadbook.operators.identity import dedupe_stats
from leadbook.operators.rules import classification_summary, classify
from leadbook.plans import book as plan
from leadbook.runtime import scratch_path
from leadbook.sources import lead_table, ledger, rulebook
from leadbook.sources.exports import harmonise, read_exports
from leadbook.streaming.intake import intake_stream
from leadbook.streaming.upsert import forget_upload, read_book, upsert_leads, upsert_stream
from workload.lead_export import derive_lead_export, duck_lead_export, lead_export, table
from workload.oracle_tables import FIELDS, clean, deslug, oracle, text
from workload.registry import query
from workload.tables import lead_rows, prepared

LEAD_FIELDS = ", ".join(FIELDS)


@query("fixture", duck_lead_export())
def lead_export_rows(spark, sf_dir):
    """The derived input itself."""
    return derive_lead_export(spark, sf_dir)


# ── sources and sinks ────────────────────────────────────────────────────────

# Three header spellings of the same fields, one per source file.
SPELLINGS = {
    "Apartment Leads.csv": {
        "name": "Name", "phone": "Phone number", "email": "Email address", "budget": "Budget",
        "configuration_required": "Configuration Required", "call_status": "Latest Call Status",
        "buying_status": "Buying Status", "hwc": "HWC", "date": "Lead Date", "campaign": "Campaign",
        "qualitative_remarks": "Qualitative Remarks", "current_city": "City", "lead_for_project": "Lead for Project",
        "interest_level": "Interest Level", "client_status": "Client Status", "facebook_page": "Facebook Page",
        "facebook_ad_set": "Facebook Ad Set", "first_call_date": "First Call Date",
    },
    "crm_a.csv": {
        "name": "Display Name", "phone": "MOBILE", "email": "email", "budget": "Budget Range",
        "configuration_required": "Config Needed", "call_status": "Call Status", "buying_status": "buyer status",
        "hwc": "High quality positive", "date": "Received", "campaign": "utm_campaign",
        "qualitative_remarks": "Notes", "current_city": "Current City", "lead_for_project": "Project Name",
        "interest_level": "interest", "client_status": "client_status_note", "facebook_page": "facebook page",
        "facebook_ad_set": "FACEBOOK AD SET", "first_call_date": "first call",
    },
    "Bungalow Enquiries.csv": {
        "name": "Full Name", "phone": "Contact Number", "email": "Email ID", "budget": "budget",
        "configuration_required": "BHK Required", "call_status": "Last Call Status", "buying_status": "Buying-Status",
        "hwc": "hwc", "date": "Date Created", "campaign": "Campaign Name", "qualitative_remarks": "Comments",
        "current_city": "CurrentCity", "lead_for_project": "Project", "interest_level": "Interest_Level",
        "client_status": "ClientStatus", "facebook_page": "FacebookPage", "facebook_ad_set": "Facebook-Ad-Set",
        "first_call_date": "FirstCallDate",
    },
}


def _headed(df: DataFrame, file: str) -> DataFrame:
    """The rows of one file under that file's own headers."""
    spelling = SPELLINGS[file]
    return df.filter(F.col("source_file") == file).select(*[F.col(c).alias(h) for c, h in spelling.items()])


def _write_csv_sets(spark, sf_dir) -> str:
    root = scratch_path(spark, "csv_exports")
    for number, file in enumerate(SPELLINGS):
        _headed(lead_export(spark, sf_dir), file).write.option("header", True).option("escape", '"').option(
            "ignoreLeadingWhiteSpace", False
        ).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/set{number}")
    return root


def _csv_paths(root: str) -> list[str]:
    return [f"{root}/set{number}/*.csv" for number in range(len(SPELLINGS))]


_READ_NULLS = "('', '#N/A', '#N/A N/A', '#NA', '-nan', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"


@query(
    "S1 S2 S3 H1 H3 U1",
    oracle(
        "SELECT " + ", ".join(f"CASE WHEN {f} IN {_READ_NULLS} THEN NULL ELSE {f} END AS {f}" for f in FIELDS) + " FROM leads",
        "leads",
    ),
)
def csv_exports_converge(spark, sf_dir):
    """Three differently headed CSV sets, read back into one schema."""
    rows, _ = read_exports(spark, _csv_paths(_write_csv_sets(spark, sf_dir)))
    return rows.select(*FIELDS)


@query(
    "S1",
    f"SELECT doc_id::VARCHAR AS name, CASE WHEN text IN {_READ_NULLS} THEN NULL ELSE text END AS qualitative_remarks FROM documents",
)
def csv_line_breaks_read(spark, sf_dir):
    """Whole document texts, with their line breaks and quotes, as cells of CSV files that are read in splits."""
    root = scratch_path(spark, "csv_texts")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("Full Name"), F.col("text").alias("Remarks"))
    docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(root)
    return read_exports(spark, root)[0].select("name", "qualitative_remarks")


@query(
    "S4 H4",
    oracle(
        "SELECT source_file, source_sheet, count(*) AS row_count, 18::BIGINT AS matched_fields, true AS looks_like_lead_sheet,"
        " CASE WHEN source_file LIKE 'Apartment%' THEN 'Apartment' WHEN source_file LIKE 'Bungalow%' THEN 'Bungalow' END AS detected_type"
        " FROM (SELECT source_file, source_sheet || ' [' || coalesce(nullif(trim(campaign), ''), 'No campaign') || ']' AS source_sheet FROM leads)"
        " GROUP BY ALL",
        "leads",
    ),
)
def sheet_profiles(spark, sf_dir):
    """The catalogue of virtual sheets."""
    df = sheets.with_virtual_sheets(lead_export(spark, sf_dir))
    return sheets.sheet_catalogue(df, matched=headers.matched_fields(df.columns))


@query(
    "S5",
    oracle(
        "SELECT row_ord, source_sheet || ' [' || coalesce(nullif(trim(campaign), ''), 'No campaign') || ']' AS source_sheet FROM leads",
        "leads",
    ),
)
def virtual_sheets(spark, sf_dir):
    return sheets.with_virtual_sheets(lead_export(spark, sf_dir)).select("row_ord", "source_sheet")


_UPLOADS = {"Apartment Leads.csv": "u1", "crm_a.csv": "u2", "Bungalow Enquiries.csv": "u3"}


# Leads of each phone of an upload: its names, or one nameless lead; a nameless row joins a sole name.
_LEADS_PER_PHONE = (
    "SELECT CASE source_file WHEN 'Apartment Leads.csv' THEN 'u1' WHEN 'crm_a.csv' THEN 'u2' ELSE 'u3' END AS upload_id, source_file,"
    " phone_normalized, count(*) AS n, count(DISTINCT name_key) FILTER (WHERE name_key <> '')"
    " + CASE WHEN count(DISTINCT name_key) FILTER (WHERE name_key <> '') = 1 THEN 0 ELSE max((name_key = '')::INT) END AS leads"
    " FROM keyed GROUP BY source_file, phone_normalized"
)


def _store_uploads(spark, sf_dir) -> str:
    root = scratch_path(spark, "uploads")
    for number, (file, upload) in enumerate(_UPLOADS.items(), start=1):
        rows = lead_export(spark, sf_dir).filter(F.col("source_file") == file)
        lead_table.write_upload(rows, root, upload, f"2026-01-0{number}")
    return root


@query("S6 S7", oracle(f"SELECT row_ord, source_file, {LEAD_FIELDS} FROM leads", "leads"))
def lead_table_round_trip(spark, sf_dir):
    stored = lead_table.read_uploads(spark, _store_uploads(spark, sf_dir))
    return harmonise(stored).select("row_ord", "source_file", *FIELDS)


@query(
    "S10",
    oracle(
        f"SELECT upload_id, CASE upload_id WHEN 'u1' THEN '2026-01-01' WHEN 'u2' THEN '2026-01-02' ELSE '2026-01-03' END AS created_at,"
        " source_file AS files, sum(leads)::BIGINT AS row_count, 'ready' AS status"
        f" FROM ({_LEADS_PER_PHONE}) WHERE phone_normalized IS NOT NULL GROUP BY upload_id, source_file"
        " UNION ALL SELECT 'u4', '2026-01-04', source_file, count(*), 'draft' FROM leads WHERE source_file = 'crm_a.csv' GROUP BY source_file",
        "keyed",
    ),
)
def uploads_listed(spark, sf_dir):
    """Stored uploads with their leads, and one file read but not yet accepted."""
    root = _store_uploads(spark, sf_dir)
    draft = lead_export(spark, sf_dir).filter(F.col("source_file") == "crm_a.csv")
    drafts = draft.select(F.lit("u4").alias("upload_id"), F.lit("2026-01-04").alias("created_at"), "source_file")
    return upload_catalogue(ledger.listed_uploads(spark, root), drafts)


@query(
    "S11",
    oracle("SELECT source_file, count(*) AS rows_left FROM leads WHERE source_file <> 'crm_a.csv' GROUP BY 1", "leads"),
)
def upload_removed(spark, sf_dir):
    root = _store_uploads(spark, sf_dir)
    lead_table.remove_upload(spark, root, _UPLOADS["crm_a.csv"])
    left = lead_table.read_uploads(spark, root)
    return left.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_left"))


@query(
    "S12 R1",
    oracle(
        "SELECT count(*) AS total, count(*) FILTER (WHERE buying_status = 'Interested') AS good,"
        " count(*) FILTER (WHERE buying_status = 'Postponed') AS bad,"
        " count(*) FILTER (WHERE buying_status IS NULL OR buying_status NOT IN ('Interested', 'Postponed')) AS unclassified,"
        " round(count(*) FILTER (WHERE buying_status IN ('Interested', 'Postponed')) / count(*), 4) AS classified_share FROM prepared",
        "prepared",
    ),
)
def stored_rules_applied(spark, sf_dir):
    """Rules imported in the older flat form, saved, loaded again and applied."""
    text_form = (
        '[{"col": "buying_status", "vals": ["Interested"], "category": "good"},'
        ' {"col": "hwc", "vals": ["VIP"], "category": "unclassified"},'
        ' {"conditions": [{"col": "buying_status", "vals": ["Postponed"]}, {"field": ""}], "category": "bad"}]'
    )
    path = scratch_path(spark, "rules")
    rulebook.save_rules(spark, rulebook.import_rules(text_form), path)
    return classification_summary(classify(prepared(spark, sf_dir), rulebook.load_rules(spark, path)))


# ── headers and sheets ───────────────────────────────────────────────────────

@query(
    "H1 H2 H3 F5",
    oracle(
        " UNION ALL ".join(f"SELECT {text(f)} AS field, count({f}) AS filled FROM leads" for f in FIELDS)
        + " UNION ALL SELECT 'stage', 0 UNION ALL SELECT 'job_title', 0",
        "leads",
    ),
)
def headers_converge(spark, sf_dir):
    """Drifting headers renamed, missing fields added: filled cells per canonical field."""
    df = lead_export(spark, sf_dir)
    frames = [headers.ensure_canonical(headers.normalize_headers(_headed(df, f))) for f in SPELLINGS]
    merged = reduce(DataFrame.unionByName, frames)
    fields = [*FIELDS, "stage", "job_title"]
    wide = merged.agg(*[F.count(f).alias(f) for f in fields])
    return wide.unpivot([], fields, "field", "filled")


def _proposals(spark, sf_dir) -> DataFrame:
    """Proposals derived from the customers: good, unknown and double claims."""
    customer = table(spark, sf_dir, "customer")
    return customer.select(
        F.concat(F.lit("sheet "), (F.col("c_custkey") % 40).cast("string")).alias("sheet_key"),
        F.concat(F.lit("col "), (F.col("c_custkey") % 7).cast("string")).alias("source_col"),
        F.element_at(
            F.array(*[F.lit(v) for v in ("name", "phone", "budget", "salary", "email")]),
            (F.col("c_custkey") % 5 + 1).cast("int"),
        ).alias("target_field"),
        F.col("c_custkey").alias("ord"),
    )


_DUCK_PROPOSALS = (
    "SELECT 'sheet ' || (c_custkey % 40) AS sheet_key, 'col ' || (c_custkey % 7) AS source_col,"
    " ['name', 'phone', 'budget', 'salary', 'email'][c_custkey % 5 + 1] AS target_field, c_custkey AS ord FROM customer"
)


@query(
    "H5",
    f"WITH p AS ({_DUCK_PROPOSALS}) SELECT sheet_key, source_col, target_field FROM (SELECT *, row_number() OVER"
    " (PARTITION BY sheet_key, target_field ORDER BY ord) AS rn FROM p WHERE target_field <> 'salary' AND source_col <> 'col 3') WHERE rn = 1",
)
def column_proposals_checked(spark, sf_dir):
    proposals = _proposals(spark, sf_dir)
    columns = proposals.select("sheet_key", "source_col").distinct().filter(F.col("source_col") != "col 3")
    return headers.valid_proposals(proposals, columns)


@query(
    "H6",
    "SELECT n_regionkey AS sheet, count(*) AS rows, count(DISTINCT n_name) % 7 AS columns,"
    " (count(DISTINCT n_name) % 7 >= 4 AND count(*) >= 2 AND n_regionkey < 5) AS wants_proposal FROM nation GROUP BY 1",
)
def proposal_gate(spark, sf_dir):
    """Which sheets are wide and long enough to be worth a proposal; the region stands for the sheet."""
    grouped = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("sheet")).agg(
        F.count(F.lit(1)).alias("rows"), (F.count_distinct("n_name") % 7).alias("columns")
    )
    gate = headers.wants_proposal(F.col("sheet"), F.col("columns"), F.col("rows"))
    return grouped.withColumn("wants_proposal", gate)


_SAMPLED = ["name", "budget", "hwc", "qualitative_remarks"]


@query(
    "H7",
    oracle(
        "SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY filled DESC, row_ord) AS position, substr(trim(v), 1, 60) AS value FROM ("
        "SELECT row_ord, filled, unnest(["
        + ", ".join(f"{{'column_name': '{c}', 'v': {c}}}" for c in _SAMPLED)
        + "], recursive := true) FROM (SELECT *, "
        + " + ".join(f"({c} IS NOT NULL)::INT" for c in _SAMPLED)
        + " AS filled FROM leads ORDER BY filled DESC, row_ord LIMIT 10)) WHERE trim(v) <> ''",
        "leads",
    ),
)
def column_samples(spark, sf_dir):
    return headers.column_sample(lead_export(spark, sf_dir), "row_ord", _SAMPLED).withColumn(
        "position", F.col("position").cast("long")
    )


@query(
    "H8",
    f"WITH p AS ({_DUCK_PROPOSALS}) SELECT sheet_key, source_col, target_field, ord FROM p WHERE target_field NOT IN ('qualitative_remarks', 'name', 'email', 'phone')",
)
def note_proposals_checked(spark, sf_dir):
    return headers.safe_note_proposals(_proposals(spark, sf_dir))


@query(
    "H9",
    "SELECT p_type AS name, p_name AS sheet, CASE"
    + "".join(
        f" WHEN regexp_matches(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), '\\b({'|'.join(words)})s?\\b') THEN {text(label)}"
        for c in ("s", "f")
        for label, words in sheets.PROPERTY_TYPES.items()
    )
    + " END AS property_type FROM (SELECT *, p_name || '_' || ['Villas-', 'q1 ', 'Flats.', 'land&'][p_partkey % 4 + 1] AS s,"
    " ['Row House', 'export', 'excel_dump', 'Penthouses'][p_size % 4 + 1] AS f FROM part)",
)
def property_types(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumns(
        {
            "s": F.concat("p_name", F.lit("_"), F.element_at(F.array(*[F.lit(v) for v in ("Villas-", "q1 ", "Flats.", "land&")]), (F.col("p_partkey") % 4 + 1).cast("int"))),
            "f": F.element_at(F.array(*[F.lit(v) for v in ("Row House", "export", "excel_dump", "Penthouses")]), (F.col("p_size") % 4 + 1).cast("int")),
        }
    )
    found = sheets.sheet_property_type(F.col("f"), F.col("s"))
    return part.select(F.col("p_type").alias("name"), F.col("p_name").alias("sheet"), found.alias("property_type"))


@query(
    "H10 J4",
    oracle(
        "SELECT source_file, CASE source_file WHEN 'crm_a.csv' THEN 'Plot' ELSE 'Apartment' END AS property_type, count(*) AS rows"
        " FROM leads WHERE source_file IN ('crm_a.csv', 'Apartment Leads.csv') AND NOT (source_file = 'crm_a.csv' AND source_sheet = 'Sheet2') GROUP BY 1, 2",
        "leads",
    ),
)
def sheet_choices_applied(spark, sf_dir):
    """One file left out, one sheet left out, types given by the user."""
    df = lead_export(spark, sf_dir)
    catalogue = sheets.sheet_catalogue(df, matched=headers.matched_fields(df.columns))
    crm, bungalow = F.col("source_file") == "crm_a.csv", F.col("source_file") == "Bungalow Enquiries.csv"
    choices = catalogue.select(
        "source_file",
        "source_sheet",
        F.when(bungalow | (crm & (F.col("source_sheet") == "Sheet2")), False).alias("include"),
        F.when(crm, " Plot ").otherwise(F.col("detected_type")).alias("property_type"),
    )
    selected = sheets.check_selection(sheets.chosen_sheets(catalogue, choices))
    kept = sheets.keep_chosen(df, selected)
    return kept.groupBy("source_file", "property_type").agg(F.count(F.lit(1)).alias("rows"))


# ── text ─────────────────────────────────────────────────────────────────────

@query("T1", oracle(f"SELECT row_ord, {clean('call_status')} AS call_status, {clean('hwc')} AS hwc, {clean('lead_for_project')} AS project FROM leads", "leads"))
def cleaned_text(spark, sf_dir):
    df = lead_export(spark, sf_dir)
    return df.select("row_ord", txt.clean(F.col("call_status")).alias("call_status"), txt.clean(F.col("hwc")).alias("hwc"), txt.clean(F.col("lead_for_project")).alias("project"))


@query("T2", "SELECT doc_id, text FROM documents")
def encoding_repaired(spark, sf_dir):
    """Whole document texts damaged and repaired; the oracle is the untouched text."""
    damaged = table(spark, sf_dir, "documents").select("doc_id", txt.damage_encoding(F.col("text")).alias("text"))
    return damaged.select("doc_id", txt.repair_encoding(F.col("text")).alias("text"))


@query("T3", oracle("SELECT row_ord, name, name_key FROM keyed", "keyed"))
def styled_names_folded(spark, sf_dir):
    """Names styled as mathematical letters, then folded and keyed."""
    styled = lead_export(spark, sf_dir).select("row_ord", txt.style_ascii(F.col("name")).alias("name"))
    return styled.select("row_ord", txt.fold_styled(F.col("name")).alias("name"), idf.name_key(F.col("name")).alias("name_key"))


@query(
    "T4",
    oracle("SELECT row_ord, slug, label, value FROM note_pairs", "note_pairs"),
)
def note_lines(spark, sf_dir):
    pairs = notes.note_pairs(F.col("qualitative_remarks"))
    return lead_export(spark, sf_dir).select("row_ord", F.explode(pairs).alias("p")).select("row_ord", "p.*")


@query("T5", oracle("SELECT * FROM census", "census"))
def note_label_census(spark, sf_dir):
    return notes.label_census(lead_export(spark, sf_dir))


@query("T6", oracle("SELECT * FROM kept", "kept"))
def note_labels_kept(spark, sf_dir):
    return notes.kept_labels(lead_export(spark, sf_dir))


@query(
    "T7 T10",
    oracle(
        f"SELECT leads.row_ord, coalesce(current_city, c.v) AS current_city, coalesce(budget, b.v) AS budget, t.v AS timeline FROM leads"
        f" LEFT JOIN (SELECT row_ord, {deslug('value')} AS v FROM note_pairs WHERE slug = 'city') c USING (row_ord)"
        f" LEFT JOIN (SELECT row_ord, {deslug('value')} AS v FROM note_pairs WHERE slug = 'whatisyourbudget') b USING (row_ord)"
        f" LEFT JOIN (SELECT row_ord, {deslug('value')} AS v FROM note_pairs WHERE slug = 'timeline') t USING (row_ord)",
        "note_pairs",
    ),
)
def notes_lifted(spark, sf_dir):
    lifted = notes.lift_notes(lead_export(spark, sf_dir))
    return notes.pivot_notes(lifted, ["note:Timeline"]).select(
        "row_ord", "current_city", "budget", F.col("`note:Timeline`").alias("timeline")
    )


@query(
    "T8",
    oracle("SELECT source_file, source_sheet, CASE WHEN source_file = 'crm_a.csv' THEN 'remarks' ELSE 'qualitative_remarks' END AS text_column FROM leads GROUP BY ALL", "leads"),
)
def note_text_columns(spark, sf_dir):
    """Each sheet scans the first of its text columns that holds anything."""
    crm = F.col("source_file") == "crm_a.csv"
    df = lead_export(spark, sf_dir).withColumns(
        {
            "remarks": F.when(crm, F.col("qualitative_remarks")),
            "qualitative_remarks": F.when(~crm, F.col("qualitative_remarks")),
        }
    )
    return notes.text_column(df)


@query("T9", oracle(f"SELECT row_ord, {deslug('budget')} AS budget, {deslug('qualitative_remarks')} AS remark FROM leads", "leads"))
def form_answers(spark, sf_dir):
    df = lead_export(spark, sf_dir)
    return df.select("row_ord", txt.deslug(F.col("budget")).alias("budget"), txt.deslug(F.col("qualitative_remarks")).alias("remark"))


@query("T10", oracle("SELECT DISTINCT 'note:' || label AS note_field FROM kept WHERE slug NOT IN ('city', 'whatisyourbudget')", "kept"))
def note_fields_listed(spark, sf_dir):
    return notes.note_columns(notes.lift_notes(lead_export(spark, sf_dir)))


@query("T11", oracle("SELECT row_ord, coalesce(nullif(trim(lead_for_project), ''), nullif(trim(source_sheet), ''), 'Unknown') AS project FROM leads", "leads"))
def project_labels(spark, sf_dir):
    return union.with_project(lead_export(spark, sf_dir)).select("row_ord", "project")


@query(
    "T12 T13 U1",
    oracle(
        "SELECT source_file, project, count(*) AS rows, count(current_city) AS cities, count(budget) AS budgets, count(timeline) AS timelines FROM ("
        " SELECT leads.*, coalesce(nullif(trim(lead_for_project), ''), source_sheet) AS project,"
        " CASE WHEN row_ord % 4 = 0 THEN 'x' END AS timeline FROM leads) GROUP BY 1, 2".replace(
            "count(current_city)", "count(CASE WHEN row_ord % 4 = 0 THEN 'x' ELSE current_city END)"
        ).replace("count(budget)", "count(CASE WHEN row_ord % 4 = 0 THEN 'x' ELSE budget END)"),
        "leads",
    ),
)
def sheets_prepared_and_united(spark, sf_dir):
    """Three differently headed sheets, each prepared, then one frame."""
    df = lead_export(spark, sf_dir)
    prepared_sheets = []
    for file, spelling in SPELLINGS.items():
        sheet = df.filter(F.col("source_file") == file).withColumnsRenamed(spelling)
        prepared_sheets.append(union.prepare_sheet(sheet))
    merged = union.with_project(union.union_sheets(spark, prepared_sheets))
    timeline = notes.pivot_notes(merged, ["note:Timeline"]).withColumnRenamed("note:Timeline", "timeline")
    return timeline.groupBy("source_file", "project").agg(
        F.count(F.lit(1)).alias("rows"), F.count("current_city").alias("cities"),
        F.count("budget").alias("budgets"), F.count("timeline").alias("timelines"),
    )


# ── identity ─────────────────────────────────────────────────────────────────

@query(
    "D1 D2",
    oracle(
        "SELECT row_ord, phone_normalized, CASE WHEN phone IS NULL OR trim(phone) = '' THEN 'missing'"
        " WHEN phone_normalized IS NULL THEN 'invalid' ELSE 'valid' END AS phone_status FROM keyed",
        "keyed",
    ),
)
def phones_standardised(spark, sf_dir):
    return ident.with_phone_identity(lead_export(spark, sf_dir)).select("row_ord", "phone_normalized", "phone_status")


@query("D3", oracle("SELECT row_ord, name_key FROM keyed", "keyed"))
def name_keys(spark, sf_dir):
    return lead_export(spark, sf_dir).select("row_ord", idf.name_key(F.col("name")).alias("name_key"))


@query(
    "D4 J1",
    oracle("SELECT phone_normalized, name_key, lead_key AS resolved_key, count(*) AS rows FROM resolved GROUP BY ALL", "resolved"),
)
def blank_names_resolved(spark, sf_dir):
    return ident.name_groups(lead_rows(spark, sf_dir).filter(F.col("phone_normalized").isNotNull()))


@query("D5", oracle("SELECT row_ord, richness FROM keyed", "keyed"))
def row_richness(spark, sf_dir):
    df = lead_export(spark, sf_dir)
    return df.select("row_ord", ident.richness(df).alias("richness"))


@query(
    "D6 D7 J1",
    oracle(
        f"SELECT phone_normalized, name_key, row_ord, source_file, source_sheet, {LEAD_FIELDS}, merged_row_count, merged_sources FROM book",
        "book",
    ),
)
def leads_merged(spark, sf_dir):
    """Raw rows to unique leads: keyed, stored, merged."""
    return ident.merge_leads(plan.stored_rows(lead_export(spark, sf_dir)))


@query(
    "D8",
    oracle(
        "SELECT (SELECT count(*) FROM keyed) AS input_rows,"
        " (SELECT count(*) FROM keyed WHERE phone IS NOT NULL AND trim(phone) <> '' AND phone_normalized IS NULL) AS invalid_phone_dropped,"
        " (SELECT count(*) FROM keyed WHERE phone IS NULL OR trim(phone) = '') AS missing_phone_dropped,"
        " (SELECT count(*) FROM valid) - (SELECT count(*) FROM book) AS duplicate_rows_merged,"
        " (SELECT count(*) FROM book) AS unique_leads,"
        " (SELECT count(*) FROM (SELECT phone_normalized FROM valid GROUP BY 1 HAVING count(DISTINCT source_file) > 1)) AS cross_file_leads",
        "book",
    ),
)
def merge_statistics(spark, sf_dir):
    return ident.dedupe_stats(lead_rows(spark, sf_dir))


@query(
    "D9",
    oracle(
        "SELECT phone_normalized, name_key, merged_row_count, merged_sources, member_frames, budget, call_status, email FROM ("
        " SELECT phone_normalized, lead_key AS name_key, count(*) AS merged_row_count, count(DISTINCT source_file) AS member_frames,"
        " array_to_string(list_sort(list(DISTINCT source_file)), ' · ') AS merged_sources,"
        + ", ".join(f"arg_min({c}, pool_rank) FILTER ({c} IS NOT NULL) AS {c}" for c in ("budget", "call_status", "email"))
        + " FROM (SELECT *, -richness::BIGINT * 100000000000000 + row_ord + CASE source_file WHEN 'Apartment Leads.csv' THEN 0"
        " WHEN 'crm_a.csv' THEN 10000000000 ELSE 20000000000 END AS pool_rank FROM resolved) GROUP BY 1, 2)",
        "resolved",
    ),
)
def combined_pool(spark, sf_dir):
    """Three stored uploads merged into one pool, lineage counted on raw rows."""
    pool = plan.combined_pool(lead_table.read_uploads(spark, _store_uploads(spark, sf_dir)))
    return pool.select(
        "phone_normalized", "name_key", "merged_row_count", "merged_sources", "member_frames", "budget", "call_status", "email"
    )


@query(
    "D9",
    oracle(
        "SELECT a.*, duplicate_rows_merged, unique_leads, 0 AS cross_file_leads FROM ("
        "SELECT CASE source_file WHEN 'Apartment Leads.csv' THEN 'u1' WHEN 'crm_a.csv' THEN 'u2' ELSE 'u3' END AS upload_id,"
        " count(*) AS input_rows, count(*) FILTER (WHERE phone IS NOT NULL AND trim(phone) <> '' AND phone_normalized IS NULL) AS invalid_phone_dropped,"
        " count(*) FILTER (WHERE phone IS NULL OR trim(phone) = '') AS missing_phone_dropped FROM keyed GROUP BY 1) a JOIN ("
        f"SELECT upload_id, sum(n - leads)::BIGINT AS duplicate_rows_merged, sum(leads)::BIGINT AS unique_leads FROM ({_LEADS_PER_PHONE})"
        " WHERE phone_normalized IS NOT NULL GROUP BY upload_id) b USING (upload_id)",
        "keyed",
    ),
)
def upload_statistics(spark, sf_dir):
    return plan.upload_stats(lead_table.read_uploads(spark, _store_uploads(spark, sf_dir)))


@query(
    "D9",
    oracle(
        "SELECT a.*, duplicate_rows_merged, unique_leads, cross_file_leads FROM ("
        "SELECT count(*) AS input_rows, count(*) FILTER (WHERE phone IS NOT NULL AND trim(phone) <> '' AND phone_normalized IS NULL) AS invalid_phone_dropped,"
        " count(*) FILTER (WHERE phone IS NULL OR trim(phone) = '') AS missing_phone_dropped FROM keyed) a, ("
        "SELECT sum(n - leads)::BIGINT AS duplicate_rows_merged, sum(leads)::BIGINT AS unique_leads, sum(files > 1)::BIGINT AS cross_file_leads FROM ("
        "SELECT phone_normalized, count(*) AS n, count(DISTINCT source_file) AS files, count(DISTINCT name_key) FILTER (WHERE name_key <> '')"
        " + CASE WHEN count(DISTINCT name_key) FILTER (WHERE name_key <> '') = 1 THEN 0 ELSE max((name_key = '')::INT) END AS leads"
        " FROM keyed WHERE phone_normalized IS NOT NULL GROUP BY phone_normalized)) b",
        "keyed",
    ),
)
def pool_statistics(spark, sf_dir):
    """Merge statistics over all stored uploads, counted on raw rows."""
    return dedupe_stats(lead_table.read_uploads(spark, _store_uploads(spark, sf_dir)))


@query("D10", oracle("SELECT phone_normalized, name_key, merged_row_count FROM book", "book"))
def old_frames_back_filled(spark, sf_dir):
    """A frame stored before merging existed is merged when it is read."""
    path = scratch_path(spark, "old_frame")
    lead_table.write_leads(lead_export(spark, sf_dir), path)
    return lead_table.read_leads(spark, path).select("phone_normalized", "name_key", "merged_row_count")


# ── streaming ────────────────────────────────────────────────────────────────

@query(
    "ST1",
    oracle(
        "SELECT 'Mixed / Other' AS property_type, count(*) AS rows, count(*) FILTER (WHERE budget IS NOT NULL OR row_ord % 4 = 0) AS budgets,"
        " count(*) FILTER (WHERE current_city IS NOT NULL OR row_ord % 4 = 0) AS cities, count(qualitative_remarks) AS remarks FROM leads",
        "leads",
    ),
)
def files_taken_in(spark, sf_dir):
    """Differently headed files arriving in a folder become stored uploads."""
    folder, root = _write_csv_sets(spark, sf_dir), scratch_path(spark, "intake")
    intake_stream(spark, folder, root, scratch_path(spark, "intake_checkpoint")).awaitTermination()
    stored = lead_table.read_uploads(spark, root)
    return stored.groupBy("property_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count("budget").alias("budgets"), F.count("current_city").alias("cities"),
        F.count("qualitative_remarks").alias("remarks"),
    )


@query(
    "ST2",
    oracle(f"SELECT phone_normalized, name_key, {LEAD_FIELDS}, merged_row_count, merged_sources FROM book", "book"),
)
def leads_upserted(spark, sf_dir):
    """Lead rows arriving in micro-batches; the book must equal a full rebuild."""
    source = scratch_path(spark, "arriving")
    lead_export(spark, sf_dir).withColumn("part", F.col("row_ord") % 3).write.partitionBy("part").parquet(source)
    schema = lead_export(spark, sf_dir).schema
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 12).option("recursiveFileLookup", True).parquet(source)
    root = scratch_path(spark, "book")
    upsert_stream(arriving, root, scratch_path(spark, "book_checkpoint")).awaitTermination()
    return read_book(spark, root).select("phone_normalized", "name_key", *FIELDS, "merged_row_count", "merged_sources")


_WITHOUT_ONE = oracle(
    f"SELECT phone_normalized, name_key, {LEAD_FIELDS}, merged_row_count, merged_sources, 1::BIGINT AS member_frames FROM book", "book"
).replace(duck_lead_export(), f"SELECT * FROM ({duck_lead_export()}) WHERE source_file NOT IN ('crm_a.csv', 'Apartment Leads.csv')")


@query("ST2 S11", _WITHOUT_ONE)
def upload_forgotten(spark, sf_dir):
    """Three uploads upserted one by one, the second and then the first forgotten: the book of the third alone."""
    root = scratch_path(spark, "book")
    for number, (file, upload) in enumerate(_UPLOADS.items()):
        rows = lead_export(spark, sf_dir).filter(F.col("source_file") == file)
        upsert_leads(rows.withColumn("upload_id", F.lit(upload)), number, root)
    for file in ("crm_a.csv", "Apartment Leads.csv"):
        forget_upload(spark, _UPLOADS[file], root)
    return read_book(spark, root).select("phone_normalized", "name_key", *FIELDS, "merged_row_count", "merged_sources", "member_frames")


@query("ST1 ST2 D9", oracle("SELECT phone_normalized, name_key, merged_row_count, true AS as_in_pool FROM book", "book"))
def streamed_book(spark, sf_dir):
    """CSV files taken in file by file and upserted; every lead must equal the pool's in every column."""
    folder, uploads, root = _write_csv_sets(spark, sf_dir), scratch_path(spark, "intake"), scratch_path(spark, "book")
    intake_stream(
        spark, folder, uploads, scratch_path(spark, "intake_checkpoint"), then=lambda rows, number: upsert_leads(rows, number, root)
    ).awaitTermination()
    streamed, pool = read_book(spark, root), plan.combined_pool(lead_table.read_uploads(spark, uploads))
    keys = ["phone_normalized", "name_key"]
    fields = sorted(set(streamed.columns) & set(pool.columns) - {*keys, "row_ord"})
    maps = {c for c, kind in pool.dtypes if kind.startswith("map")}
    whole = lambda df, name: df.select(*keys, "merged_row_count", F.struct(*[F.array_sort(F.map_entries(c)) if c in maps else F.col(c) for c in fields]).alias(name))
    both = whole(streamed, "mine").join(whole(pool, "theirs").drop("merged_row_count"), keys, "full")
    return both.select(*keys, "merged_row_count", F.col("mine").eqNullSafe(F.col("theirs")).alias("as_in_pool"))
