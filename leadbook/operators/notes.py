"""Notes: `Label: value` lines lifted out of free text.

A label that means a known field needs no statistics and fills that field where
it is empty.  Any other label must recur within its virtual sheet; the recurring
labels are counted with one map-side-combined aggregate over the sheets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.functions.text import deslug, fold_key, trimmed
from leadbook.operators.headers import PROTECTED_NOTE_TARGETS
from leadbook.operators.sheets import SHEET_KEYS
from leadbook.runtime import lookup_join, stage

# How a labelled line looks, and which labels read like labels.
_BREAK = r"(?:_x000D_|\r|\n)"
LABEL_LINE = rf"(?:^|{_BREAK})[ \t]*([^\r\n:]{{2,60}}?)[ \t]*:[ \t]*([^\r\n]*?)(?={_BREAK}|$)"
LABEL_SHAPE = r"^[A-Za-z][A-Za-z0-9 '&/()?.,\-₹ ]*$"
LABEL_WORDS = r"(?U)^\S+(?:\s+\S+){0,9}$"
MIN_LABEL_ROWS = 2
MIN_LABEL_SHARE = 0.02
TEXT_COLUMNS = ("qualitative_remarks", "notes", "remarks")

# Field -> label keys that mean it.
NOTE_ALIASES: dict[str, tuple[str, ...]] = {
    "name": ("fullname", "name", "leadname"),
    "email": ("email", "emailaddress"),
    "phone": ("phonenumber", "phone", "mobile", "mobilenumber", "contactnumber", "whatsappnumber"),
    "current_city": ("city", "currentcity"),
    "company_name": ("companyname", "company"),
    "job_title": ("jobtitle", "designation"),
    "business_profile": ("occupation", "profession"),
    "campaign": ("campaign",),
    "facebook_ad_set": ("adset",),
    "facebook_ad": ("ad",),
    "budget": (
        "budget", "yourbudget", "whatisyourbudget", "whatbudgetareyoucomfortablewith",
        "whatsyourbudget", "budgetrange",
    ),
    "configuration_required": (
        "configuration", "unittype", "whatconfigurationareyoulookingfor",
        "whichconfigurationareyouinterestedin",
    ),
    "purpose_of_buying": ("purpose", "purposeofbuying"),
    "location_preference": ("preferredlocation", "locationpreference"),
    "looking_since": ("lookingsince",),
}
KNOWN_SLUGS = tuple(S.alias_lookup(NOTE_ALIASES))


def note_pairs(text: Column) -> Column:
    """The labelled lines of a text: array of (slug, label, value), in order."""
    labels = F.regexp_extract_all(text, F.lit(LABEL_LINE), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(LABEL_LINE), F.lit(2))
    pairs = F.zip_with(
        labels,
        values,
        lambda label, value: F.struct(
            fold_key(label).alias("slug"), trimmed(label).alias("label"), trimmed(value).alias("value")
        ),
    )
    return F.when(
        text.contains(":"),
        F.filter(
            pairs,
            lambda p: (p["value"] != "") & p["label"].rlike(LABEL_SHAPE) & p["label"].rlike(LABEL_WORDS),
        ),
    )


def text_column(df: DataFrame, candidates: tuple[str, ...] = TEXT_COLUMNS) -> DataFrame:
    """Per virtual sheet, the first candidate column that holds anything."""
    here = [c for c in candidates if c in df.columns]
    chosen = F.coalesce(*[F.when(F.count(F.col(c)) > 0, c) for c in here])
    return df.groupBy(*SHEET_KEYS).agg(chosen.alias("text_column"))


def with_note_text(df: DataFrame, name: str = "__note") -> DataFrame:
    """Add the text to scan; only sheets with several candidate columns need a lookup."""
    here = [c for c in TEXT_COLUMNS if c in df.columns]
    if len(here) < 2:
        return df.withColumn(name, F.col(here[0]) if here else F.lit(None).cast("string"))
    picked = lookup_join(df, stage(text_column(df), "text_columns"), list(SHEET_KEYS), S.ROW_ORD)
    text = F.coalesce(*[F.when(F.col("text_column") == c, F.col(c)) for c in here])
    return picked.withColumn(name, text).drop("text_column")


def _labels_once_per_row(pairs: Column) -> Column:
    # Within one text the last wording of a label stands for it.
    slugs = F.array_distinct(F.transform(pairs, lambda p: p["slug"]))
    return F.transform(
        slugs,
        lambda s: F.struct(
            s.alias("slug"),
            F.element_at(F.filter(pairs, lambda p: p["slug"] == s), -1)["label"].alias("label"),
        ),
    )


def label_census(df: DataFrame, text: str = "qualitative_remarks") -> DataFrame:
    """Rows carrying each label, per virtual sheet, with its first spelling."""
    once = F.explode(_labels_once_per_row(note_pairs(F.col(text)))).alias("seen")
    rows = df.filter(F.col(text).contains(":")).select(*SHEET_KEYS, S.ROW_ORD, once)
    return rows.groupBy(*SHEET_KEYS, F.col("seen.slug").alias("slug")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.struct(F.col(S.ROW_ORD), F.col("seen.label").alias("label"))).getField("label").alias("label"),
    )


def kept_labels(df: DataFrame, proposed: tuple[str, ...] = (), text: str = "qualitative_remarks") -> DataFrame:
    """Labels worth a field: recurring in their sheet, known, or proposed.

    Labels seen on one row are dropped before the sheet totals are joined, so
    stray colons in prose never reach that join.
    """
    census = label_census(df, text)
    recognised = F.col("slug").isin(*KNOWN_SLUGS, *proposed)
    candidates = census.filter((F.col("rows") >= MIN_LABEL_ROWS) | recognised)
    noted = df.groupBy(*SHEET_KEYS).agg(F.count(text).alias("noted_rows"))
    least = F.greatest(F.lit(MIN_LABEL_ROWS), F.floor(F.col("noted_rows") * MIN_LABEL_SHARE))
    joined = candidates.join(noted, list(SHEET_KEYS))
    return joined.filter((F.col("rows") >= least) | recognised)


def _first_value(pairs: Column, slugs: tuple[str, ...]) -> Column:
    return F.get(F.filter(pairs, lambda p: p["slug"].isin(*slugs)), F.lit(0))["value"]


def lift_notes(df: DataFrame, proposals: dict[str, str] | None = None) -> DataFrame:
    """Fill known fields from notes and collect the other recurring labels.

    `proposals` maps labels to canonical fields; a proposed label enriches that
    field and keeps its own `note:` entry.  Protected fields are never filled so.  Canonical fields are only filled
    where they are null; `note_fields` is written whatever the sheet holds.
    """
    proposed = {
        S.header_key(label): field
        for label, field in (proposals or {}).items()
        if field in S.CANONICAL_FIELDS and field not in PROTECTED_NOTE_TARGETS
    }
    texted = with_note_text(df)
    by_field = {field: tuple(slugs) for field, slugs in NOTE_ALIASES.items()}
    for slug, field in proposed.items():
        if slug not in KNOWN_SLUGS:
            by_field[field] = (*by_field.get(field, ()), slug)

    own = kept_labels(texted, tuple(proposed), "__note").filter(~F.col("slug").isin(*KNOWN_SLUGS))
    # A sheet keeps few labels: each must recur on two percent of its noted rows.
    per_sheet = own.groupBy(*SHEET_KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("slug", "label"))).alias("__kept")
    )
    rows = _attach_kept(texted.withColumn("__pairs", note_pairs(F.col("__note"))), per_sheet)

    # Answers are made readable once per line, before the fields pick theirs.
    known = sorted({slug for slugs in by_field.values() for slug in slugs})
    lifted = F.transform(
        F.filter(
            F.col("__pairs"),
            lambda p: p["slug"].isin(*known) | F.coalesce(F.map_contains_key(F.col("__kept"), p["slug"]), F.lit(False)),
        ),
        lambda p: F.struct(
            p["slug"].alias("slug"),
            F.try_element_at(F.col("__kept"), p["slug"]).alias("own"),
            deslug(p["value"]).alias("value"),
        ),
    )
    rows = rows.withColumn("__lifted", lifted)
    fills = {}
    for field, slugs in by_field.items():
        answer = _first_value(F.col("__lifted"), slugs)
        fills[field] = F.coalesce(F.col(field), answer) if field in df.columns else answer
    own_lines = F.filter(F.col("__lifted"), lambda p: p["own"].isNotNull())
    names = F.array_distinct(F.transform(own_lines, lambda p: p["own"]))
    entries = F.map_from_arrays(
        F.transform(names, lambda n: F.concat(F.lit(S.NOTE_PREFIX), n)),
        F.transform(names, lambda n: F.get(F.filter(own_lines, lambda p: p["own"] == n), F.lit(0))["value"]),
    )
    fills[S.NOTE_FIELDS] = F.when(F.size(names) > 0, entries)
    return rows.withColumns(fills).drop("__note", "__pairs", "__kept", "__lifted")


def _attach_kept(rows: DataFrame, per_sheet: DataFrame) -> DataFrame:
    """The kept labels of each row's sheet, by a size-checked lookup."""
    return lookup_join(rows, stage(per_sheet, "kept_labels"), list(SHEET_KEYS), S.ROW_ORD)


def note_columns(df: DataFrame) -> DataFrame:
    """The distinct note fields of a frame."""
    return df.select(F.explode(F.map_keys(S.NOTE_FIELDS)).alias("note_field")).distinct()


def pivot_notes(df: DataFrame, fields: list[str]) -> DataFrame:
    """Chosen note fields as columns of their own."""
    return df.withColumns({f: F.try_element_at(F.col(S.NOTE_FIELDS), F.lit(f)) for f in fields})
