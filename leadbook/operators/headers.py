"""Headers: canonical names, collisions, proposals and samples.

Header names are metadata of a sheet, so naming them is driver work over short
lists; everything that touches rows or many sheets at once is a DataFrame job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.functions.text import trimmed

MIN_LEAD_FIELDS = 5
MIN_PROPOSAL_COLUMNS = 4
MIN_PROPOSAL_ROWS = 2
SAMPLE_ROWS = 10
SAMPLE_CHARS = 60


def sheet_headers(cells: list[str | None]) -> list[str]:
    """Column names of a raw header row: blanks numbered, repeats suffixed `.1`, `.2`."""
    names: list[str] = []
    for position, cell in enumerate(cells):
        base = cell if cell and cell.strip() else f"Unnamed: {position}"
        name, repeat = base, 0
        while name in names:
            repeat += 1
            name = f"{base}.{repeat}"
        names.append(name)
    return names


def canonical_names(headers: list[str]) -> list[str]:
    """Canonical field per header; unknown headers keep their name.

    A second header with the same meaning is suffixed `_2`, a third `_3`; a
    suffixed name that is itself taken moves on to the next number.
    """
    names: list[str] = []
    for header in headers:
        field = S.KEY_TO_FIELD.get(S.header_key(header), str(header))
        name, number = field, 1
        while name in names:
            number += 1
            name = f"{field}_{number}"
        names.append(name)
    return names


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*canonical_names(df.columns))


def matched_fields(names: list[str]) -> int:
    return len(set(names) & set(S.CANONICAL_FIELDS))


def looks_like_leads(names: list[str]) -> bool:
    return matched_fields(names) >= MIN_LEAD_FIELDS


def wants_proposal(matched: Column, columns: Column, rows: Column) -> Column:
    """A sheet the alias table does not know, but wide and long enough to be leads."""
    return (matched < MIN_LEAD_FIELDS) & (columns >= MIN_PROPOSAL_COLUMNS) & (rows >= MIN_PROPOSAL_ROWS)


def ensure_canonical(df: DataFrame) -> DataFrame:
    """Add missing canonical fields as nulls; move unknown columns into `extras`."""
    fixed = {f.name for f in S.LEAD_ROW_SCHEMA.fields} | {S.UPLOAD_ID}
    unknown = [c for c in df.columns if c not in fixed]
    out = df
    if unknown:
        pairs = [x for c in unknown for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
        extras = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
        if S.EXTRAS in df.columns:
            extras = F.map_concat(F.coalesce(F.col(S.EXTRAS), F.create_map().cast(S.STRING_MAP)), extras)
        out = out.withColumn(S.EXTRAS, extras).drop(*unknown)
    missing = [f for f in S.LEAD_ROW_SCHEMA.fields if f.name not in out.columns and f.name != S.ROW_ORD]
    out = out.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    order = [f.name for f in S.LEAD_ROW_SCHEMA.fields if f.name in out.columns]
    return out.select(*[c for c in (S.UPLOAD_ID,) if c in out.columns], *order)


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename mapped columns, leave the rest."""
    return df.withColumnsRenamed(mapping) if mapping else df


def valid_proposals(proposals: DataFrame, columns: DataFrame, fields: tuple[str, ...] = S.CANONICAL_FIELDS) -> DataFrame:
    """Proposed column mappings that may be applied.

    `proposals` has (sheet_key, source_col, target_field, ord), `columns` has
    (sheet_key, source_col).  Unknown columns and unknown fields are dropped, and
    of several claims on one field the first wins.
    """
    allowed = proposals.filter(F.col("target_field").isin(*fields))
    known = allowed.join(columns.select("sheet_key", "source_col"), ["sheet_key", "source_col"], "left_semi")
    first = F.min(F.struct("ord", "source_col")).alias("first")
    claims = known.groupBy("sheet_key", "target_field").agg(first)
    return claims.select("sheet_key", F.col("first.source_col").alias("source_col"), "target_field")


# Fields a note label may not be routed to by a proposal.
PROTECTED_NOTE_TARGETS = ("qualitative_remarks", "name", "email", "phone")


def safe_note_proposals(proposals: DataFrame, target_col: str = "target_field") -> DataFrame:
    """Label proposals without those aimed at identity fields or the note text itself."""
    return proposals.filter(~F.col(target_col).isin(*PROTECTED_NOTE_TARGETS))


def column_sample(df: DataFrame, order_col: str, columns: list[str]) -> DataFrame:
    """Up to ten short values of each column, taken from the ten fullest rows."""
    filled = F.expr(" + ".join(f"int(`{c}` IS NOT NULL)" for c in columns))
    fullest = df.select(order_col, *columns, filled.alias("__filled")).orderBy(F.desc("__filled"), order_col)
    head = fullest.limit(SAMPLE_ROWS)
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    )
    long = head.select("__filled", order_col, cells.alias("cell")).select(
        "__filled", order_col, "cell.column_name", trimmed(F.col("cell.v")).alias("v")
    )
    values = long.filter(F.col("v") != "")
    position = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("__filled"), order_col))
    return values.select(
        "column_name", position.alias("position"), F.substring("v", 1, SAMPLE_CHARS).alias("value")
    )
