"""Reading export files: encoding and header per file, one scan for all layouts."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadbook import schema as S
from leadbook.functions.text import READER_NULL_TOKENS, repair_encoding
from leadbook.operators.headers import canonical_names, matched_fields, sheet_headers
from leadbook.runtime import stage
from leadbook.sources.records import BLOCK, LINE, PATH, PLACE, cells_of, file_records

_LAYOUT = "header string, mapped string, places array<int>, others array<struct<name:string,place:int>>, width int, matched_fields long, column_count long"


class NoHeaderError(ValueError):
    """None of the files has a line with anything on it."""


def decoded_path(path):
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def literal_path(path: str) -> str:
    """A path in which no character is read as a pattern."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def file_name(path):
    return F.element_at(F.split(decoded_path(path), "/"), -1)


# A first cell without quotes that the reader does not take for null: most records need no further look.
_PRESENT = r"^(?!(?:" + "|".join(re.escape(t) for t in READER_NULL_TOKENS if t) + r")?(?:,|\r?$))[^\",\r]"


def _anything(line: Column) -> Column:
    """Whether a record has a cell that the reader does not take for null."""
    some = F.exists(cells_of(F.regexp_replace(line, "\r$", "")), lambda c: ~c.isin(*READER_NULL_TOKENS))
    return F.when(line.rlike(_PRESENT), True).otherwise(some)


def _as_text(line: Column, utf8: Column) -> Column:
    text = F.when(utf8, line).otherwise(F.decode(line.cast("binary"), "ISO-8859-1"))
    return repair_encoding(F.regexp_replace(text, "^\ufeff|\r$", ""))


def _blocks(records: DataFrame) -> DataFrame:
    """One staged row per block of a file: its rows, what `_files` asks of it, and the offset of its row numbers in the file."""
    first = F.struct(BLOCK, PLACE, F.col(LINE).cast("binary").alias("line"))
    counted = records.groupBy(PATH, BLOCK).agg(
        F.min(PLACE).alias("first"), F.count("*").alias("n"), F.bool_and(F.is_valid_utf8(LINE)).alias("utf8"), F.min(first).alias("opening")
    )
    in_file = Window.partitionBy(PATH).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # The header is the file's first record and takes no number.
    offset = F.coalesce(F.sum("n").over(in_file), F.lit(0)) - F.col("first") - 1
    return stage(stage(counted, "counted_blocks").withColumn("offset", offset), "blocks")


def _files(records: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """One staged row per file: whether it is UTF-8, its header, its rows, and where they are numbered from.

    A file is read as UTF-8 only if all of its records are; the header is its first
    record with anything on it.  Row numbers run over files, then blocks.  The blocks stay
    rows of their own: a file has as many as it has splits, or cuts of them.
    """
    files = (blocks or _blocks(records)).groupBy(PATH).agg(
        F.bool_and("utf8").alias("utf8"), F.min("opening").alias("opening"), (F.sum("n") - 1).alias("n")
    )
    start = F.coalesce(F.sum("n").over(Window.orderBy(PATH).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    header = _as_text(F.col("opening.line").cast("string"), F.col("utf8"))
    at = F.struct(F.col(f"opening.{BLOCK}").alias("block"), F.col(f"opening.{PLACE}").alias("place"))
    named = repair_encoding(file_name(F.col(PATH)))
    return stage(files.select(PATH, "utf8", header.alias("header"), at.alias("at"), "n", start.alias("start"), named.alias("file")), "files")


def _checked_mapping(mapping: dict[str, str], headers: list[str]) -> dict[str, str]:
    """The renames that a file can take: known column, known field, first claim on it."""
    claims: dict[str, str] = {}
    for source, field in mapping.items():
        if source in headers and field in S.CANONICAL_FIELDS:
            claims.setdefault(field, source)
    return {source: field for field, source in claims.items()}


def _layout(header: str, mapping: dict[str, str]) -> tuple:
    """Where a layout has each canonical field, and its other columns."""
    headers = sheet_headers(next(csv.reader(io.StringIO(header, newline=""))))
    renames = _checked_mapping(mapping, headers)
    names = canonical_names([renames.get(h, h) for h in headers])
    place = {name: k for k, name in enumerate(names)}
    others = [(name, k) for k, name in enumerate(names) if name not in S.CANONICAL_FIELDS]
    return [place.get(f) for f in S.CANONICAL_FIELDS], others, len(names), matched_fields(names), len(names)


def _with_layouts(spark: SparkSession, files: DataFrame, mappings: dict[str, dict[str, str]]) -> DataFrame:
    """Files with their layouts, which are rows: the driver sees each distinct header once, not each file."""
    mapped = F.when(F.col("file").isin(*mappings), F.col("file")) if mappings else F.lit(None).cast("string")
    keyed = files.withColumn("mapped", F.coalesce(mapped, F.lit("")))
    rows = [
        (r["header"], r["mapped"], *_layout(r["header"], mappings.get(r["mapped"], {})))
        for r in keyed.select("header", "mapped").distinct().collect()
    ]
    if not rows:
        raise NoHeaderError("no file with a header row")
    return stage(keyed.join(spark.createDataFrame(rows, _LAYOUT), ["header", "mapped"]).drop("header", "mapped"), "layouts")


def _lead_cells(line: Column) -> Column:
    """The cells of a record as text, those that the reader takes for null as nulls."""
    return F.transform(cells_of(line), lambda c: F.when(~c.isin(*READER_NULL_TOKENS), c))


def read_exports(
    spark: SparkSession, paths: list[str] | str, mappings: dict[str, dict[str, str]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """All rows of the files in canonical columns, and (source_file, matched_fields, column_count).

    Files are read in splits, whether or not cells hold line breaks, by one scan for all
    header layouts: a layout is a row that says where each field stands, and joins the
    records by file.  `mappings` renames columns of single files before the alias table is
    applied; a column that the file lacks, a field that does not exist and a second claim on
    a field are passed over.  Cells beyond a file's header are kept in `extras` as
    `Unnamed: <place>`.  Rows are numbered over files and splits without a sort.
    """
    records = file_records(spark, paths, _anything)
    blocks = _blocks(records)
    files = _with_layouts(spark, _files(records, blocks), mappings or {})
    matches = files.select(F.col("file").alias(S.SOURCE_FILE), "matched_fields", "column_count")
    return stage(_projected(records, files, blocks), "export_rows"), matches


def _projected(records: DataFrame, files: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Records in canonical columns, each by the layout of its file."""
    offsets = (blocks or _blocks(records)).select(PATH, BLOCK, "offset")
    read = records.join(files, PATH).join(offsets, [PATH, BLOCK]).where(F.struct(F.col(BLOCK), F.col(PLACE)) != F.struct("at.block", "at.place"))
    order = F.col("start") + F.col("offset") + F.col(PLACE)
    rows = read.select(
        "file", "places", "others", "width", order.alias(S.ROW_ORD), _lead_cells(_as_text(F.col(LINE), F.col("utf8"))).alias("cells")
    )
    fields = [F.get("cells", F.get("places", k)).alias(f) for k, f in enumerate(S.CANONICAL_FIELDS)]
    entry = lambda name, place: F.struct(name.alias("key"), F.get("cells", place).alias("value"))
    known = F.transform("others", lambda o: entry(o["name"], o["place"]))
    beyond = F.transform(
        F.when(F.size("cells") > F.col("width"), F.sequence(F.col("width"), F.size("cells") - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: entry(F.concat(F.lit("Unnamed: "), k.cast("string")), k),
    )
    held = F.filter(F.concat(known, beyond), lambda e: e["value"].isNotNull())
    extras = F.when((F.size("others") > 0) | (F.size("cells") > F.col("width")), F.map_from_entries(held))
    has_campaign = F.get("places", S.CANONICAL_FIELDS.index("campaign")).isNotNull()
    return rows.select(
        *fields, extras.cast(S.STRING_MAP).alias(S.EXTRAS), has_campaign.alias(S.HAS_CAMPAIGN), S.ROW_ORD,
        F.col("file").alias(S.SOURCE_FILE), F.col("file").alias(S.SOURCE_SHEET),
    )


def harmonise(df: DataFrame) -> DataFrame:
    """Every lead field as text, so frames that typed a field differently can be stored together."""
    keep = {S.ROW_ORD, S.EXTRAS, S.NOTE_FIELDS, S.MERGED_COUNT, S.MEMBER_FRAMES, "budget_value"}
    other = {f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "map", "array")}
    casts = {c: F.col(f"`{c}`").cast("string") for c in df.columns if c not in keep | other}
    return df.withColumns(casts) if casts else df
