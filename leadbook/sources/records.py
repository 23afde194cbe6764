"""Records of CSV files, found in parallel: a record may span lines, files are still read in splits.

Whether a line begins inside a quoted cell depends on everything before it.  But a line
only maps "outside or inside at its start" to the same at its end, and such maps compose:
a line that ends in one way whatever came before settles it, any other line keeps it or
swaps it.  So windows over the lines of each split find the last settling line and the swaps since, the few
splits of a file are composed in the same way, and each line then knows where it begins.

Only files with a line break inside a cell go through this; in all others a line is a record.
Their splits are cut again by number of lines, because lines are shuffled here: with whole
splits as keys, a few tasks would hold hundreds of megabytes each and others nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadbook.runtime import stage

PATH, BLOCK, PLACE, LINE = "__path", "__block", "__place", "__line"
_SEEN = "__seen"
# Lines of a file with line breaks are dealt in cuts of 2^12; lines and splits bound a cut's size.
_CUT_BITS = 12
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'  # up to the closing quote
_CELLS = rf'(?:(?:{_QUOTED}"[^,]*+|[^",][^,]*+|),)*+'  # each with the comma behind it
_OPENS = rf"^{_CELLS}{_QUOTED}$"
_STAYS = rf'^[^"]*+(?:""[^"]*+)*+(?:$|"[^,]*+,{_CELLS}{_QUOTED}$)'
_CELL = rf',({_QUOTED}"[^,]*+|[^,]*+)'


def cells_of(line: Column) -> Column:
    """The cells of a record; quoted ones without their quotes."""
    bare = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    quoted = lambda c: c.startswith('"') & c.endswith('"') & (F.length(c) > 1)
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f"(?s){_CELL}"), F.lit(1))
    return F.transform(found, lambda c: F.when(quoted(c), bare(c)).otherwise(c))


def _lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias(PATH),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(_SEEN),
        F.col("value").alias(LINE),
    )


def _block(cut: Column) -> Column:
    """A block of a file: a split, or a cut of one; blocks sort as their lines stand in the file."""
    return F.struct(F.col(BLOCK).alias("start"), cut.cast("long").alias("cut")).alias(BLOCK)


def _xor(a: Column, b: Column) -> Column:
    return (a + b) % 2


def _composed(rows: DataFrame, within: list[str], order: str) -> DataFrame:
    """For rows with `opens` and `stays` (0 or 1), what all rows of the group before each amount to.

    `set_before` is the settled outcome, null while nothing settles it, and `swap_before`
    whether the outcome is swapped since; `set_to` and `swap_to` the same with the row itself.
    """
    to = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    swap = F.when((F.col("opens") == 1) & (F.col("stays") == 0), 1).otherwise(0)
    counted = rows.withColumn("swap_to", F.sum(swap).over(to) % 2).withColumn("swap_before", _xor(F.col("swap_to"), swap))
    settles = F.when(F.col("opens") == F.col("stays"), _xor(F.col("opens"), F.col("swap_to")))
    return counted.withColumn("__settles", settles).withColumns(
        {"set_before": F.last("__settles", True).over(before), "set_to": F.last("__settles", True).over(to)}
    ).drop("__settles")


def _outcome(entry: Column, settled: str, swap: str) -> Column:
    """Inside (1) or outside (0), from the entry and what lies between."""
    return _xor(F.coalesce(F.col(settled), entry), F.col(swap))


def _joined_lines(lines: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Kept records (path, block, place, line) of files whose cells hold line breaks.

    A record stands in the block of its first line.  Where a quote is never closed, it is
    taken as it stands and the lines behind it are records of their own.  Lines are
    shuffled by block, which bounds a group, and joined there; what belongs to a record of
    an earlier block, some lines at a block's beginning, then moves to it.
    """
    flags = {"opens": F.col(LINE).rlike(_OPENS).cast("int"), "stays": F.col(LINE).rlike(_STAYS).cast("int")}
    told = _composed(lines.withColumns(flags), [PATH, BLOCK], _SEEN)
    so_far = Window.partitionBy(PATH, BLOCK).orderBy(_SEEN).rowsBetween(Window.unboundedPreceding, 0)
    owner = lambda entry: F.last(F.when(_outcome(F.lit(entry), "set_before", "swap_before") == 0, F.col(_SEEN)), True).over(so_far)
    owned = told.withColumns({"owner_0": owner(0), "owner_1": owner(1)})
    # Lines that belong to one record whatever the entry; the columns of the split stay the grouping's first.
    parts = F.array_sort(F.collect_list(F.struct(_SEEN, LINE)))
    pieces = owned.groupBy(PATH, BLOCK, "owner_0", "owner_1").agg(
        F.array_join(parts[LINE], "\n").alias(LINE), F.min(_SEEN).alias(_SEEN), F.max(F.struct(_SEEN, "set_to", "swap_to")).alias("end")
    )
    pieces = stage(pieces, "pieces")
    # One row per block: what it does to an entry, and its last record's first line for either entry.
    ends = pieces.groupBy(PATH, BLOCK).agg(F.max(F.struct("end", "owner_0", "owner_1")).alias("e")).select(PATH, BLOCK, "e.end.*", "e.owner_0", "e.owner_1")
    maps = {"opens": _outcome(F.lit(0), "set_to", "swap_to"), "stays": _outcome(F.lit(1), "set_to", "swap_to")}
    splits = _composed(ends.withColumns(maps).drop("set_to", "swap_to", _SEEN), [PATH], BLOCK)
    entry, leaves = _outcome(F.lit(0), "set_before", "swap_before"), _outcome(F.lit(0), "set_to", "swap_to")
    last = F.when(entry == 0, F.col("owner_0")).otherwise(F.col("owner_1"))
    placed = splits.withColumns({"entry": entry, "leaves": leaves}).withColumn("last", F.when(last.isNotNull(), F.struct(BLOCK, last.alias(_SEEN))))
    before = Window.partitionBy(PATH).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(PATH).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    torn = F.when(F.last("leaves").over(whole) == 1, F.last("last", True).over(whole))
    carried = placed.select(PATH, BLOCK, "entry", F.last("last", True).over(before).alias("carried"), torn.alias("torn"))
    met = pieces.join(carried, [PATH, BLOCK])
    own = F.when(F.col("entry") == 0, F.col("owner_0")).otherwise(F.col("owner_1"))
    head = F.coalesce(F.when(own.isNotNull(), F.struct(BLOCK, own.alias(_SEEN))), F.col("carried"), F.struct(BLOCK, _SEEN))
    single = F.coalesce(head == F.col("torn"), F.lit(False))
    headed = met.select(PATH, BLOCK, _SEEN, LINE, head.alias("head"), single.alias("single"))
    mine = headed.where("NOT single").select(PATH, "head.*", F.col(BLOCK).alias("b"), F.col(_SEEN).alias("s"), LINE)
    records = mine.repartition(PATH, BLOCK).groupBy(PATH, BLOCK, _SEEN).agg(F.array_join(F.array_sort(F.collect_list(F.struct("b", "s", LINE)))[LINE], "\n").alias(LINE))
    # A torn record's lines keep their order behind its first one.
    alone = headed.where("single").select(PATH, BLOCK, _SEEN, F.posexplode(F.split(LINE, "\n")).alias("nth", LINE))
    both = records.withColumn("nth", F.lit(0)).unionByName(alone).filter(keep(F.col(LINE)))
    place = F.row_number().over(Window.partitionBy(PATH, BLOCK).orderBy(_SEEN, "nth")).cast("long")
    return both.select(PATH, BLOCK, place.alias(PLACE), LINE)


def file_records(spark: SparkSession, paths: list[str] | str, keep: Callable[[Column], Column]) -> DataFrame:
    """Staged (path, block, place, line) of the records of CSV files that `keep(line)` wants.

    A record's line is raw text in its file's encoding, with any line break inside it as
    a newline.  `place` counts the kept records of a block on from any number.
    """
    lines = _lines(spark, paths)
    broken = stage(lines.filter(F.col(LINE).rlike(_OPENS)).select(PATH).distinct(), "broken_files")
    # Places are given in the scan itself, and once: another scan may cut the files elsewhere.
    kept = lines.filter(keep(F.col(LINE))).select(PATH, _block(F.lit(0)), F.monotonically_increasing_id().alias(PLACE), LINE)
    records = stage(kept.join(broken, PATH, "left_anti"), "records")
    if broken.isEmpty():
        return records
    cut = lines.join(broken, PATH, "left_semi").select(PATH, _block(F.shiftright(_SEEN, _CUT_BITS)), _SEEN, LINE)
    joined = _joined_lines(cut, keep)
    return records.unionByName(stage(joined, "joined_records"))
