"""Cross-tabs with coverage, all of a report in one scan.

A cross-tab is kept as its non-empty cells; a cell that is not there counts
zero.  Axes can be as long as the data makes them, so the full grid is spelled
out only where an axis is bounded: the folded chart, or a column list given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadbook.functions.counting import leads
from leadbook.functions.text import clean

MAX_CHART_COLUMNS = 8
MAX_CHART_ROWS = 11
THIN_COVERAGE = 0.25


def crosstab_cells(
    df: DataFrame, sections: dict[str, tuple[Column, Column]], counted: str | None = None
) -> DataFrame:
    """(section, row_label, col_label, n), including the rows missing a label.

    `counted` names a column of counts, where a row stands for several leads.
    """
    pairs = [
        F.struct(F.lit(s).alias("section"), clean(r).alias("row_label"), clean(c).alias("col_label"))
        for s, (r, c) in sections.items()
    ]
    weight = [counted] if counted else []
    long = df.select(*weight, F.explode(F.array(*pairs)).alias("pair")).select(*weight, "pair.*")
    return long.groupBy("section", "row_label", "col_label").agg(leads(counted=counted).alias("n"))


def coverage(cells: DataFrame) -> DataFrame:
    """How many leads each cross-tab could use, and whether that is thin."""
    missing = lambda c: F.sum(F.when(F.col(c).isNull(), F.col("n")).otherwise(0))
    both = F.col("row_label").isNotNull() & F.col("col_label").isNotNull()
    counted = cells.groupBy("section").agg(
        F.sum(F.when(both, F.col("n")).otherwise(0)).alias("counted"),
        F.sum("n").alias("total"),
        missing("row_label").alias("missing_rows"),
        missing("col_label").alias("missing_cols"),
    )
    thin = (F.col("total") > 0) & (F.col("counted") / F.col("total") < THIN_COVERAGE)
    return counted.withColumn("thin", thin)


def counted_cells(cells: DataFrame) -> DataFrame:
    return cells.filter(F.col("row_label").isNotNull() & F.col("col_label").isNotNull())


def crosstab(cells: DataFrame) -> DataFrame:
    """Counted cells with their marginal totals, largest rows and columns first."""
    counted = counted_cells(cells)
    rows = counted.groupBy("section", "row_label").agg(F.sum("n").alias("row_total"))
    cols = counted.groupBy("section", "col_label").agg(F.sum("n").alias("col_total"))
    return (
        counted.join(rows, ["section", "row_label"]).join(cols, ["section", "col_label"])
        .select("section", "row_label", "col_label", "n", "row_total", "col_total")
        .orderBy("section", F.desc("row_total"), "row_label", F.desc("col_total"), "col_label")
    )


def wide_crosstab(cells: DataFrame, section: str, columns: list[str]) -> DataFrame:
    """One cross-tab as a full grid over the given column labels, zeros included."""
    counted = counted_cells(cells).filter(F.col("section") == section)
    grid = counted.groupBy("row_label").pivot("col_label", columns).agg(F.sum("n"))
    return grid.select("row_label", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in columns])


def _axis(counted: DataFrame, label: str, slots: int, other: Column) -> DataFrame:
    """The kept labels of one axis, at most `slots` per section, and the tail's name."""
    totals = counted.groupBy("section", label).agg(F.sum("n").alias("axis_total"))
    sizes = totals.groupBy("section").agg(F.count(F.lit(1)).alias("size"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("axis_total"), label))
    head = totals.withColumn("position", rank).filter(F.col("position") <= slots)
    kept = head.join(F.broadcast(sizes), "section").filter(
        (F.col("size") <= slots) | (F.col("position") < slots)
    )
    return kept.select("section", label, "position", other.alias("tail_name"))


def fold_matrix(cells: DataFrame) -> DataFrame:
    """Chart form: at most 8 columns and 11 rows, tails folded, share of each row.

    The kept labels are at most 11 per section, so they are broadcast; the grid
    is filled with zeros over the folded axes only.
    """
    counted = counted_cells(cells)
    tail = F.concat(F.lit("Other ("), (F.col("size") - MAX_CHART_ROWS + 1).cast("string"), F.lit(" categories)"))
    rows = _axis(counted, "row_label", MAX_CHART_ROWS, tail)
    cols = _axis(counted, "col_label", MAX_CHART_COLUMNS, F.lit("Other"))
    row_tail = rows.groupBy("section").agg(F.max("tail_name").alias("row_tail"))
    placed = (
        counted
        .join(F.broadcast(rows.select("section", "row_label", F.col("position").alias("row_position"))), ["section", "row_label"], "left")
        .join(F.broadcast(cols.select("section", "col_label", F.col("position").alias("col_position"))), ["section", "col_label"], "left")
        .join(F.broadcast(row_tail), "section")
    )
    folded = placed.select(
        "section",
        F.coalesce("row_position", F.lit(MAX_CHART_ROWS)).alias("row_position"),
        F.when(F.col("row_position").isNull(), F.col("row_tail")).otherwise(F.col("row_label")).alias("row_label"),
        F.coalesce("col_position", F.lit(MAX_CHART_COLUMNS)).alias("col_position"),
        F.when(F.col("col_position").isNull(), "Other").otherwise(F.col("col_label")).alias("col_label"),
        "n",
    ).groupBy("section", "row_position", "row_label", "col_position", "col_label").agg(F.sum("n").alias("n"))

    # Fill the grid: every kept row of a section carries the section's kept columns.
    row_axis = folded.groupBy("section", "row_position", "row_label").agg(F.sum("n").alias("row_total"))
    col_axis = folded.groupBy("section").agg(
        F.array_sort(F.collect_set(F.struct("col_position", "col_label"))).alias("axis")
    )
    grid = row_axis.join(F.broadcast(col_axis), "section").select(
        "section", "row_position", "row_label", "row_total", F.explode("axis").alias("c")
    ).select("section", "row_position", "row_label", "row_total", "c.col_position", "c.col_label")
    keys = ["section", "row_position", "row_label", "col_position", "col_label"]
    return (
        grid.join(folded, keys, "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("row_percent", F.round(F.col("n") / F.col("row_total") * 100, 2))
        .select(*keys, "n", "row_percent")
        .orderBy("section", "row_position", "col_position")
    )
