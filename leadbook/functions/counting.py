"""Counts of leads, over rows of leads or over rows that already count them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leads(where: Column | None = None, counted: str | None = None) -> Column:
    """How many leads meet `where`; `counted` names a column of counts, else a row is one lead."""
    if counted is None:
        return F.count(F.lit(1)) if where is None else F.count_if(where)
    n = F.col(counted) if where is None else F.when(where, F.col(counted))
    return F.coalesce(F.sum(n), F.lit(0))
