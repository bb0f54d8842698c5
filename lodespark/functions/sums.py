"""Sums and means of doubles: exact ones that do not depend on the order of rows, and those of doubles in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def total(x: Column) -> Column:
    """Sum by decimals of 12 places; of doubles where a value has no such decimal (NaN, infinite, 10^16 or more)."""
    d = x.try_cast("decimal(28,12)")
    return F.when(F.count_if(x.isNotNull() & d.isNull()) > 0, F.sum(x)).otherwise(F.sum(d).cast("double"))


def ratio(x: Column, y: Column) -> Column:
    """x / y to 12 places, so that what is a tie in decimals is one in doubles."""
    return F.round(F.try_divide(x, y), 12)


def mean(x: Column) -> Column:
    return ratio(total(x), F.count(x))


def place() -> Column:
    """Where a row stands in its table's files: the order in which a single reader adds the rows up."""
    return F.struct("_metadata.file_path", "_metadata.row_index")


def running(rows: DataFrame, by: str, columns: dict[str, Column]) -> DataFrame:
    """Adds each column's sum of doubles within ``by`` up to the row's ``place``; the last row's is the sum in that order."""
    upto = Window.partitionBy(by).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({name: F.sum(x).over(upto) for name, x in columns.items()})
