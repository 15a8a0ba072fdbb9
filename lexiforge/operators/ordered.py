"""What a row takes from the rows before it in its group, without all rows of a group in one sort.

Rows are cut into ranges of the first ordering column, of a bounded number of rows over all groups.  Windows run over
(group, range); what ranges hand on, their last row and their number of rows, is one row a group and range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType

#: Rows of a range, over all groups, and the most ranges.
RANGE_ROWS, MAX_RANGES = 500_000, 1000


def _place(rows: DataFrame, name: str) -> Column:
    """Numbers that rise with a column.  Times without a zone are counted on the calendar: in the session's zone the clock
    may go back, and the order of ranges with it."""
    c = F.col(name)
    if not isinstance(rows.schema[name].dataType, (TimestampNTZType, DateType)):
        return c.cast("double")
    c = c.cast("timestamp_ntz")
    return F.unix_date(c.cast("date")).cast("double") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), c)


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``__range``, the number of their range; equal values of the first ordering column are in one range, and
    nulls, which come first, are in the first."""
    count = rows.count()
    wanted = min(MAX_RANGES, -(-count // RANGE_ROWS))
    if wanted < 2:
        return rows.withColumn("__range", F.lit(0))
    place = _place(rows, order[0]).cast("double")
    cuts = np.unique(rows.select(place.alias("_o")).approxQuantile("_o", [i / wanted for i in range(1, wanted)], 0.1 / wanted))

    @F.pandas_udf("int")
    def range_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.where(values.isna(), 0, np.searchsorted(cuts, values.to_numpy(), side="right")).astype("int32"))

    return rows.withColumn("__range", range_of(place))


def _handed_on(rows: DataFrame, by: str, value: Column, carried) -> DataFrame:
    """``rows`` with ``__carry``: what ``carried`` makes of the groupwise ``value`` of the ranges before a row's own."""
    each = rows.groupBy(F.col(by).alias("__by"), F.col("__range").alias("__carry_range")).agg(value.alias("__value"))
    each = each.withColumn("__carry", carried(F.col("__value"), Window.partitionBy("__by").orderBy("__carry_range"))).drop("__value")
    return rows.join(each, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__carry_range"))).drop("__by", "__carry_range")


def with_row_before(rows: DataFrame, by: str, order: list[str], columns: list[str], name: str = "_before") -> DataFrame:
    """``rows`` with ``name``, the struct of these columns of the row before in the group; null for the first."""
    names = rows.columns
    held = F.struct(*columns)
    rows = ranged(rows, order)
    rows = _handed_on(rows, by, F.max_by(held, F.struct(*order)), lambda v, w: F.lag(v).over(w))
    own = F.lag(held).over(Window.partitionBy(by, "__range").orderBy(*order))
    return rows.select(*names, F.coalesce(own, "__carry").alias(name))


def with_sum_before(rows: DataFrame, by: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` (whole numbers) up to each row and all that are equal in ``order``."""
    names = rows.columns
    rows = ranged(rows.withColumn("__x", value), order)
    rows = _handed_on(rows, by, F.sum("__x"), lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.sum("__x").over(Window.partitionBy(by, "__range").orderBy(*order))
    return rows.select(*names, (own + F.coalesce("__carry", F.lit(0))).cast("long").alias(name))


def with_number(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, their number in the group from 1."""
    names = rows.columns
    rows = _handed_on(ranged(rows, order), by, F.count("*"), lambda v, w: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy(by, "__range").orderBy(*order))
    return rows.select(*names, (own + F.coalesce("__carry", F.lit(0))).cast("long").alias(name))
