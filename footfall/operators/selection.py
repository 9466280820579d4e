"""The first n rows by time and id, found by counting instead of in one task's top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows that one task may rank.
NEAR = 10_000
# Ids of one time are counted by prefixes that grow by so many characters.
_PREFIX, _LONGEST = 3, 256


def _literal(value, kind: T.DataType) -> Column:
    return F.lit(value).cast(kind)


def newest_first(rows: DataFrame, time: str, n: int, id_col: str = "id", near: int = NEAR) -> Column | None:
    """A condition that the first ``n`` rows meet, newest first, those without a time last, equal times by id; None for all rows.

    Counts by day show how many days lie wholly among them and which one is cut. That day is counted by
    second, the second by time, the time by growing prefixes of the id, until at most ``near`` rows of the
    one cut are left, which are ranked. So no task holds the rows, however many share a time. Each count
    is a job over what the one before has left, of which the driver learns one row: the cell that is cut.
    """
    if n <= 0:
        return F.lit(False)
    second = F.date_trunc("second", F.col(time)).cast("timestamp_ntz")
    levels = [(F.to_date(F.col(time)), True), (second, True), (F.col(time), True)]
    levels += [(F.left(F.col(id_col), F.lit(length)), False) for length in range(_PREFIX, _LONGEST + _PREFIX, _PREFIX)]
    inside, taken = F.lit(True), []
    for key, newest in levels:
        cells = rows.where(inside).groupBy(key.alias("cell")).agg(F.count("*").alias("size"))
        kind = cells.schema["cell"].dataType
        order = F.desc_nulls_last("cell") if newest else F.asc("cell")
        # One row a day, a second of a day, a time of a second or a prefix.
        running = F.sum("size").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        cut = cells.withColumn("upto", running).where(F.col("upto") >= n).orderBy("upto").limit(1).collect()
        if not cut:  # fewer rows than asked for
            return None if not taken else _any([*taken, inside])
        cell, size, upto = cut[0]
        value = _literal(cell, kind)
        before = key.isNotNull() if cell is None else key > value if newest else key < value
        taken.append(inside & F.coalesce(before, F.lit(False)))
        inside, n = inside & key.eqNullSafe(value), n - (upto - size)
        if n == size:
            return _any([*taken, inside])
        if size <= near:
            break
    order = [F.desc_nulls_last(time), F.asc(id_col)]
    last = rows.where(inside).orderBy(*order).limit(n).orderBy(F.asc_nulls_first(time), F.desc(id_col)).select(time, id_col).first()
    value = _literal(last[0], rows.schema[time].dataType)
    later = F.col(time).isNotNull() if last[0] is None else F.coalesce(F.col(time) > value, F.lit(False))
    same = F.col(time).eqNullSafe(value) & (F.col(id_col) <= F.lit(last[1]))
    return _any([*taken, inside & (later | same)])


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for condition in conditions[1:]:
        found = found | condition
    return found
