"""Running values of keys that may hold nearly all rows: a scan in segments.

Rows are cut by a range sort of their order into segments of about equal size, whatever key they have.
Each segment is folded to the last value of each of its keys, a scan over these few rows finds what each
key brings into each segment, and this goes before the segment's rows. So a window reaches over one
segment, never over a whole key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


_FOLDS = {"most": F.max, "total": F.sum}


@dataclass(frozen=True)
class Running:
    """The last or the largest value (not null) of a column so far, or the sum; `before` leaves the row itself out."""

    column: Column
    kind: str = "last"
    before: bool = False

    def over(self, value: Column, window) -> Column:
        frame = window.rowsBetween(Window.unboundedPreceding, -1 if self.before else Window.currentRow)
        return (F.last(value, ignorenulls=True) if self.kind == "last" else _FOLDS[self.kind](value)).over(frame)


def last(column: Column, before: bool = False) -> Running:
    return Running(column, "last", before)


def most(column: Column, before: bool = False) -> Running:
    return Running(column, "most", before)


def total(column: Column, before: bool = False) -> Running:
    return Running(column, "total", before)


def segmented(rows: DataFrame, order: list[str], name: str = "segments") -> DataFrame:
    """rows in a written table with `segment`, which rises with the order; a segment is a partition of the range sort."""
    return written(rows.repartitionByRange(*order).withColumn("segment", F.spark_partition_id()), name)


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Running]) -> DataFrame:
    """rows with the values of their key (nulls are a key) so far in the order, one column for each of `values`.

    Rows of one order, if there are any, stand in no order of their own, but each before or after another.
    """
    columns = rows.columns
    held = {name: f"scan_{i}" for i, name in enumerate(values)}
    placed = segmented(rows.withColumns({held[n]: v.column for n, v in values.items()}), order)
    count = (placed.agg(F.max("segment")).first()[0] or 0) + 1
    inside = Window.partitionBy("segment", *keys).orderBy("scan_row", *order)
    if count == 1:  # nothing is brought into a first segment
        only = placed.withColumn("scan_row", F.lit(1))
        return only.withColumns({n: v.over(F.col(held[n]), inside) for n, v in values.items()}).select(*columns, *values)
    at = F.struct(*order)
    folds = [_FOLDS[v.kind](held[n]).alias(held[n]) if v.kind in _FOLDS else F.max_by(held[n], F.when(F.col(held[n]).isNotNull(), at)).alias(held[n]) for n, v in values.items()]
    ends = placed.groupBy("segment", *keys).agg(*folds)
    earlier = Window.partitionBy(*keys).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select("segment", *keys, *[(_FOLDS[v.kind](c) if v.kind in _FOLDS else F.last(c, ignorenulls=True)).over(earlier).alias(c) for c, v in zip(held.values(), values.values())])
    brought = brought.where(" OR ".join(f"{c} IS NOT NULL" for c in held.values()))
    both = placed.withColumn("scan_row", F.lit(1)).unionByName(brought.withColumn("scan_row", F.lit(0)), allowMissingColumns=True)
    out = both.repartitionById(count, "segment").withColumns({n: v.over(F.col(held[n]), inside) for n, v in values.items()})
    return out.where("scan_row = 1").select(*columns, *values)
