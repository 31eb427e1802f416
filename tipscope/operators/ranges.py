"""Places and running sums over a whole table, in the order of any sortable key.

The key columns, and the values that are summed, are cut into ranges by a range
shuffle, sorted within them and written once, each row with its number within
its range. A directory has one row per range: its rows, its sum, and the prefix
sums of both. What a row needs of the rows before it is its range's prefix and
its own number, so no task sees more than a range.

Ranges are cut by key and then by row, so rows with equal keys, even all of
them, are spread over ranges; the number of ranges grows with the rows. NULL
keys come first. Rows with equal keys get places in an arbitrary, but fixed
order: the written table keeps it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipscope.functions.sizing import broadcast_if_small
from tipscope.sources import files

#: Rows of a range.
RANGE_ROWS = 1_000_000
#: Directories up to this size are broadcast (after a count).
DIRECTORY_ROWS = 1_000_000


@dataclass
class Directory:
    """A table in key order (``rows``, with ``_range`` and ``_at``) and its ranges:
    ``_range``, ``_first``, ``_rows``, ``_before`` (rows of earlier ranges) and, where
    values are summed, ``_sum_before``."""
    rows: DataFrame
    ranges: DataFrame
    key: list[str]

    def _joined(self) -> DataFrame:
        return self.rows.join(broadcast_if_small(self.ranges, DIRECTORY_ROWS), "_range")

    def positions(self) -> DataFrame:
        """The rows with ``_pos``, their place from 0."""
        return (self._joined().withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first"))
                .drop(*_OWN, "_sum_before"))

    def running(self, value: str, place: bool = False) -> DataFrame:
        """The rows with ``_offset``, the sum of ``value`` over all earlier rows;
        ``place``: with ``_pos`` too."""
        earlier = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        own = F.coalesce(F.sum(value).over(earlier), F.lit(0))
        out = self._joined().withColumn("_offset", F.col("_sum_before") + own)
        if place:
            out = out.withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first"))
        return out.drop(*_OWN, "_sum_before")

    def count(self) -> int:
        return self.ranges.agg(F.sum("_rows")).first()[0] or 0

    def slice(self, start: int, rows: int | None) -> DataFrame:
        """Rows ``start`` (from 0) to ``start + rows`` in key order. Only the files
        of the ranges that hold them are read."""
        if rows is None and start == 0:
            return self.rows.orderBy(*_sorted(self.key), "_at").drop("_range", "_at")
        stop = F.lit(None).cast("long") if rows is None else F.lit(start + rows).cast("long")
        held = self.ranges.where((F.col("_before") + F.col("_rows") > start)
                                 & F.coalesce(F.col("_before") < stop, F.lit(True)))
        found = held.select("_range", "_before", "_first").collect()  # ranges of one page
        if not found:
            return self.rows.limit(0).drop("_range", "_at")
        at = F.create_map(*[x for r in found for x in (F.lit(r["_range"]), F.lit(r["_before"] - r["_first"]))])
        pos = F.col("_at") + F.element_at(at, F.col("_range"))
        page = self.rows.where(F.col("_range").isin([r["_range"] for r in found])).withColumn("_pos", pos)
        page = page.where((F.col("_pos") >= start) & F.coalesce(F.col("_pos") < stop, F.lit(True)))
        return page.orderBy("_pos").drop("_range", "_at", "_pos")


_OWN = ("_range", "_at", "_first", "_rows", "_before")


def _sorted(key: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() for c in key]


def directory(df: DataFrame, key: Sequence[str], value: str | None = None, range_rows: int = RANGE_ROWS,
              path: str | None = None) -> Directory:
    """Write ``df`` in the order of ``key``, one folder for each range, and list the
    ranges."""
    spark = df.sparkSession
    key = list(key)
    n = max(1, -(-df.count() // range_rows))
    by = [*_sorted(key), F.col("_tie")]
    parts = (df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *by)
             .sortWithinPartitions(*by).drop("_tie"))
    numbered = parts.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33).cast("int"))
    path = path or files.scratch_path(spark, f"ranges-{uuid.uuid4().hex}")
    numbered.write.partitionBy("_range").parquet(path)
    schema = numbered.schema
    rows = spark.read.schema(schema).parquet(path).select(*schema.names)
    sums = [F.coalesce(F.sum(f"`{value}`"), F.lit(0)).alias("_sum")] if value else []
    listed = rows.groupBy("_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"), *sums)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    out = {"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0))}
    if value:
        out["_sum_before"] = F.coalesce(F.sum("_sum").over(before), F.lit(0))
    listed = listed.withColumns(out)
    return Directory(rows, listed.drop("_sum"), key)


def prefix_offsets(df: DataFrame, order_cols: str | Sequence[str], value_col: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``_offset``, the sum of ``value_col`` over all rows that come
    earlier by ``order_cols`` (of any sortable types)."""
    key = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    return directory(df, key, value_col, range_rows).running(value_col)
