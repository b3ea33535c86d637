"""Global row numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored, tidy

#: monotonically_increasing_id() has the partition above these bits and the place in it below.
_PLACE_BITS = 33


@tidy
def numbered_in_order(df: DataFrame, *order: str | Column, column: str = "number", start: int = 0) -> DataFrame:
    """df with consecutive numbers from `start` in the given order, as LONG `column`.

    Rows are dealt out by ranges of the order, sorted within partitions and stored with their place; a partition's first
    number is the sum of the counts before it. No task holds more than one range, and only a count for each partition passes
    the driver. Rows that are equal in the order lie together; which of them comes first is settled when they are stored.
    """
    if column in df.columns:
        df = df.drop(column)
    place = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", place), "numbered", keep=True)
    part = F.shiftright("__at", _PLACE_BITS)
    counts = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first, ahead = [], start
    for p in sorted(counts):
        first.append((p, ahead))
        ahead += counts[p]
    # a row for each partition
    offsets = F.broadcast(df.sparkSession.createDataFrame(first, "__p long, __first long"))
    placed = rows.join(offsets, part == F.col("__p"))
    return placed.select(*[f"`{c}`" for c in df.columns], (F.col("__first") + F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1)).alias(column))
