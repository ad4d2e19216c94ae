"""Places of rows in an order, without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import checkpointed


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place (1, 2, 3 ...) in ``order``, which must tell all rows apart.

    Rows are dealt by ranges and sorted within them; a row's place is that in its range and the rows of all ranges
    before, one number a range. No value, however frequent, keeps rows in one task, for ``order`` cuts between them.
    """
    place = F.monotonically_increasing_id()
    ordered = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place))
    part = F.shiftright("place", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per range
    before, at = {}, 0
    for r in sorted(sizes, key=lambda r: r.part):
        before[r.part], at = at, at + r.n
    starts = rows.sparkSession.createDataFrame(list(before.items()), "part long, before long")
    return (ordered.withColumn("part", part).join(F.broadcast(starts), "part")
            .withColumn(name, F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "place"))
