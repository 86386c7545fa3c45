"""Places of rows in an order of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum_spark.operators.scratch import Scratch

_WITHIN = 33


def numbered(rows: DataFrame, order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """rows with their place, from 0, in an order of columns that tells all rows apart. Rows are sorted by range; only the sizes of the ranges are summed in one task."""
    by_range = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.cut(by_range, "placed").withColumns({"_part": F.shiftright("_at", _WITHIN), "_within": F.col("_at").bitwiseAND((1 << _WITHIN) - 1)})
    sizes = placed.groupBy("_part").count()
    starts = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_within")).drop("_at", "_part", "_within", "_start")
