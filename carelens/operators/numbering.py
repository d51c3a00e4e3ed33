"""Row numbers over a global order without a one-task window.

The rows are sorted over range partitions and written with their place in their partition;
the partitions' row counts, one number each, give every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

_PLACES = 33                  # bits of the place within a partition


def numbered(df: DataFrame, order: list[Column], name: str = "n", path: str | None = None) -> DataFrame:
    """``df`` with ``name``: 0 for the first row by ``order``, and so on; one global sort.

    Rows equal in ``order`` are numbered in any order.  The numbered rows are written to
    ``path`` (a fresh scratch folder by default), sorted, so a filter on the number reads few
    row groups.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "numbered")
    df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    part = F.shiftright("__place", _PLACES).cast("int")
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    offsets, total = [], 0                                # a row for each partition
    for r in counts:
        offsets.append((r["part"], total))
        total += r["n"]
    offset = F.broadcast(spark.createDataFrame(offsets, "__part int, __offset long"))
    local = F.col("__place").bitwiseAND(F.lit((1 << _PLACES) - 1))
    return (rows.withColumn("__part", part).join(offset, "__part")
            .withColumn(name, F.col("__offset") + local).drop("__part", "__offset", "__place"))
