"""Size checks before broadcasting.

``F.broadcast`` bypasses Spark's own size threshold, so a side is only hinted after its
rows and bytes were measured.  Beyond the bounds the plain join stays, and Spark plans a
sort-merge (or, with AQE, a runtime-converted broadcast / skew-split) join instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a dimension side may hold to be broadcast by the library: rows, and bytes of its
# values (a hashed relation takes a few times as much on every executor).
DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of the values): one aggregate with partial results per task."""
    def size(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if kind.startswith(("array", "map", "struct")):
            return F.octet_length(F.coalesce(F.to_json(F.struct(c)), F.lit("")))
        return F.lit(8)
    width = F.lit(0)
    for name, kind in df.dtypes:
        width = width + size(name, kind)
    rows, total = df.agg(F.count(F.lit(1)), F.sum(width)).collect()[0]
    return rows, total or 0


def is_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
             max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    rows, total = measure(df)
    return rows <= max_rows and total <= max_bytes


def sized_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when it is within both bounds, else ``df`` unchanged."""
    return F.broadcast(df) if is_small(df, max_rows) else df
