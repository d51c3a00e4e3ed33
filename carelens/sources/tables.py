"""Parquet readers for the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Tables whose rows carry long free text: their per-row work (regex, tokenizing) is CPU
# bound, so spreading a small layout over all cores pays for the extra exchange.  For
# row-cheap tables (lineitem, events) it measured slower at sf0.1 and is not applied.
SPREAD_TABLES = ("documents", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over all cores when the file layout gives fewer scan splits.

    A parquet file splits only at row-group boundaries, so a small corpus can arrive in
    fewer partitions than there are cores.  On a large corpus the scan already yields
    thousands of splits and nothing is added (no extra shuffle at scale).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; Catalyst prunes columns and pushes filters into the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in SPREAD_TABLES else df
