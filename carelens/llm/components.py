"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of ``links`` (columns a, b) the least node it reaches.

    Alternates large-star and small-star rounds (Kiveris et al., 2014) until the links are
    stars around their least nodes; the number of rounds grows with the logarithm of the
    links.  A node's links are never gathered: its least neighbour is an aggregate, joined
    back.  Each round is written to the shared folder, so none is computed twice.
    """
    links = _stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .distinct())
        large = _stored(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = (small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        small = _stored(small, "small-star")
        if not _differs(small, links):
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        links = small


def _differs(x: DataFrame, y: DataFrame) -> bool:
    def sign(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    return tuple(sign(x)) != tuple(sign(y))
