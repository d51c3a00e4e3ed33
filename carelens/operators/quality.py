"""Data checks: key uniqueness and thread counts (Q1-Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q1/Q2: key values occurring more than once (NULL equals NULL, as in ``groupBy``)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def thread_counts(merged: DataFrame, subs: DataFrame, comments: DataFrame) -> DataFrame:
    """Q3: rows of the merged table, submissions, comments, submissions with a comment.

    Three scalar subqueries over one-row aggregates; no cross join.
    """
    m = merged.agg(
        F.count(F.lit(1)).alias("merged_rows"),
        F.countDistinct(F.when(F.col("comm_id").isNotNull(), F.col("sub_id"))).alias("subs_with_comments"),
    )
    return m.select(
        "merged_rows",
        subs.agg(F.count(F.lit(1))).scalar().alias("submissions"),
        comments.agg(F.count(F.lit(1))).scalar().alias("comments"),
        "subs_with_comments",
    )
