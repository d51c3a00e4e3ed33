"""Threads stored side by side: submissions and comments bucketed alike.

Both tables are written once, bucketed by (submission id, salt), so that the merge, the key
checks and the counts read matching buckets and shuffle nothing.  A submission with more than
``hot_comments`` comments is spread: its comments take salts by hash and its row is stored
once for each salt; all others have salt 0.  A submission's number of comments is stored
with it, so one without comments is known without a join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import link_parent_id
from ..session import scratch_path


class ThreadStore:
    """Submissions (``sub_*``) and comments (``comm_*``), bucketed by submission and salt.

    ``path`` is where the tables lie; they are registered in the session's catalog under names
    of their own.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64, hot_comments: int = 1_000_000):
        self.spark, self.path = spark, (path or scratch_path(spark, "threads")).rstrip("/")
        self.buckets, self.hot = buckets, hot_comments
        name = f"threads_{uuid.uuid4().hex[:12]}"
        self._subs, self._comms = f"{name}_submissions", f"{name}_comments"

    def write(self, subs: DataFrame, comments: DataFrame) -> "ThreadStore":
        """Store both tables: submissions by ``id``, comments by the id in their ``link_id``.

        A comment without a link id belongs to no submission and is stored under none; a
        submission without an id has no comments.  Repeated rows are stored as they come.
        """
        c = comments.select(*[F.col(x).alias("comm_" + x) for x in comments.columns])
        c = c.withColumn("comm_sub_id", link_parent_id("comm_link_id"))
        counts = (c.filter("comm_sub_id IS NOT NULL").groupBy(F.col("comm_sub_id").alias("__of"))
                  .agg(F.count(F.lit(1)).alias("__n")))
        path = scratch_path(self.spark, "thread-sizes")
        counts.write.parquet(path)
        counts = self.spark.read.parquet(path)
        salts = F.greatest(F.ceil(F.col("__n") / self.hot), F.lit(1)).cast("int")
        s = subs.select(*[F.col(x).alias("sub_" + x) for x in subs.columns])
        s = s.join(counts, F.col("sub_id") == F.col("__of"), "left")
        s = s.withColumns({"sub_n_comments": F.coalesce("__n", F.lit(0)),
                           "salt": F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1))}).drop("__of", "__n")
        # only the hot submissions' sizes are needed on the comment side
        hot = counts.filter(F.col("__n") > self.hot).withColumn("__salts", salts).drop("__n")
        c = c.join(hot, F.col("comm_sub_id") == F.col("__of"), "left")
        c = c.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("comm_id"), F.col("__salts")).cast("int"), F.lit(0)))
        for df, name, key in ((s, self._subs, "sub_id"), (c.drop("__of", "__salts"), self._comms, "comm_sub_id")):
            (df.repartition(self.buckets, key, "salt").write.bucketBy(self.buckets, key, "salt").sortBy(key, "salt")
             .option("path", f"{self.path}/{name}").mode("overwrite").saveAsTable(name))
        return self

    def submissions(self) -> DataFrame:
        """Every submission once, with ``sub_n_comments``."""
        return self.spark.table(self._subs).filter("salt = 0").drop("salt")

    def comments(self) -> DataFrame:
        return self.spark.table(self._comms).drop("salt")

    def merged(self) -> DataFrame:
        """Every submission with each of its comments (nulls where it has none)."""
        s, c = self.spark.table(self._subs), self.spark.table(self._comms)
        with_comments = s.hint("merge").join(
            c.withColumnRenamed("salt", "__salt"), (F.col("sub_id") == F.col("comm_sub_id"))
            & (F.col("salt") == F.col("__salt")))
        alone = s.filter("sub_n_comments = 0").select(
            *s.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in c.schema if f.name != "salt"])
        return with_comments.drop("__salt").unionByName(alone).drop("salt", "sub_n_comments")

    def duplicate_comments(self) -> DataFrame:
        """Q2: (sub_id, comm_id, n) of comments that stand more than once under a submission."""
        c = self.spark.table(self._comms).filter("comm_sub_id IS NOT NULL")
        return (c.groupBy("comm_sub_id", "salt", "comm_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                .select(F.col("comm_sub_id").alias("sub_id"), "comm_id", "n"))

    def counts(self) -> DataFrame:
        """Q3: rows of the merge, submissions, comments, submissions with a comment; from the
        stored sizes, without a merge."""
        one = self.submissions().agg(
            F.coalesce(F.sum(F.greatest("sub_n_comments", F.lit(1))), F.lit(0)).alias("merged_rows"),
            F.count(F.lit(1)).alias("submissions"),
            F.count_distinct(F.when(F.col("sub_n_comments") > 0, F.col("sub_id"))).alias("subs_with_comments"))
        return one.select("merged_rows", "submissions", self.comments().agg(F.count(F.lit(1))).scalar().alias("comments"),
                          "subs_with_comments")
