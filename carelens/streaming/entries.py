"""The collector's response as one stream of entries, with late users (ST1).

A response mixes three kinds of entries, one JSON object each: posts (they have an ``id``),
dumps of user records (``users``) that follow the posts they belong to, and paging
information (``newest_id``).  The entries are routed by kind from one stream; posts and
users then meet in a stream-stream left outer join under watermarks, so users may come some
batches after their posts, or before them, and a post whose user does not come within the
wait is emitted without one.

State is bounded by the watermark: a post is held until its user has come or ``wait`` has
passed, a user record for as long as a post may need it.  A post that meets several dumps of
its author is reduced to one row behind the join, so the wait should not hold many dumps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType, TimestampType

from .. import schemas

#: A post's fields beside those that tell the kind; ``at`` is the time of an entry, if it has one.
ENTRY = StructType([f for f in schemas.POST if f.name != "user"]
                   + [StructField("users", ArrayType(schemas.USER)), StructField("newest_id", StringType()),
                      StructField("at", TimestampType())])


def entry_kind(newest: str = "newest_id", users: str = "users", post: str = "id"):
    """``paging``, ``users`` or ``post``, looked for in this order; any other entry raises."""
    return (F.when(F.col(newest).isNotNull(), "paging").when(F.col(users).isNotNull(), "users")
            .when(F.col(post).isNotNull(), "post")
            .otherwise(F.raise_error(F.concat(F.lit("unknown entry in the response: "),
                                              F.coalesce("entry", F.lit("null"))))))


def read_entries(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                 streaming: bool = True) -> DataFrame:
    """Entries from text files of one JSON object a line: the fields of ``ENTRY``, ``kind`` and
    ``entry`` (the line).  An entry without a time takes the time its file was landed.
    Blank lines are skipped; a line that is no JSON object, or none of the three kinds, raises.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.schema("value string").option("recursiveFileLookup", True).format("text").load(path)
    lines = lines.filter(F.trim("value") != "").select(
        F.col("value").alias("entry"), F.col("_metadata.file_modification_time").alias("landed"),
        F.from_json("value", ENTRY).alias("e"))
    out = lines.select("entry", "landed", "e.*")
    return out.withColumns({"kind": entry_kind(), "at": F.coalesce("at", "landed")}).drop("landed")


def _of_kind(kind: str):
    """The entries of a kind, as a filter that the optimizer does not move below the watermark
    (it names the event time), so that entries of every kind advance the watermark."""
    return F.concat("kind", F.date_format("at", "'@'")) == f"{kind}@"


def posts_with_users(entries: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Posts of the entry stream with their user as the struct ``user`` (null if none came).

    A user record belongs to a post of its author if it comes within ``wait`` before or after
    it; of several, one is attached (the first to arrive).  Entries more than ``late`` behind
    the newest entry may be lost; a post is emitted without a user once all entries up to
    ``wait`` after it must have come.  Posts with the same id within the wait are one post.
    """
    timed = entries.withWatermark("at", late)
    fields = [f.name for f in schemas.POST if f.name != "user"]
    posts = timed.filter(_of_kind("post")).select(*fields, "at")
    users = (timed.filter(_of_kind("users")).select(F.col("at").alias("user_at"), F.explode("users").alias("user"))
             .select("user_at", F.col("user.id").alias("user_id"), "user")
             .filter("user_id IS NOT NULL"))
    near = F.expr(f"user_id = author_id AND user_at BETWEEN at - INTERVAL {wait} AND at + INTERVAL {wait}")
    joined = posts.join(users, near, "leftOuter").drop("user_id", "user_at")
    return joined.dropDuplicatesWithinWatermark(["id"])
