"""Queries of stores: streams with bounded state, entries with late users, bucketed threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import views
from ..sources.tables import table
from ..streaming import stream
from ..streaming.entries import posts_with_users, read_entries
from ..streaming.seen import unique_to_parquet
from ..operators.thread_store import ThreadStore
from .queries import ORACLE, _clean_comments, _clean_subs, q


def _landed(spark, df, name, files=8, per_trigger=2):
    """The table written again as ``files`` files, read as a stream of some files a batch."""
    path = scratch_path(spark, name)
    df.repartition(files, *df.columns[:1]).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


@q("stream_seen_events", "SELECT DISTINCT user_id, event_type FROM events")
def stream_seen_events(spark, sf):
    """ST3 + ST2 with flat state: every (user, event type) once over four micro-batches."""
    events = table(spark, sf, "events").select("event_type", "user_id")
    out = unique_to_parquet(_landed(spark, events, "events"), ["user_id", "event_type"], "seen-events")
    return out.select("user_id", "event_type")


@q("stream_seen_texts", "SELECT DISTINCT text, sha256(text) AS text_sha, n_chars FROM documents")
def stream_seen_texts(spark, sf):
    """F8 across micro-batches with flat state: one row of every text over four micro-batches."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    out = unique_to_parquet(_landed(spark, docs, "texts"), ["text"], "seen-texts", order=("doc_id",))
    return out.select("text", F.sha2("text", 256).alias("text_sha"), "n_chars")


@q("stream_entries", """
SELECT p.id, p.author_id, p.lang, u.username, u.location
FROM posts p LEFT JOIN users u ON u.id = p.author_id""", ("posts", "users"))
def stream_entries(spark, sf):
    """ST1: one stream of posts, user dumps and paging entries; a dump of the authors follows
    its posts an hour later, in another file."""
    hours = 8
    posts = views.posts(spark, sf).withColumn("hour", F.pmod(F.xxhash64("id"), F.lit(hours)).cast("int"))
    authors = posts.select(F.col("author_id").alias("id"), "hour").distinct()
    users = views.users(spark, sf).join(authors, "id").groupBy(F.col("hour") + 1).agg(
        F.collect_list(F.struct("id", "username", "location")).alias("users"))

    def at(hour):
        return F.timestamp_seconds(F.lit(1_577_836_800) + hour * 3600).alias("at")
    entry = [posts.select("hour", F.to_json(F.struct("id", "author_id", "lang", "text", at(F.col("hour"))))),
             users.toDF("hour", "users").select("hour", F.to_json(F.struct("users", at(F.col("hour"))))),
             spark.range(hours + 1).select(F.col("id").cast("int"), F.to_json(F.struct(
                 F.col("id").cast("string").alias("newest_id"), at(F.col("id")))))]
    path = scratch_path(spark, "entries")
    lines = entry[0].toDF("hour", "value")
    for more in entry[1:]:
        lines = lines.unionByName(more.toDF("hour", "value"))
    lines.repartition("hour").write.partitionBy("hour").text(path)
    for hour in (100, 101):                       # the last pages close the wait of all posts
        spark.range(1).select(F.to_json(F.struct(F.lit("end").alias("newest_id"), at(F.lit(hour)))).alias("value")) \
            .write.text(f"{path}/hour={hour}")
    entries = read_entries(spark, path, max_files_per_trigger=4)
    out = stream.run_to_parquet(posts_with_users(entries, "2 hours", "12 hours"), "entries")
    return out.select("id", "author_id", "lang", F.col("user.username").alias("username"),
                      F.col("user.location").alias("location"))


def _thread_store(spark, sf):
    return ThreadStore(spark, buckets=8, hot_comments=1000).write(_clean_subs(spark, sf), _clean_comments(spark, sf))


@q("thread_store_merge", ORACLE["merge_thread"])
def thread_store_merge(spark, sf):
    """J3 from tables bucketed by submission: the merge reads matching buckets."""
    return _thread_store(spark, sf).merged().select("sub_id", "comm_id", "comm_sub_id")


@q("thread_store_counts", ORACLE["quality_counts"])
def thread_store_counts(spark, sf):
    """Q3 from the stored threads."""
    return _thread_store(spark, sf).counts().select("merged_rows", "submissions", "comments", "subs_with_comments")
