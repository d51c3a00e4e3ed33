"""Structured Streaming (ST1-ST3, streaming E1).

Posts arrive as files; each micro-batch is joined with the static user table, passed
through the cleaning chain and appended to a parquet sink.  The checkpoint and the sink
live under the cluster's shared ``spark.checkpoint.dir``, so a lost executor only re-runs
the current micro-batch, and a query restarted on the same paths resumes exactly once
from the last committed batch.  ``max_files_per_trigger``
bounds a micro-batch, which replaces the original's periodic CSV snapshots (ST2).

De-duplication keeps one entry of state per key for ever (``unique_events_stream``,
``unique_text_stream``), so its rows do not depend on how the table is cut into files or
in which order they arrive.  ``recent_events_stream`` is the bounded-state form: it forgets
keys older than the watermark, and only promises uniqueness within that delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.chain import post_chain
from ..operators.users import attach_users, latest_per_key
from ..session import cut_lineage, scratch_path
from ..sources import views
from ..sources.tables import table


def table_stream(spark: SparkSession, sf_dir: str, name: str,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """A driver table, one file or a folder of part files, as a file stream (schema taken
    from the batch table, never inferred)."""
    schema = table(spark, sf_dir, name).schema
    r = spark.readStream.format("parquet").schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # a glob, since a file source takes a plain path for a folder
    return r.load(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def run_to_parquet(df: DataFrame, name: str, output_mode: str = "append",
                   sink: str | None = None, checkpoint: str | None = None,
                   keys: list[str] | None = None) -> DataFrame:
    """Run a streaming DataFrame until all available input is processed; return the sink.

    Append-mode results go to a parquet file sink (exactly once through the checkpoint).
    In update mode every batch writes only its changed groups, to a folder of its own that
    a repeated batch overwrites; the result holds the latest row of each ``keys`` value.
    Pass stable ``sink`` and ``checkpoint`` paths to resume a deployment where it stopped;
    by default each call gets fresh paths under the shared checkpoint folder.
    """
    spark = df.sparkSession
    sink = sink or scratch_path(spark, f"{name}-out")
    ckpt = checkpoint or scratch_path(spark, f"{name}-ckpt")
    w = df.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
    if output_mode == "append":
        qy = w.format("parquet").outputMode("append").start(sink)
    elif output_mode == "update" and keys:
        # an input with no data runs no batch: an empty part of the right schema comes first
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{sink}/batch=-1")

        def write(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")
        qy = w.outputMode("update").foreachBatch(write).start()
    else:
        raise ValueError("append mode, or update mode with keys")
    qy.awaitTermination()
    if qy.exception() is not None:
        raise RuntimeError(str(qy.exception()))
    if output_mode == "append":
        # the stream's own schema: a sink that received no rows has no file to infer it from
        return spark.read.schema(df.schema).parquet(sink)
    parts = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch long")
    others = [c for c in df.columns if c not in keys]
    latest = parts.parquet(sink).groupBy(*keys).agg(F.max(F.struct("batch", *others)).alias("__last"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in df.columns])


def clean_post_stream(spark: SparkSession, sf_dir: str, bits: int = 224,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """ST1: streaming posts x static users -> banned filter -> drop fields -> hash ids.

    The static side of a stream-static join is re-evaluated for every micro-batch, so the
    de-duplicated user table is materialized once (reliable checkpoint in the shared
    folder) before the stream starts."""
    docs = table_stream(spark, sf_dir, "documents", max_files_per_trigger)
    posts = views.posts_from(docs, table(spark, sf_dir, "pages"))
    users = cut_lineage(latest_per_key(views.users(spark, sf_dir), "id", "username"))
    with_users = attach_users(posts, users, users_unique=True)
    return post_chain(bits=bits)(with_users)


def unique_events_stream(spark: SparkSession, sf_dir: str, keys=("user_id", "event_type"),
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """ST3: the keys of the event stream, each once, in whatever order the files arrive.

    State is one entry per distinct key, spread over the executors by key."""
    ev = table_stream(spark, sf_dir, "events", max_files_per_trigger)
    return ev.select(*keys).dropDuplicates(list(keys))


def unique_text_stream(spark: SparkSession, sf_dir: str,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """ST3 on texts (F8 across micro-batches): every text hash once; the state holds hashes,
    not texts."""
    docs = table_stream(spark, sf_dir, "documents", max_files_per_trigger)
    return docs.select(F.sha2("text", 256).alias("text_sha")).dropDuplicates(["text_sha"])


def recent_events_stream(spark: SparkSession, sf_dir: str, keys=("user_id", "event_type"),
                         delay: str = "1 day", max_files_per_trigger: int | None = None) -> DataFrame:
    """ST3 with bounded state, for input that arrives in time order: a key repeated within
    ``delay`` of event time is dropped, later repeats pass, and events later than the
    watermark are lost."""
    ev = table_stream(spark, sf_dir, "events", max_files_per_trigger)
    ev = ev.withColumn("ts", F.col("ts").cast("timestamp"))   # parquet TIMESTAMP_NTZ -> TIMESTAMP
    return ev.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def daily_counts_stream(spark: SparkSession, sf_dir: str,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """E1 streaming form: events per day and type; run in update mode on (day, event_type).

    The day is the date of the stored wall time, so it does not depend on the session time
    zone.  State is one count per day and type; files may arrive in any order."""
    ev = table_stream(spark, sf_dir, "events", max_files_per_trigger)
    day = F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day")
    return ev.groupBy(day, "event_type").agg(F.count(F.lit(1)).alias("count"))
