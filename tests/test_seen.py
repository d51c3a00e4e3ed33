import os

import numpy as np
from pyspark.sql import functions as F

from carelens.session import list_committed
from carelens.streaming import stream
from carelens.streaming.seen import BloomFilter, SeenStore, key_hashes, unique_to_parquet
from tests.conftest import SF001


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def landed(spark, folder, df, n):
    path = f"{folder}/in"
    df.repartition(n, F.rand(7)).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_bloom_filter_forgets_nothing():
    rng = np.random.default_rng(1)
    h = rng.integers(-2**63, 2**63, (4, 5000))
    seen = BloomFilter(50_000 // 8 * 8)
    assert not seen.may_hold(h[0], h[1]).any()
    seen.add(h[0], h[1])
    again = BloomFilter(seen.bits, seen.bytes.tobytes())
    assert again.may_hold(h[0], h[1]).all() and again.may_hold(h[2], h[3]).mean() < 0.03


def test_twenty_shuffled_files_give_the_distinct_rows_without_stream_state(spark, tmp_path):
    events = spark.read.parquet(f"{SF001}/events.parquet").select("user_id", "event_type")
    progress = []
    store = SeenStore(spark, f"{tmp_path}/seen", buckets=8, bucket_keys=50, compact_every=6)
    got = unique_to_parquet(landed(spark, tmp_path, events, 20), ["user_id", "event_type"], "u",
                            sink=f"{tmp_path}/out", store=store, progress=progress)
    assert rows(got) == rows(events.distinct())
    assert store.keys().count() == got.count() == store.keys().distinct().count()
    assert len([p for p in progress if p["numInputRows"]]) == 20
    assert all(not p["stateOperators"] for p in progress)        # nothing is kept in executors
    # filters do not grow with the stream, and old ones go
    assert len(list_committed(spark, f"{tmp_path}/seen/probe", "batch")) == 2
    assert len(list_committed(spark, f"{tmp_path}/seen/keys", "batch")) <= 7


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000))
    source = landed(spark, tmp_path, docs, 5)

    def run():
        return rows(unique_to_parquet(source, ["text"], "t", sink=f"{tmp_path}/out", order=("doc_id",),
                                      checkpoint=f"{tmp_path}/ckpt",
                                      store=SeenStore(spark, f"{tmp_path}/seen", buckets=4)))
    first = run()
    assert sorted(t for _, t in first) == sorted(r.text for r in docs.select("text").distinct().collect())
    assert run() == first                                        # nothing left to do
    last = max(int(f) for f in os.listdir(f"{tmp_path}/ckpt/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):                        # as if the job had died before its commit
        if os.path.exists(f"{tmp_path}/ckpt/commits/{f}"):
            os.remove(f"{tmp_path}/ckpt/commits/{f}")
    assert run() == first
    assert SeenStore(spark, f"{tmp_path}/seen", buckets=4).keys().count() == len(first)


def test_store_admits_each_key_once_and_knows_nulls(spark, tmp_path):
    store = SeenStore(spark, f"{tmp_path}/s", buckets=2, bucket_keys=10)
    h1, h2 = key_hashes(["a", "b"])

    def batch(*keys):
        return spark.createDataFrame(keys, "a string, b string").select(h1.alias("h1"), h2.alias("h2")).distinct()
    assert store.admit(batch(("x", None), (None, "x"), (None, None), ("", None)), 0).count() == 4
    assert store.admit(batch(("x", None), ("y", "z")), 1).count() == 1
    assert store.admit(batch(("x", None), ("y", "z")), 1).count() == 1     # the same batch again
    assert store.admit(batch(("x", None), ("y", "z")), 2).count() == 0
    assert store.admit(batch(("x", None)).limit(0), 3).count() == 0
    many = spark.range(500).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"))
    assert store.admit(many, 4).count() == 500 and store.admit(many, 5).count() == 0   # filters over-full


def test_empty_stream(spark, tmp_path):
    empty = spark.read.parquet(f"{SF001}/events.parquet").limit(0).select("user_id")
    empty.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(empty.schema).parquet(f"{tmp_path}/in")
    assert unique_to_parquet(source, ["user_id"], "e").count() == 0


def test_same_rows_as_the_stateful_stream(spark):
    a = stream.run_to_parquet(stream.unique_events_stream(spark, SF001), "a")
    b = unique_to_parquet(stream.table_stream(spark, SF001, "events").select("user_id", "event_type"),
                          ["user_id", "event_type"], "b")
    assert rows(a) == rows(b)
