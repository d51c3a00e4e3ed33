"""Threads, users, pass chains and streaming against batch results."""

import pytest
from pyspark.sql import functions as F

from carelens.operators import privacy, quality, threads, users
from carelens.plans.chain import PassChain
from carelens.plans import queries as Q
from carelens.streaming import stream
from tests.conftest import SF001


def test_merge_concat_depth(spark):
    subs = spark.createDataFrame([("a", "u1", 0, "1970-01-01", "t a"), ("b", "u2", 0, "1970-01-01", "t b")],
                                 "id string, author string, created_utc long, created_utc_date string, text string")
    com = spark.createDataFrame([("c1", "t3_a", None, "x"), ("c2", "t3_a", "c1", "y"), ("c3", "t3_a", "c2", "z"),
                                 ("c4", "t3_b", None, "w")], "id string, link_id string, parent string, body string")
    com = com.withColumn("author", F.lit("u")).withColumn("created_utc", F.lit(0)).withColumn(
        "created_utc_date", F.lit("1970-01-01"))
    m = threads.merge_threads(subs, com, check_unique=True)
    assert m.count() == 4 and "comm_sub_id" in m.columns
    cat = threads.concat_threads(subs, com)
    assert sorted(r["type"] for r in cat.collect()) == ["comm"] * 4 + ["sub"] * 2
    d = {r["id"]: r["depth"] for r in threads.reply_depth(com).collect()}
    assert d == {"c1": 0, "c2": 1, "c3": 2, "c4": 0}
    qc = quality.thread_counts(m, subs, com).first()
    assert (qc["merged_rows"], qc["submissions"], qc["comments"], qc["subs_with_comments"]) == (4, 2, 4, 2)
    assert quality.duplicate_keys(m, ["sub_id", "comm_id"]).count() == 0


def test_attach_users_last_wins_and_strict(spark):
    posts = spark.createDataFrame([("p1", "1"), ("p2", "9")], "id string, author_id string")
    us = spark.createDataFrame([("1", "old", 1), ("1", "new", 2)], "id string, username string, v int")
    out = {r["id"]: r["user"] for r in users.attach_users(posts, us, user_order="v").collect()}
    assert out["p1"]["username"] == "new" and out["p2"] is None
    with pytest.raises(KeyError):
        users.attach_users(posts, us, user_order="v", strict=True)


def test_remove_fields_and_ids(spark):
    df = spark.createDataFrame([("1", "a", ("n", "i", "u", "img"))],
                               "id string, author_id string, user struct<name:string,id:string,username:string,"
                               "profile_image_url:string>")
    out = privacy.remove_unused_fields(df)
    assert out.columns == ["user"]
    assert [f.name for f in out.schema["user"].dataType.fields] == ["username"]
    assert privacy.only_ids(df).columns == ["tweet_id"]


def test_pass_chain_rejects_non_callables():
    with pytest.raises(TypeError):
        PassChain([1])
    ch = PassChain([lambda d: d]).register(lambda d: d)
    assert len(ch.passes) == 2


def test_stream_equals_batch(spark):
    qs = Q.registry()[0]
    streamed = qs["stream_clean"](spark, SF001)
    batch = qs["pass_chain"](spark, SF001)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    u = qs["stream_unique"](spark, SF001)
    ev = spark.read.parquet(f"{SF001}/events.parquet").select("user_id", "event_type").distinct()
    assert u.count() == ev.count() and u.exceptAll(ev).count() == 0


def test_reply_depth_deep_chain_orphans_and_cycles(spark):
    n = 300                                   # deeper than a recursive CTE's level limit
    rows = [("r0", None)] + [(f"r{i}", f"r{i-1}") for i in range(1, n)]
    rows += [("o1", "missing"), ("o2", "o1"), ("x1", "x2"), ("x2", "x1"), ("t", None), ("t1", "t")]
    df = spark.createDataFrame(rows, "id string, parent string")
    d = {r["id"]: r["depth"] for r in threads.reply_depth(df).collect()}
    assert all(d[f"r{i}"] == i for i in range(n))
    assert d["t"] == 0 and d["t1"] == 1
    assert not {"o1", "o2", "x1", "x2"} & set(d)


def test_stream_resumes_on_stable_paths(spark):
    """A second run on the same checkpoint finds no new input and adds nothing."""
    from carelens.session import scratch_path
    from carelens.streaming import stream
    sink, ck = scratch_path(spark, "resume-out"), scratch_path(spark, "resume-ckpt")
    first = stream.run_to_parquet(stream.unique_events_stream(spark, SF001), "r", sink=sink, checkpoint=ck).count()
    again = stream.run_to_parquet(stream.unique_events_stream(spark, SF001), "r", sink=sink, checkpoint=ck).count()
    assert first == again > 0


def _parts(spark, folder, name, n):
    """A driver table as a folder of ``n`` part files in shuffled order."""
    df = spark.read.parquet(f"{SF001}/{name}.parquet")
    df.repartition(n, F.rand(3)).write.parquet(f"{folder}/{name}.parquet")


def test_streams_of_folders_equal_the_batch(spark, tmp_path):
    for name, n in (("documents", 4), ("events", 5)):
        _parts(spark, tmp_path, name, n)
    for name in ("pages", "customer", "nation"):
        _parts(spark, tmp_path, name, 2)
    sf = str(tmp_path)
    events, docs = spark.read.parquet(f"{SF001}/events.parquet"), spark.read.parquet(f"{SF001}/documents.parquet")

    def rows(df):
        return sorted(map(tuple, df.collect()))
    got = stream.run_to_parquet(stream.unique_events_stream(spark, sf, max_files_per_trigger=1), "u")
    assert rows(got) == rows(events.select("user_id", "event_type").distinct())
    got = stream.run_to_parquet(stream.unique_text_stream(spark, sf, max_files_per_trigger=1), "t")
    assert rows(got) == rows(docs.select(F.sha2("text", 256)).distinct())
    got = stream.run_to_parquet(stream.daily_counts_stream(spark, sf, max_files_per_trigger=1), "d", "update",
                                keys=["day", "event_type"])
    day = F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day")
    assert rows(got) == rows(events.groupBy(day, "event_type").count())
    one = stream.run_to_parquet(stream.clean_post_stream(spark, sf, max_files_per_trigger=1), "c")
    whole = stream.run_to_parquet(stream.clean_post_stream(spark, SF001), "c")
    assert "author" not in one.columns and one.count() == whole.count() > 0
    assert rows(one.select("created_utc", "text")) == rows(whole.select("created_utc", "text"))
