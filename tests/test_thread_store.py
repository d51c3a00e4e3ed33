from pyspark.sql import functions as F

from carelens.operators import quality, threads
from carelens.operators.thread_store import ThreadStore

SUBS = "id string, title string"
COMMS = "id string, link_id string, body string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    subs = [(f"s{i}", f"title {i}") for i in range(40)] + [("s3", "again"), (None, "no id")]
    comms = [(f"c{i}", f"t3_s{i % 9}", "x") for i in range(80)] + [(f"h{i}", "t3_s5", "hot") for i in range(300)]
    comms += [("c0", "t3_s0", "twice"), ("lost", "t3_nowhere", "y"), ("none", None, "z")]
    return spark.createDataFrame(subs, SUBS), spark.createDataFrame(comms, COMMS)


def test_equal_to_the_shuffled_merge_with_a_hot_submission(spark):
    subs, comms = tables(spark)
    want = threads.merge_threads(subs, comms)
    for hot in (1_000_000, 50):
        store = ThreadStore(spark, buckets=4, hot_comments=hot).write(subs, comms)
        merged = store.merged()
        assert rows(merged.select(*want.columns)) == rows(want)
        assert rows(store.counts()) == rows(quality.thread_counts(want, subs, comms).select(
            "merged_rows", "submissions", "comments", "subs_with_comments"))
        assert rows(store.duplicate_comments()) == [("s0", "c0", 2)]
        assert rows(store.submissions().select("sub_id", "sub_title")) == rows(subs)
        assert store.comments().count() == comms.count()
        for df in (merged, store.duplicate_comments()):
            assert "Exchange" not in plan(df)             # matching buckets are read as they are
    salts = spark.table(store._comms).filter("comm_sub_id = 's5'").groupBy("salt").agg(F.count("*").alias("n")).collect()
    assert len(salts) == 7 and max(r.n for r in salts) < 100


def test_empty_tables(spark):
    subs, comms = tables(spark)
    store = ThreadStore(spark, buckets=2).write(subs.limit(0), comms)
    assert store.merged().count() == 0 and rows(store.counts()) == [(0, 0, comms.count(), 0)]
    store = ThreadStore(spark, buckets=2).write(subs, comms.limit(0))
    assert store.merged().count() == subs.count() and store.duplicate_comments().count() == 0
