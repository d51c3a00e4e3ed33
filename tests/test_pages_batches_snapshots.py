import pandas as pd
import pytest
from pyspark.sql import functions as F

from carelens.operators.infer import CharCountPredictor, refilled, score_fixed_batches
from carelens.operators.numbering import numbered
from carelens.sources.paging import all_pages, page_keyset
from carelens.sources.sinks import RowSnapshots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_follow_the_order_over_partitions(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 37 % 101).alias("k")).repartition(7)
    out = numbered(df, [F.col("k"), F.col("id").desc()])
    want = sorted(((i * 37 % 101, -i) for i in range(5000)))
    assert [(r.k, -r.id, r.n) for r in out.orderBy("n").collect()] == [(k, i, n) for n, (k, i) in enumerate(want)]
    assert "Window" not in plan(out) and "SinglePartition" not in plan(out)
    assert numbered(df.limit(0), [F.col("k")]).count() == 0


def test_all_pages_are_those_of_the_walk(spark):
    rows = [(f"s{i}", i // 7 if i % 50 else None) for i in range(230)]
    df = spark.createDataFrame(rows, "id string, created_utc long")
    pages = all_pages(df, 40)
    got = {}
    for r in pages.orderBy("page", "place").collect():
        got.setdefault(r.page, []).append(r.id)
    dated = df.filter("created_utc IS NOT NULL")
    at, seen = (None, None), []
    while True:
        page = page_keyset(dated, *at, page_size=40).collect()
        if not page:
            break
        seen += [r.id for r in page]
        at = (page[-1].created_utc, page[-1].id)
    flat = [i for p in sorted(got) for i in got[p]]
    assert flat[:len(seen)] == seen and set(flat[len(seen):]) == {i for i, c in rows if c is None}
    assert [len(got[p]) for p in sorted(got)] == [40] * 5 + [30]
    with pytest.raises(ValueError):
        all_pages(df, 0)


def test_batches_are_refilled_to_one_size():
    parts = [pd.DataFrame({"x": range(a, b)}) for a, b in ((0, 3), (3, 3), (3, 10), (10, 11), (11, 30))]
    out = list(refilled(iter(parts), 8))
    assert [len(b) for b in out] == [8, 8, 8, 6] and pd.concat(out)["x"].tolist() == list(range(30))


class Sizes:
    """Answers each row with the size of its batch; misbehaves as told."""

    def __init__(self, fault=""):
        self.fault, self.calls = fault, 0

    def __call__(self, batch):
        self.calls += 1
        out = pd.DataFrame({"id": batch["id"], "prediction": len(batch)})
        if self.fault == "once" and self.calls % 2:
            raise RuntimeError("try again")
        if self.fault == "always":
            raise RuntimeError("no model")
        return {"few": out[:-1], "order": out[::-1]}.get(self.fault, out)


def test_predictor_batches_of_a_stated_size(spark):
    users = spark.range(0, 1000, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("ab").alias("name"))
    schema = "id string, prediction long"
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = score_fixed_batches(users, Sizes, schema, "id").groupBy("prediction").count().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {r.prediction: r["count"] for r in got} == {256: 768, 232: 232}
    assert score_fixed_batches(users, lambda: Sizes("once"), schema, "id").count() == 1000
    for fault, message in (("few", "256 rows given, 255 predicted"), ("order", "not in the order"), ("always", "no model")):
        with pytest.raises(Exception, match=message):
            score_fixed_batches(users, lambda: Sizes(fault), schema, "id").collect()
    with pytest.raises(Exception, match="try again"):
        score_fixed_batches(users, lambda: Sizes("once"), schema, "id", retries=0).collect()
    out = score_fixed_batches(users, lambda: CharCountPredictor("name", "prediction"), schema, "id")
    assert out.filter("prediction = 2").count() == 1000
    assert score_fixed_batches(users.limit(0), Sizes, schema, "id").count() == 0


def test_a_job_killed_between_snapshots_goes_on(spark, tmp_path):
    df = spark.range(95).select(F.col("id"), (F.col("id") * 7 % 95).alias("k"))
    worked = []

    def job(after=None):
        snapshots = RowSnapshots(spark, f"{tmp_path}/job", rows=20)

        def process(part):
            return part.select("id", (F.col("k") * 2).alias("double"))
        return snapshots, lambda: snapshots.run(df, [F.col("k")], process, after)

    def die(i):
        worked.append(i)
        if i == 2:
            raise KeyboardInterrupt
    snapshots, run = job(die)
    with pytest.raises(KeyboardInterrupt):
        run()
    assert snapshots.done() == [0, 1, 2]
    # a chunk that was begun and not committed is made again
    spark.range(3).selectExpr("id", "id AS double").write.parquet(f"{tmp_path}/job/chunks/chunk=3")
    import os
    os.remove(f"{tmp_path}/job/chunks/chunk=3/_SUCCESS")
    snapshots, run = job(worked.append)
    out = run()
    assert worked == [0, 1, 2, 3, 4]
    assert sorted(map(tuple, out.collect())) == [(i, i * 7 % 95 * 2) for i in range(95)]
    first = spark.read.parquet(f"{tmp_path}/job/chunks/chunk=0")
    assert sorted(r.double for r in first.collect()) == [2 * k for k in range(20)]
    assert sorted(map(tuple, job()[1]().collect())) == sorted(map(tuple, out.collect()))
    empty = RowSnapshots(spark, f"{tmp_path}/none", rows=5).run(df.limit(0), [F.col("k")], lambda p: p.select("id"))
    assert empty.count() == 0 and empty.columns == ["id"]


def test_many_snapshots_are_few_jobs(spark, tmp_path):
    df = spark.range(1500).select(F.col("id"), (F.col("id") * 7 % 1500).alias("k"))
    tracker = spark.sparkContext.statusTracker()
    jobs = {}
    for name, process in (("columns", [F.col("id"), (F.col("k") * 2).alias("double")]),
                          ("callable", lambda p: p.select("id", (F.col("k") * 2).alias("double")))):
        spark.sparkContext.setJobGroup(f"snapshots-{name}", "")
        snapshots = RowSnapshots(spark, f"{tmp_path}/{name}", rows=10, at_once=75)
        out = sorted(map(tuple, snapshots.run(df, [F.col("k")], process).collect()))
        jobs[name] = len(tracker.getJobIdsForGroup(f"snapshots-{name}"))
        assert out == [(i, i * 7 % 1500 * 2) for i in range(1500)]
        assert snapshots.done() == list(range(150))
        part = spark.read.parquet(f"{tmp_path}/{name}/chunks/chunk=7")
        assert sorted(r.double for r in part.collect()) == [2 * k for k in range(70, 80)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["columns"] < 40 and jobs["callable"] < 40


def test_snapshots_without_rows(spark, tmp_path):
    df = spark.range(30).select("id", F.lit("x").alias("x"))
    snapshots = RowSnapshots(spark, f"{tmp_path}/job", rows=10, at_once=2)
    out = snapshots.run(df, [F.col("id")], lambda p: p.filter("id >= 20"))
    assert sorted(map(tuple, out.collect())) == [(i, "x") for i in range(20, 30)] and snapshots.done() == [0, 1, 2]
