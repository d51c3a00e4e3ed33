import numpy as np
from pyspark.sql import functions as F

from carelens.operators import ann
from carelens.operators.ann import ConceptIndex, train_centroids
from carelens.operators.semantic import best_concepts_dense
from carelens.session import scratch_path


def vectors(seed, n, dim=16, groups=12):
    """Vectors around some directions; a third of them around one."""
    rng = np.random.default_rng(seed)
    centre = np.random.default_rng(3).normal(size=(groups, dim))
    home = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, groups, n))
    return (centre[home] + 0.35 * rng.normal(size=(n, dim))).tolist()


def frame(spark, name, rows):
    return spark.createDataFrame([(f"{name}{i:05}", v) for i, v in enumerate(rows)], f"{name} string, vector array<double>")


def rows(df):
    return sorted((r.term, r.rank, r.concept, round(r.score, 9)) for r in df.collect())


def test_all_probes_are_the_exact_search(spark):
    d, t = frame(spark, "concept", vectors(1, 300)), frame(spark, "term", vectors(2, 60))
    exact = rows(best_concepts_dense(t, d, k=3))
    for lists, part_rows in ((9, 20_000), (9, 17), (1, 50)):
        index = ConceptIndex(d, lists=lists, part_rows=part_rows)
        assert rows(index.search(t, k=3, probes=lists)) == exact
        assert index.recall(t, k=3, probes=lists).collect()[0]["recall"] == 1.0
    assert index.listed.count() == 300


def test_recall_with_few_probes(spark):
    d, t = frame(spark, "concept", vectors(4, 3000)), frame(spark, "term", vectors(5, 400))
    index = ConceptIndex(d, sample_rows=1000, part_rows=200)
    measured = index.recall(t, probes=8).collect()[0]
    assert len(index.centroids) == 55 and measured["terms"] == 400
    assert measured["recall"] >= 0.95
    assert index.recall(t, probes=1).collect()[0]["recall"] < measured["recall"]
    assert index.recall(t, probes=index.probes_for(t, 0.97, sample_rows=200), salt=1).collect()[0]["recall"] >= 0.95
    assert index.probes_for(t, 1.1) == 55                        # more than the search can find: all lists
    exact = {r.term: r.concept for r in best_concepts_dense(t, d).collect()}
    found = {r.term: r.concept for r in index.search(t, probes=8).collect()}
    assert np.mean([found[x] == exact[x] for x in exact]) >= 0.95


def test_a_part_of_a_hot_list_is_bounded(spark):
    d, t = frame(spark, "concept", [[1.0, 0.0]] * 500 + [[0.0, 1.0]] * 3), frame(spark, "term", [[1.0, 0.1]] * 90)
    index = ConceptIndex(d, lists=2, part_rows=50)
    got = index.search(t, k=2, probes=1).collect()
    assert len(got) == 180 and {r.concept for r in got} == {"concept00000", "concept00001"}


def test_odd_vectors_and_empty_tables(spark):
    d = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [2.0, 0.0]), ("c", None)], "concept string, vector array<double>")
    t = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None), ("z", [0.0, 0.0])], "term string, vector array<double>")
    got = rows(ConceptIndex(d, lists=5).search(t, probes=5))
    assert got == [("x", 1, "b", 1.0), ("z", 1, "a", 0.0)]
    assert ConceptIndex(d.limit(0)).search(t).count() == 0
    assert ConceptIndex(d).search(t.limit(0)).count() == 0
    assert len(train_centroids(np.array([[1.0, 0.0]] * 4), 3)) == 1
    assert ConceptIndex(d).recall(t.filter(F.lit(False))).collect()[0]["terms"] == 0


def test_the_driver_receives_the_samples_only(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    received, collect = [], DataFrame.collect

    def counted(df):
        out = collect(df)
        received.append((len(out), "TakeOrdered" in df._jdf.queryExecution().executedPlan().toString()))
        return out
    monkeypatch.setattr(DataFrame, "collect", counted)
    d = frame(spark, "concept", vectors(8, 1500)).repartition(6)
    index = ConceptIndex(d, lists=20, sample_rows=100)
    probes = index.probes_for(d.withColumnRenamed("concept", "term"), k=2, sample_rows=50)
    assert 4 <= probes <= 20
    assert received and max(n for n, _ in received) <= 100 and not any(ordered for _, ordered in received)


def sent(node):
    """Rows that the exchanges of an executed plan wrote."""
    inner = [node.executedPlan()] if "AdaptiveSparkPlan" in node.nodeName() else [node.plan()] if "QueryStage" in node.nodeName() else []
    own = node.metrics().get("shuffleRecordsWritten")
    below = inner or [node.children().apply(i) for i in range(node.children().size())]
    return (own.get().value() if own.isDefined() and "Exchange" in node.nodeName() and not inner else 0) + sum(map(sent, below))


def test_a_term_is_sent_to_parts_not_to_lists(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(ann, "scratch_path", lambda spark, name: paths.append(scratch_path(spark, name)) or paths[-1])
    monkeypatch.setattr(ann, "FEW_TERMS", 0, raising=False)
    d, t = frame(spark, "concept", vectors(6, 600)), frame(spark, "term", vectors(7, 400))
    index = ConceptIndex(d, lists=40, part_rows=200)
    for probes in (8, 32):
        found = index.search(t, k=2, probes=probes)
        assert len(found.collect()) == 800
        assert max(spark.read.parquet(p).count() for p in paths) <= 600        # no table holds a vector for each list
        # a term for each of 3 parts, an entry for the one part of the terms, two found for each term and part
        assert sent(found._jdf.queryExecution().executedPlan()) <= 400 * 3 + 600 + 400 * 3 * 2


def test_many_and_few_terms_are_searched_alike(spark, monkeypatch):
    d, t = frame(spark, "concept", vectors(1, 300) + [[0.5] * 16] * 40), frame(spark, "term", vectors(2, 60) + [[1.0] * 16])
    d = d.union(d.limit(5)).withColumn("concept", F.expr("if(concept LIKE 'concept00_57', null, concept)"))
    nan = spark.createDataFrame([("nan", [float("nan")] + [1.0] * 15)], "term string, vector array<double>")
    exact = rows(best_concepts_dense(t, frame(spark, "concept", vectors(1, 300)), k=3))
    key = lambda df: sorted((r.term, r.rank, str(r.concept), r.score and round(r.score, 9)) for r in df.collect())
    for lists, part_rows, least in ((9, None, 4096), (9, 17, 1), (1, 50, 1), (40, 30, 10)):
        monkeypatch.setattr(ann, "LEAST_ROWS", least)
        index, plain = ConceptIndex(d, lists=lists, part_rows=part_rows), ConceptIndex(
            frame(spark, "concept", vectors(1, 300)), lists=lists, part_rows=part_rows)
        found = {}
        for few in (0, 2000):
            monkeypatch.setattr(ann, "FEW_TERMS", few)
            found[few] = [key(index.search(t, k=3, probes=p)) for p in (1, 4, lists)]
            assert rows(plain.search(t, k=3, probes=lists)) == exact
            assert [r.score for r in index.search(nan, k=2, probes=lists).collect()] == [None, None]
        assert found[0] == found[2000]
        assert len(found[0][2]) == 3 * 61 and sum(map(len, index.held)) >= len(index.lists_from)


def test_nan_is_last_and_ties_are_by_concept(spark, monkeypatch):
    d = spark.createDataFrame([("a", [float("nan"), 1.0]), ("c", [2.0, 0.0]), ("b", [1.0, 0.0]), ("d", [0.0, 1.0])],
                              "concept string, vector array<double>")
    t = spark.createDataFrame([("x", [1.0, 0.0])], "term string, vector array<double>")
    for few in (0, 2000):
        monkeypatch.setattr(ann, "FEW_TERMS", few)
        index = ConceptIndex(d, lists=1)
        assert [(r.rank, r.concept) for r in index.search(t, k=2).orderBy("rank").collect()] == [(1, "b"), (2, "c")]
        assert [r.concept for r in index.search(t, k=4).orderBy("rank").collect()] == ["b", "c", "d", "a"]


def test_vectors_keep_their_type(spark, monkeypatch):
    monkeypatch.setattr(ann, "FEW_TERMS", 0)
    d = frame(spark, "concept", vectors(1, 50)).withColumn("vector", F.col("vector").cast("array<float>"))
    index = ConceptIndex(d, lists=4)
    assert index.listed.schema["v"].dataType.elementType.typeName() == "float"
    t = d.withColumnRenamed("concept", "term")
    exact = rows(best_concepts_dense(t.withColumn("vector", F.col("vector").cast("array<double>")),
                                     d.withColumn("vector", F.col("vector").cast("array<double>")), k=2))
    assert rows(index.search(t, k=2, probes=4)) == exact
