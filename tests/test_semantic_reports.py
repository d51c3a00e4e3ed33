"""Similarity (M7 dense broadcast vs blocked vs brute force), mapping chain and reports."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelens.operators import report, semantic


def brute(terms, corpus, k):
    out = []
    for t, v in terms:
        sc = []
        for c, w in corpus:
            s = float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)))
            sc.append((-s, c))
        sc.sort()
        out += [(t, i + 1, c, -s) for i, (s, c) in enumerate(sc[:k])]
    return out


@pytest.fixture(scope="module")
def vecs(spark):
    rnd = random.Random(5)
    terms = [(f"t{i}", [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    corpus = [(f"c{j:02d}", [rnd.gauss(0, 1) for _ in range(8)]) for j in range(25)]
    corpus.append(("c99", list(corpus[3][1])))   # exact tie with c03
    t = spark.createDataFrame(terms, "term string, vector array<double>")
    c = spark.createDataFrame(corpus, "concept string, vector array<double>")
    return terms, corpus, t, c


def _rows(df):
    return sorted((r["term"], r["rank"], r["concept"], round(r["score"], 9)) for r in df.collect())


def test_dense_broadcast_and_blocked_agree(vecs):
    terms, corpus, t, c = vecs
    exp = sorted((a, b, cc, round(d, 9)) for a, b, cc, d in brute(terms, corpus, 3))
    assert _rows(semantic.best_concepts_dense(t, c, k=3)) == exp
    blocked = semantic.best_concepts_dense(t, c, k=3, broadcast_rows=5, block_rows=7, dict_block_rows=4)
    assert _rows(blocked) == exp


def test_sparse_bow(spark):
    terms = spark.createDataFrame([("old bolt",), ("red gear",), ("zzz",)], "term string").withColumn("text", F.col("term"))
    d = spark.createDataFrame([("red bolt", "bolt"), ("blue bolt", "bolt"), ("red gear", "gear")],
                              "key string, label string").withColumn("text", F.col("key"))
    got = {r["term"]: (r["semantics"], round(r["score"], 6)) for r in semantic.best_concepts_sparse(terms, d).collect()}
    assert got == {"old bolt": ("bolt", 0.5), "red gear": ("gear", 1.0)}


def test_mapping_chain_and_reports(spark):
    mentions = spark.createDataFrame(
        [(1, "a x", "CA", "2021-01-03"), (2, "a x", "US", "2021-02-01"), (3, "b y", "CA", "2021-02-05"),
         (4, "c z", "", "2021-02-06"), (5, "q q", "US", "2021-02-07"), (6, None, "US", "2021-02-07")],
        "id int, symptom_adjusted string, country string, created_date string")
    best = spark.createDataFrame([("a x", "A", 0.9), ("b y", "B", 0.46), ("c z", "N", 0.8), ("q q", "A", 0.2)],
                                 "term string, semantics string, score double")
    dic = spark.createDataFrame([("a x", "Cat1", "A"), ("a xx", "Cat1", "A"), ("b y", "uncategorized", "B"),
                                 ("c z", "Noise", "N")], "symptoms string, categories string, abr_symptoms string")
    e = semantic.map_mentions(mentions, best, dic)
    rows = {r["id"]: r for r in e.collect()}
    assert rows[1]["symptom"] == "A" and rows[1]["lancet_category"] == "Cat1"
    assert rows[5]["symptom"] is None and rows[6]["symptom"] is None
    s = {r["symptom"]: r for r in report.concept_share(e, dic).collect()}
    assert set(s) == {"A", "B"}            # Noise removed, distinct dimension: no fan-out
    assert s["A"]["frequency"] == 2 and math.isclose(s["A"]["perc"], 100 * 2 / 3)
    cs = {r["lancet_category"]: r for r in report.category_share(report.concept_share(e, dic)).collect()}
    assert set(cs) == {"Cat1"} and math.isclose(cs["Cat1"]["perc"], 100 * 2 / 3)
    c = {r["country"]: r["count"] for r in report.country_share(e, report.concept_share(e, dic)).collect()}
    assert c == {"CA": 2, "US": 1}
    long = {(r["category"], r["country"]): r["perc"] for r in
            report.category_country_long(e, report.concept_share(e, dic)).collect()}
    assert math.isclose(long[("Cat1", "CA")], 50.0) and math.isclose(long[("uncategorized", "CA")], 100.0)
    m = report.category_country_matrix(e, report.concept_share(e, dic), ["CA", "US", "MX"])
    assert m.columns == ["category", "CA", "US", "MX"]
    t = {(r["month"], r["concept"]): r["count"] for r in report.month_trend(e, "created_date").collect()}
    assert t == {("2021-01", "A"): 1, ("2021-02", "A"): 1, ("2021-02", "B"): 1, ("2021-02", "N"): 1}
    top = report.uncategorized_top(report.concept_share(e, dic), 16).collect()
    assert [r["symptom"] for r in top] == ["B"]


def test_dense_byte_bound_switches_to_blocks(vecs):
    terms, corpus, t, c = vecs
    exp = sorted((a, b, cc, round(d, 9)) for a, b, cc, d in brute(terms, corpus, 2))
    # 8 dims x 8 bytes = 64 bytes per row: a 500-byte budget allows 7 rows < 26 -> blocked path
    got = semantic.best_concepts_dense(t, c, k=2, broadcast_bytes=500, block_rows=6)   # dictionary blocks of 7
    assert _rows(got) == exp
