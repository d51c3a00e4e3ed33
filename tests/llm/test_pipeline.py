import random

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
BENCH = "item_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(11)
    bench = [(i, words(rng, 30)) for i in range(5)]
    docs, groups = {}, []
    for i in range(60):
        docs[i] = words(rng, 60) + "\n" + words(rng, 50)
    docs[60] = "too short"
    docs[61] = "same words again and again here now " * 20
    docs[62] = words(rng, 30) + "\n" + bench[2][1]
    docs[63] = None
    for g in range(3):                                        # near copies: a word changed
        base = docs[g].split(" ")
        for j in range(4):
            w = list(base)
            w[10 + j] = "changed"
            docs[100 + 10 * g + j] = " ".join(w)
        groups.append({g, *(100 + 10 * g + j for j in range(4))})
    docs[200] = docs[5]                                       # an exact copy
    for i in range(20, 50):
        docs[i] += f"\nShown {i} times"                       # a template
    rows = [(d, t, "en", f"s{d % 4}", len(t or ""), "mine") for d, t in docs.items()]
    return rows, bench, groups


def test_stages_and_run(spark, tables, planted):
    rows, bench, groups = planted
    folder = tables(documents=spark.createDataFrame(rows, SCHEMA), benchmark=spark.createDataFrame(bench, BENCH))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, folder)
        if i < len(P.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        seen.append(docs)
    ids = [{r.doc_id for r in x.collect()} for x in seen]
    assert ids[0].isdisjoint({60, 61, 63}) and {62, 200} <= ids[0]
    kept = {r.doc_id: r for r in seen[1].collect()}
    assert kept[20].text.endswith("Shown 20 times") and not kept[30].text.endswith("times")
    assert all(r.n_chars == len(r.text) for r in kept.values())
    assert ids[2] == ids[1] - {200} - {d for g in groups for d in g if d > 50}
    assert ids[3] == ids[2] - {62}
    assert ids[4] == ids[3]
    run = {tuple(r) for r in P.run(spark, folder).select("doc_id", "piece", "n_tokens").collect()}
    assert run == {tuple(r) for r in seen[4].select("doc_id", "piece", "n_tokens").collect()}


def test_empty_table(spark, tables):
    folder = tables(documents=spark.createDataFrame([], SCHEMA), benchmark=spark.createDataFrame([], BENCH))
    assert P.run(spark, folder).count() == 0
