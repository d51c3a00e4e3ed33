"""Plan properties that must hold for every registered query (checked on sf0.001):
no cross joins, no row-at-a-time Python UDFs, and the intended shapes for the heavy
operators."""

import pytest

from carelens.plans.queries import registry
from tests.conftest import SF001


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan_of(fn(spark, SF001)) for k, fn in registry()[0].items()}


def test_no_cross_joins_or_row_udfs(plans):
    for k, p in plans.items():
        assert "CartesianProduct" not in p, k
        assert "BroadcastNestedLoopJoin" not in p, k
        assert "BatchEvalPython" not in p, k


def test_lexicon_probe_is_a_broadcast_join(plans):
    p = plans["lexicon_hits"]
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p


def test_top_k_is_take_ordered(plans):
    assert "TakeOrderedAndProject" in plans["page_top"]
    assert "TakeOrderedAndProject" in plans["top_terms"]


def test_filters_reach_the_scan(spark):
    df = registry()[0]["page_top"](spark, SF001)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(turn), IsNotNull(role), EqualTo(turn,0), EqualTo(role,user)]" in p


def test_python_only_where_intended(plans):
    python = {k for k, p in plans.items()
              if "MapInPandas" in p or "FlatMapGroupsInPandas" in p or "FlatMapCoGroupsInPandas" in p
              or "ArrowEvalPython" in p}
    allowed = {"model_score", "model_batches", "user_demographics", "semantic_best", "semantic_top3", "semantic_blocked",
               "semantic_ivf", "semantic_ivf_recall", "lexicon_matches", "lexicon_concepts", "flagship_concepts"}
    assert python <= allowed, python - allowed


def test_keyword_spans_match_a_text_in_two_passes(spark, tmp_path):
    from carelens.plans.queries_match import keyword_spans
    spark.createDataFrame([(1, "took the pills of the day, and src11", "en", "src1"), (2, None, "en", "src1"), (3, "no", "de", "src7")],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = keyword_spans(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [
        ("1", "and", 33, 36), ("1", "of the", 21, 27), ("1", "src1", 1, 5), ("1", "the", 11, 14)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?<!") == 2


def test_flagship_cleans_a_text_once(spark, monkeypatch):
    from carelens.plans import flagship as module
    from carelens.sources.sinks import stage_output
    staged, used = [], []
    monkeypatch.setattr(module, "stage_output", lambda df, path: staged.append(df) or stage_output(df, path))
    monkeypatch.setattr(module, "lexicon_matches", lambda docs, *a, **k: used.append(docs) or docs.selectExpr(
        "id", "'c' concept", "'k' code"))
    module.flagship(spark, SF001)
    assert len(staged) == 1 and "https?" in plan_of(staged[0])
    assert "https?" not in plan_of(used[0])              # what reads the copy cleans nothing


def test_white_space_is_cut_as_the_pattern_does(spark):
    from pyspark.sql import functions as F
    from carelens.functions.patterns import SPACE, SPACES
    from carelens.functions.text import remove_special_characters, strip_ws
    assert sorted(SPACES) == [c for c in map(chr, range(0x110000)) if c.isspace()]
    texts = [c + " a" + c + "b\n" + c for c in SPACES] + ["", " \r\n", "\u200b x \u200b", "a&amp;amp; @b\n\nc "]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select(
        "t", strip_ws("t").alias("s"), F.regexp_replace("t", f"^{SPACE}+|{SPACE}+$", "").alias("p"),
        remove_special_characters("t").alias("x")).collect()
    for r in rows:
        assert r["s"] == r["p"] and r["s"] == (r["t"] and r["t"].strip())
    assert {r["t"]: r["x"] for r in rows}["a&amp;amp; @b\n\nc "] == "a&amp;   c"


def test_mentions_split_a_text_once(spark):
    from carelens.functions.privacy import hash_mentions
    plan = plan_of(spark.createDataFrame([("a @b c",)], "t string").select(hash_mentions("t").alias("h")))
    assert plan.count("split(") == 1
