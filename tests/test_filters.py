"""Selection, banned-term filter, regex tagging, de-duplication against Python models."""

import re

import pytest
from pyspark.sql import functions as F

from carelens.functions.constants import BANNED_TERMS
from carelens.operators import banned, select

TEXTS = [
    "I took Tamiflu, daily", "roche", "ask roche", "roche is here", "no brand here",
    "Accu-Chek meter!", "sars-cov-2 rapid antigen test kit", "xroche y", "(Xolair)",
    "a mycophenolate mofetil b", "métformine", "é tamiflu é", None,
]


def py_banned(t):
    if t is None:
        return False
    low = t.lower()
    return any(re.search(r"\W{}\W".format(s), low) for s in set(x.lower() for x in BANNED_TERMS))


def test_banned_filter_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    kept = {r["i"] for r in banned.drop_banned(df).collect()}
    expect = {i for i, t in enumerate(TEXTS) if not py_banned(t)}
    assert kept == expect


def test_regex_tag(spark):
    df = spark.createDataFrame([("I have a cough",), ("nothing",), ("my chest hurts 123",)], "text string")
    pats = [r"I have", r"\d+", r"my (?:chest|head)"]
    got = [r["regex_matched"] for r in select.regex_tag(df, pats).collect()]
    exp = []
    for (t,) in [("I have a cough",), ("nothing",), ("my chest hurts 123",)]:
        m = [p for p in pats if re.search(p, t)]
        exp.append(", ".join(m) if m else "N/A")
    assert got == exp
    with pytest.raises(ValueError):
        select.regex_tag(df, [])


def test_unique_first_keeps_smallest_key(spark):
    rows = [(5, "a", "x5"), (2, "a", "x2"), (9, "b", "x9"), (3, "c", "x3"), (1, "b", "x1")]
    df = spark.createDataFrame(rows, "k int, text string, other string")
    got = sorted(tuple(r) for r in select.unique_first(df, "text", "k").collect())
    seen, exp = set(), []
    for k, t, o in sorted(rows):
        if t not in seen:
            seen.add(t)
            exp.append((k, t, o))
    assert got == sorted(exp)


def test_collect_predicate(spark):
    cfg = select.CollectConfig(hashtags=("longcovid",), include=("long covid",), pre_req=("covid", "virus"),
                               exclude=("roche", "is:retweet"), language=("en",))
    rows = [("covid and #LongCovid", "en", False), ("covid long covid here", "en", True),
            ("virus long covid roche", "en", False), ("long covid", "en", False), ("long haul", "en", False),
            ("covid #longcovidx", "en", False), ("covid long covid", "fr", False)]
    df = spark.createDataFrame(rows, "text string, lang string, is_retweet boolean")
    got = [r[0] for r in df.select(select.collect_predicate(cfg, flags={"is:retweet": "is_retweet"})).collect()]
    assert got == [True, False, False, True, False, False, False]
    with pytest.raises(ValueError):
        select.collect_predicate(select.CollectConfig())


def test_caps_and_removed(spark):
    assert select.validate_cap("all") is None
    assert select.validate_cap(10) == 10
    with pytest.raises(ValueError):
        select.validate_cap(9)
    df = spark.createDataFrame([("[removed]",), ("[deleted]",), (None,), ("ok",)], "b string")
    assert [r[0] for r in select.drop_removed(df, "b").collect()] == ["ok"]


def test_category_filters(spark):
    df = spark.createDataFrame([("Noise",), (None,), ("x",)], "c string")
    assert sorted([r[0] for r in select.exclude_categories(df, "c", ["Noise"]).collect()],
                  key=str) == [None, "x"]


def test_collect_predicate_hashtag_array(spark):
    cfg = select.CollectConfig(hashtags=("LongCovid",), include=("long haul",), language=("en",))
    rows = [("nothing here", "en", ["longcovid"]), ("nothing", "en", ["other"]), ("a long haul", "en", None),
            ("x", "en", None)]
    df = spark.createDataFrame(rows, "text string, lang string, tags array<string>")
    got = [r[0] for r in df.select(select.collect_predicate(cfg, hashtag_col="tags")).collect()]
    assert got == [True, False, True, False]
