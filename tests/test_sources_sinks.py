"""Readers, sinks and paging (S1-S14) on small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from carelens import schemas
from carelens.operators import privacy, select
from carelens.session import scratch_path
from carelens.sources import paging, readers, sinks


def test_json_sink_refuses_existing_and_reads_array_files(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", "hello")], "id string, author_id string, text string")
    path = scratch_path(spark, "posts")
    sinks.write_posts_json(df, path)
    with pytest.raises(Exception):
        sinks.write_posts_json(df, path)
    sinks.write_posts_json(df, path, exists_ok=True)
    # a JSON array file (the original output format) with a nested user
    arr = tmp_path / "posts.json"
    arr.write_text('[{"id": "7", "text": "hi", "created_at": "2021-01-01T00:00:00Z", '
                   '"user": {"id": "u", "location": "Here"}}, {"id": "8", "text": "yo", "user": {"id": "v"}}]')
    p = readers.read_posts(spark, str(arr), schemas.POST, multiline=True)
    tri = {r["text"]: r["location"] for r in readers.post_triples(p).collect()}
    assert tri == {"hi": "Here", "yo": ""}


def test_lexicon_reader_strips_bom(spark, tmp_path):
    f = tmp_path / "lex.tsv"
    f.write_text("Symptom\tCUI\tLexicalExpression\n﻿Fatigue\tC1\tTired\nFatigue\tC1\ttired \n", encoding="utf-8")
    from carelens.operators.lexicon import normalize_lexicon
    n = normalize_lexicon(readers.read_lexicon(spark, str(f))).collect()
    assert [(r["concept"], r["expression"]) for r in n] == [("Fatigue", "tired")]


def test_paging(spark):
    rows = [(f"s{i}", "covid", 100 + i // 2, i % 7) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, subreddit string, created_utc long, score long")
    top = [r["id"] for r in paging.page_top(df, "covid", sort_type="score", max_rows=10).collect()]
    assert len(top) == 10
    seen, last = [], (None, None)
    while True:
        page = paging.page_keyset(df, last[0], last[1], page_size=3).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        last = (page[-1]["created_utc"], page[-1]["id"])
    assert sorted(seen) == sorted(r[0] for r in rows)      # nothing lost at page edges
    with pytest.raises(ValueError):
        paging.page_top(df, max_rows=5)


def test_comment_author_and_projection(spark):
    df = spark.createDataFrame([(("bob", "x"), "t")], "author struct<name:string,id:string>, title string")
    assert privacy.comment_author_name(df).first()["author"] == "bob"
    sub = spark.createDataFrame([("1", "t", "b", 5)], "id string, title string, selftext string, score long")
    assert select.project_submissions(sub).columns == ["id", "selftext", "title", "score"]
    with pytest.raises(ValueError):
        select.project_submissions(sub, strict=True)


def test_empty_outputs_read_back(spark):
    from carelens.streaming import stream
    empty = spark.createDataFrame([], "id string, n long")
    assert sinks.stage_output(empty, scratch_path(spark, "empty-stage")).count() == 0
    ev = stream.table_stream(spark, "/root/testdata/sf0.001", "events").filter(F.col("value") < -1e9)
    out = stream.run_to_parquet(ev.select("event_id", "user_id"), "empty-stream")
    assert out.count() == 0 and out.columns == ["event_id", "user_id"]
