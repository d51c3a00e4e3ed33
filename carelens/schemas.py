"""Explicit schemas of the record shapes (no inference on large inputs)."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType,
                               StructField, StructType)

USER = StructType([
    StructField("id", StringType()), StructField("name", StringType()),
    StructField("username", StringType()), StructField("description", StringType()),
    StructField("location", StringType()), StructField("profile_image_url", StringType()),
    StructField("protected", BooleanType()), StructField("verified", BooleanType()),
])

MENTION = StructType([StructField("start", LongType()), StructField("end", LongType()),
                      StructField("username", StringType())])

POST = StructType([
    StructField("id", StringType()), StructField("author_id", StringType()),
    StructField("text", StringType()), StructField("created_at", StringType()),
    StructField("lang", StringType()),
    StructField("entities", StructType([StructField("mentions", ArrayType(MENTION)),
                                        StructField("hashtags", ArrayType(StructType([
                                            StructField("tag", StringType())])))])),
    StructField("user", USER),
])

SUBMISSION = StructType([
    StructField("id", StringType()), StructField("author", StringType()),
    StructField("created_utc", LongType()), StructField("selftext", StringType()),
    StructField("title", StringType()), StructField("subreddit", StringType()),
    StructField("score", LongType()), StructField("num_comments", LongType()),
])

COMMENT = StructType([
    StructField("id", StringType()), StructField("link_id", StringType()),
    StructField("body", StringType()), StructField("created_utc", LongType()),
    StructField("depth", LongType()), StructField("comment_type", StringType()),
    StructField("ups", LongType()), StructField("downs", LongType()),
    StructField("likes", BooleanType()), StructField("author", StringType()),
    StructField("permalink", StringType()),
])

LEXICON = StructType([StructField("Symptom", StringType()), StructField("CUI", StringType()),
                      StructField("LexicalExpression", StringType())])

DICTIONARY = StructType([StructField("symptoms", StringType()), StructField("categories", StringType()),
                         StructField("abr_symptoms", StringType())])

ENTITY = StructType([StructField("text", StringType()), StructField("type", StringType())])

SCORES = StructType([StructField("label", StringType()), StructField("score", DoubleType())])
