"""The flagship query: the minimum end-to-end slice of the build plan.

posts -> banned-term filter (F4) -> mention hashing (P2) -> cleaning (T1, T2) ->
first-occurrence de-duplication (F8) -> lexicon extraction with overlap removal (M2) ->
mentions and texts per concept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import clean_post_text
from ..operators.banned import drop_banned
from ..operators.lexicon import concept_counts, lexicon_matches
from ..operators.privacy import hash_ids
from ..operators.select import unique_first
from ..session import scratch_path
from ..sources import views
from ..sources.sinks import stage_output


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    posts = views.posts(spark, sf).select("id", "created_utc", "text")
    kept = hash_ids(drop_banned(posts, "text"))
    cleaned = kept.withColumn("text", clean_post_text("text"))
    # the hashes and the kept rows are both read from this one copy: a text is cleaned once
    cleaned = stage_output(cleaned, scratch_path(spark, "clean-posts"))
    unique = unique_first(cleaned, "text", "created_utc")
    matches = lexicon_matches(unique, views.passage_lexicon(spark, sf), id_col="id")
    return concept_counts(matches, "id")
