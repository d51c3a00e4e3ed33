"""Shaping of extracted entities (M3-M6) and entity frequencies (A1).

Entities arrive as array<struct<text string, type string>> per text (from a model via
``infer.score_batches`` or from ``lexicon.lexicon_matches``).  Everything here is a
higher-order array expression on the row, so no shuffle is involved except A1's count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import NO_MATCH


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def entity_strings(df: DataFrame, entities: str = "entities") -> DataFrame:
    """M3: ``entities`` and ``entity_types`` as ``', '``-joined text, ``'N/A'`` when none."""
    e = _c(entities)
    texts = F.array_join(F.transform(e, lambda x: x["text"]), ", ")
    types = F.array_join(F.transform(e, lambda x: x["type"]), ", ")
    has = F.coalesce(F.size(e), F.lit(0)) > 0
    return (df.withColumn("entity_texts", F.when(has, texts).otherwise(F.lit(NO_MATCH)))
              .withColumn("entity_types", F.when(has, types).otherwise(F.lit(NO_MATCH))))


def texts_of_type(entities: str | Column, etype: str) -> Column:
    return F.transform(F.filter(_c(entities), lambda x: x["type"] == etype), lambda x: x["text"])


def split_symptoms_treatments(df: DataFrame, entities: str = "entities") -> DataFrame:
    """M4: ``symptoms`` (PROBLEM) and ``treatments`` (TREATMENT); NULL when none."""
    def nz(a):
        return F.when(F.size(a) > 0, a)
    return (df.withColumn("symptoms", nz(texts_of_type(entities, "PROBLEM")))
              .withColumn("treatments", nz(texts_of_type(entities, "TREATMENT"))))


def extract_entity_columns(df: DataFrame, entities: str = "entities") -> DataFrame:
    """M5: ``Symptoms``, ``Tests``, ``Treatments`` lists (empty when none); raw list kept."""
    e = F.coalesce(_c(entities), F.array().cast("array<struct<text:string,type:string>>"))
    return (df.withColumn("Symptoms", texts_of_type(e, "PROBLEM"))
              .withColumn("Tests", texts_of_type(e, "TEST"))
              .withColumn("Treatments", texts_of_type(e, "TREATMENT")))


def entity_frequency(entity_rows: DataFrame, text: str = "text", etype: str = "type",
                     types=("PROBLEM", "TREATMENT", "TEST")) -> DataFrame:
    """A1: frequency of each (type, raw text) among the kept types; one long table
    (the original's three sheets are its ``type`` partitions)."""
    return (entity_rows.filter(F.col(etype).isin(*types))
            .groupBy(F.col(etype).alias("type"), F.col(text).alias("text"))
            .agg(F.count(F.lit(1)).alias("frequency")))


def explode_entities(df: DataFrame, key: str, entities: str = "entities") -> DataFrame:
    """array<struct<text,type>> -> one row per entity (key, pos, text, type)."""
    return df.select(key, F.posexplode(entities).alias("pos", "e")).select(
        key, "pos", F.col("e.text").alias("text"), F.col("e.type").alias("type"))


def merge_subwords(tokens: str) -> Column:
    """M6: glue word pieces: a token starting with ``##`` joins the previous word with every
    ``##`` removed; a leading ``##`` token starts a word as is.  NULL when nothing is left.

    Linear in the number of tokens: word starts are found with one ``filter`` and each
    word is assembled from its slice.  ``tokens`` names a column: the lambdas read it, and
    a column is an O(1) read there while an inline expression would be re-evaluated per
    element.
    """
    if not isinstance(tokens, str):
        raise TypeError("merge_subwords takes the name of an array<string> column")
    t = F.col(tokens)
    n = F.size(t)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                      lambda i: (i == 1) | ~F.element_at(t, i).startswith("##"))
    starts = F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))
    bounds = F.zip_with(starts, F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))),
                                         F.array(n + 1)),
                        lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    words = F.transform(bounds, lambda b: F.concat(
        F.element_at(t, b["s"]),
        F.array_join(F.transform(F.slice(t, b["s"] + 1, F.greatest(b["e"] - b["s"] - 1, F.lit(0))),
                                 lambda x: F.replace(x, F.lit("##"), F.lit(""))), "")))
    return F.when(F.coalesce(n, F.lit(0)) > 0, words)
