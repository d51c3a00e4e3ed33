"""Readers (S1, S2, S6-S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas


def read_posts(spark: SparkSession, path: str, schema: StructType = schemas.POST,
               multiline: bool = True) -> DataFrame:
    """Posts from JSON.  ``multiline=True`` reads files holding one JSON array each (the
    original's output format); JSON Lines (``multiline=False``) splits at scale."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def post_triples(df: DataFrame, text: str = "text", list_text: bool = False,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """(text, location, created_at); location ``''`` when the user has none.

    ``list_text`` joins a text stored as a list of strings with blanks; ``keep`` carries
    extra columns (e.g. an order key for the first-occurrence de-duplication).
    """
    t = F.array_join(F.col(text), " ") if list_text else F.col(text)
    loc = F.coalesce(F.col("user.location"), F.lit("")) if "user" in df.columns else F.lit("")
    return df.select(t.alias("text"), loc.alias("location"), F.col("created_at"), *keep)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True,
                   schema: StructType | None = None) -> DataFrame:
    """Concept dictionary or mention sheet exported as CSV (first row = header)."""
    r = spark.read.option("header", header).option("sep", sep)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lexicon ``Symptom CUI LexicalExpression`` (clean with
    ``operators.lexicon.normalize_lexicon``)."""
    return read_delimited(spark, path, sep="\t", schema=schemas.LEXICON)
