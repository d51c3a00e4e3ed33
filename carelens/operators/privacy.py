"""De-identification of whole records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.privacy import hash_mentions, hash_value


def _struct_fields(df: DataFrame, col: str) -> list[str]:
    if col not in df.columns:
        return []
    t = df.schema[col].dataType
    return [f.name for f in t.fields] if isinstance(t, StructType) else []


def hash_ids(df: DataFrame, bits: int = 224, text: str = "text", user: str = "user") -> DataFrame:
    """P1 + P2: user name to SHA hex; every ``@name`` in the user description and in the
    text to ``@`` + hash.  Fields that are absent are skipped."""
    ufields = _struct_fields(df, user)
    if ufields:
        u = F.col(user)
        if "username" in ufields:
            u = u.withField("username", hash_value(F.col(f"{user}.username"), bits))
        if "description" in ufields:
            u = u.withField("description", hash_mentions(F.col(f"{user}.description"), "@", bits))
        df = df.withColumn(user, u)
    if text in df.columns:
        df = df.withColumn(text, hash_mentions(text, "@", bits))
    return df


def anonymize_forum(df: DataFrame, col: str, bits: int = 224, author: str = "author") -> DataFrame:
    """P3 + P4: author to SHA hex, ``/u/name`` in ``col`` to ``/u/`` + hash.

    The original stringifies a missing text to ``'nan'`` before hashing; here NULL stays
    NULL so the removed-row filter can still drop it (the documented intention).
    """
    if author in df.columns:
        df = df.withColumn(author, hash_value(author, bits))
    if col in df.columns:
        df = df.withColumn(col, hash_mentions(col, "/u/", bits))
    return df


def remove_unused_fields(df: DataFrame, entities: str = "entities", user: str = "user") -> DataFrame:
    """P5: drop entities.mentions, author_id, id, a plain ``author`` name, user.name, user.id
    and user.profile_image_url, each only if present."""
    efields = _struct_fields(df, entities)
    if "mentions" in efields:
        df = df.withColumn(entities, F.col(entities).dropFields("mentions"))
    df = df.drop(*[c for c in ("author_id", "id", "author") if c in df.columns])
    ufields = _struct_fields(df, user)
    gone = [f for f in ("name", "id", "profile_image_url") if f in ufields]
    if gone:
        df = df.withColumn(user, F.col(user).dropFields(*gone))
    return df


def only_ids(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The id-only release."""
    return df.select(F.col(id_col).alias("tweet_id"))


def comment_author_name(df: DataFrame, author: str = "author") -> DataFrame:
    """The comment author's name (``author.name`` of an author record, else the value)."""
    if "name" in _struct_fields(df, author):
        return df.withColumn(author, F.col(f"{author}.name"))
    return df
