"""Attach user records to posts (J1) and model predictions to users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import sized_broadcast


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per ``key``: the last by ``order`` (the original keeps the last duplicate).

    ``order`` must be unique and not null within a key.  ``max(order)`` is a hash aggregate
    with partial results per task (for numbers and times), so a repeated key never lands
    whole in one task; the rows are joined back on (key, order).
    """
    last = df.groupBy(F.col(key).alias("__k")).agg(F.max(order).alias("__o"))
    return df.join(last, (df[key] == last["__k"]) & (df[order] == last["__o"]), "left_semi")


def attach_users(posts: DataFrame, users: DataFrame, author_key: str = "author_id",
                 user_key: str = "id", user_order: str | None = None, into: str = "user",
                 strict: bool = False, broadcast_rows: int | None = None,
                 users_unique: bool = False) -> DataFrame:
    """Post.author_id -> user record, nested as the ``user`` struct.

    Users are made unique by id first: the last by ``user_order`` wins, which must be given
    unless ``users_unique``.  A left join keeps
    posts without a user (``user`` NULL); ``strict=True`` counts those and raises, as the
    original's dictionary lookup would.  No broadcast hint: Spark broadcasts the user side
    when its measured size is under the threshold (adaptive execution re-checks at run
    time with real sizes) and otherwise shuffles both sides on the key, splitting a hot
    author's partition (skew join).  ``broadcast_rows`` forces a checked broadcast;
    ``users_unique`` skips the de-duplication (the caller already made ids unique).
    """
    if not users_unique and user_order is None:
        raise ValueError("name the column that tells which of several user records is the last")
    u = users if users_unique else latest_per_key(users, user_key, user_order)
    fields = u.columns
    u = u.select(F.col(user_key).alias("__uk"), F.struct(*[F.col(c) for c in fields]).alias(into))
    if broadcast_rows:
        u = sized_broadcast(u, broadcast_rows)
    out = posts.join(u, posts[author_key] == F.col("__uk"), "left").drop("__uk")
    if strict:
        missing = out.filter(F.col(into).isNull() & F.col(author_key).isNotNull()).limit(1).count()
        if missing:
            raise KeyError("post author without a user record")
    return out


def attach_predictions(users: DataFrame, predictions: DataFrame, key: str = "id",
                       into: str = "demographic_info", check_counts: bool = False) -> DataFrame:
    """Left join per-user predictions (e.g. from ``infer.score_batches``) as a struct."""
    pcols = [c for c in predictions.columns if c != key]
    p = predictions.select(F.col(key).alias("__pk"), F.struct(*pcols).alias(into))
    out = users.join(p, users[key] == F.col("__pk"), "left").drop("__pk")
    if check_counts:
        n_in = users.select(key).distinct().count()
        n_out = predictions.select(key).distinct().count()
        if n_in != n_out:
            raise AssertionError(f"{n_in} users but {n_out} predictions")
    return out
