"""Bounded, ordered reads of landed submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..operators.select import validate_cap

SORT_COLUMNS = ("score", "num_comments", "created_utc")


def page_top(df: DataFrame, subreddit: str | None = None, after: int | None = None,
             before: int | None = None, sort_type: str = "created_utc", sort: str = "desc",
             max_rows="all", id_col: str = "id") -> DataFrame:
    """S3 + S5: submissions of a subreddit with ``after < created_utc < before``, ordered
    by ``sort_type`` (ties by id) and capped; plans as TakeOrderedAndProject (a top-n per
    task, then a merge of n rows per task), never a global sort."""
    if sort_type not in SORT_COLUMNS:
        raise ValueError(f"sort_type must be one of {SORT_COLUMNS}")
    if sort not in ("asc", "desc"):
        raise ValueError("sort must be asc or desc")
    out = df
    if subreddit is not None:
        out = out.filter(F.col("subreddit") == subreddit)
    if after is not None:
        out = out.filter(F.col("created_utc") > after)
    if before is not None:
        out = out.filter(F.col("created_utc") < before)
    key = F.col(sort_type).desc() if sort == "desc" else F.col(sort_type).asc()
    tie = F.col(id_col).desc() if sort == "desc" else F.col(id_col).asc()
    out = out.orderBy(key, tie)
    cap = validate_cap(max_rows) if max_rows != "all" else None
    return out.limit(cap) if cap else out


def page_keyset(df: DataFrame, last_created: int | None, last_id: str | None, page_size: int = 500,
                subreddit: str | None = None, id_col: str = "id") -> DataFrame:
    """The next page, newest first, strictly after the last row seen.

    Keyset on (created_utc, id): rows sharing the last row's second are not lost at a
    page edge, unlike paging on created_utc alone.
    """
    out = df if subreddit is None else df.filter(F.col("subreddit") == subreddit)
    if last_created is not None:
        c, i = F.col("created_utc"), F.col(id_col)
        out = out.filter((c < last_created) | ((c == last_created) & (i < last_id)))
    return out.orderBy(F.col("created_utc").desc(), F.col(id_col).desc()).limit(page_size)


def all_pages(df: DataFrame, page_size: int = 500, id_col: str = "id") -> DataFrame:
    """S4 as one result: every row with its ``page`` (from 0) and ``place`` on it, newest first.

    The pages are those of the keyset walk over (created_utc, id), computed at once: one
    global sort and a count per partition, no walk and no window over all rows.  Rows without
    a time come last.
    """
    if page_size < 1:
        raise ValueError("page_size is 1 or more")
    order = [F.col("created_utc").desc_nulls_last(), F.col(id_col).desc_nulls_last()]
    rows = numbered(df, order, "__n")
    return rows.withColumns({"page": F.floor(F.col("__n") / page_size).cast("long"),
                             "place": (F.col("__n") % page_size).cast("int")}).drop("__n")
