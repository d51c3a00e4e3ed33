"""Ordered cleaning passes over record DataFrames.

A pass is a function ``DataFrame -> DataFrame``; dropping a record is a ``filter``
inside a pass.  The chain is applied with ``DataFrame.transform``, so it is one lazy
plan: Catalyst still pushes deterministic filters below later projections.
"""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame

from ..functions.text import epoch_to_utc_date
from ..operators.banned import drop_banned
from ..operators.privacy import anonymize_forum, hash_ids, remove_unused_fields
from ..operators.select import drop_removed

Pass = Callable[[DataFrame], DataFrame]


class PassChain:
    """An ordered list of passes.  All constructor passes are kept (the original kept
    only the last one, a bug)."""

    def __init__(self, passes: Iterable[Pass] | None = None):
        self.passes: list[Pass] = []
        for p in passes or []:
            self.register(p)

    def register(self, p: Pass) -> "PassChain":
        if not callable(p):
            raise TypeError(f"a pass must be callable, got {p!r}")
        self.passes.append(p)
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        for p in self.passes:
            df = df.transform(p)
        return df


def post_chain(bits: int = 224, terms=None) -> PassChain:
    """The shipped chain: banned-term filter, drop identifying fields, hash ids."""
    return PassChain([
        lambda df: drop_banned(df, "text", terms),
        remove_unused_fields,
        lambda df: hash_ids(df, bits),
    ])


def forum_chain(col: str, anonymize: bool = True, bits: int = 224, terms=None) -> PassChain:
    """(anonymize + banned filter when ``anonymize``), removed/deleted/null filter, UTC date."""
    passes: list[Pass] = []
    if anonymize:
        passes.append(lambda df: anonymize_forum(df, col, bits))
        passes.append(lambda df: drop_banned(df, col, terms))
    passes.append(lambda df: drop_removed(df, col))
    passes.append(lambda df: df.withColumn("created_utc_date", epoch_to_utc_date("created_utc")))
    return PassChain(passes)
