"""Banned-term filter (F4 on posts, F5 on any forum column).

A row is dropped when its lower-cased text contains a banned term with a non-word
character on **both** sides, as in the original: a term at the very start or end of the
text is not caught.  All terms go into one trie-factored alternation, so the filter is
one regex pass per row instead of one pass per term (about 10x cheaper than OR-ing
separate ``rlike`` predicates, and O(text x trie depth)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BANNED_TERMS
from ..functions.patterns import NON_WORD, trie_alternation


def banned_pattern(terms=None, escape: bool = True) -> str:
    terms = BANNED_TERMS if terms is None else terms
    return NON_WORD + trie_alternation([t.lower() for t in terms], escape=escape) + NON_WORD


def mentions_banned(col: str | Column = "text", terms=None, escape: bool = True) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.lower(c).rlike(banned_pattern(terms, escape)), F.lit(False))


def drop_banned(df: DataFrame, col: str = "text", terms=None, escape: bool = True) -> DataFrame:
    """keep rows whose ``col`` mentions no banned term."""
    return df.filter(~mentions_banned(col, terms, escape))
