"""Decisions on label scores.

Scores arrive as map<string,double> per text (from a zero-shot model through
``infer.score_batches``); decisions are plain Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def best_label_index(scores: str | Column, labels: list[str]) -> Column:
    """0-based index in ``labels`` of the highest-scoring label (first on ties)."""
    if not labels:
        raise ValueError("candidate label list is empty")
    s = _c(scores)
    arr = F.array(*[F.element_at(s, F.lit(l)).cast("double") for l in labels])
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def threshold_vote(scores: str | Column, thresholds: dict[str, float]) -> Column:
    """1 if **every** label's score is strictly above its threshold, else 0."""
    if not thresholds:
        raise ValueError("no label thresholds are given")
    s = _c(scores)
    conds = [F.coalesce(F.element_at(s, F.lit(k)) > F.lit(float(v)), F.lit(False))
             for k, v in thresholds.items()]
    allc = conds[0]
    for c in conds[1:]:
        allc = allc & c
    return allc.cast("int")
