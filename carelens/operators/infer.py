"""Batch model scoring hook.

``score_batches`` runs any predictor over Arrow batches with ``mapInPandas``: the
predictor is built once per task by a factory (so model weights load once per
executor task, not per row), and it sees pandas batches of
``spark.sql.execution.arrow.maxRecordsPerBatch`` rows.  The caller declares the output
schema.  No model library ships with this package; ``CharCountPredictor`` is the
deterministic stand-in used in tests.

``score_fixed_batches`` feeds the predictor batches of one stated size, whatever the Arrow
batches are, and holds its answers against the questions.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class CharCountPredictor:
    """Stand-in predictor: the character count of each text."""

    def __init__(self, text_col: str = "text", out_col: str = "prediction"):
        self.text_col = text_col
        self.out_col = out_col

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.drop(columns=[self.text_col])
        out[self.out_col] = pdf[self.text_col].str.len().astype("Int64")
        return out


def score_batches(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                  schema: str, partitions: int | None = None) -> DataFrame:
    """Apply ``factory()`` to every Arrow batch of ``df``.

    A single large input file can arrive as one partition; when the input has fewer
    partitions than ``partitions`` it is spread out first (a round-robin shuffle) so the
    model runs on all cores.  A large input is never shuffled into fewer partitions.
    """
    if partitions and df.rdd.getNumPartitions() < partitions:
        df = df.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = factory()
        for b in batches:
            yield predictor(b)

    return df.mapInPandas(run, schema=schema)


def refilled(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` in batches of exactly ``rows``, the last one smaller."""
    held, size = [], 0
    for b in batches:
        at = 0
        while at < len(b):
            part = b.iloc[at:at + rows - size]
            held.append(part)
            size, at = size + len(part), at + len(part)
            if size == rows:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def score_fixed_batches(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                        schema: str, key: str, batch_rows: int = 256, retries: int = 1) -> DataFrame:
    """M9 with the batches of the original: exactly ``batch_rows`` rows each (a task's last one
    may be smaller), refilled across Arrow batches.

    The answers must be as many as the questions and carry their ``key`` values in the same
    order, else the task fails: a model that drops, adds or reorders rows would put answers to
    the wrong users.  A batch whose prediction raises is tried ``retries`` times more, alone; a
    wrong number or order of answers is no reason to try again.
    """
    if batch_rows < 1 or retries < 0:
        raise ValueError("batch_rows is 1 or more, retries 0 or more")

    def predicted(predictor, batch: pd.DataFrame) -> pd.DataFrame:
        for left in range(retries, -1, -1):
            try:
                return predictor(batch)
            except Exception:
                if not left:
                    raise
        raise AssertionError("unreachable")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = factory()
        for batch in refilled(batches, batch_rows):
            asked = batch[key].tolist()
            out = predicted(predictor, batch)
            if len(out) != len(asked):
                raise ValueError(f"{len(asked)} rows given, {len(out)} predicted")
            if not all(a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip(asked, out[key].tolist())):
                raise ValueError(f"predictions are not in the order of the rows ({key})")
            yield out

    return df.mapInPandas(run, schema=schema)
