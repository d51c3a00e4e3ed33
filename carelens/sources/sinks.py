"""Sinks (S9-S13).  Spark writers with explicit save modes; parquet is the default
format for intermediate and extraction tables."""

from __future__ import annotations

import functools
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.numbering import numbered
from ..session import commit_folder, list_committed, list_parts


def write_posts_json(df: DataFrame, path: str, exists_ok: bool = False) -> None:
    """All collected posts; refuses an existing output unless ``exists_ok``."""
    df.write.mode("overwrite" if exists_ok else "errorifexists").json(path)


def append_json_sorted(df: DataFrame, path: str) -> None:
    """Append a batch with the top-level keys in sorted order."""
    df.select(*sorted(df.columns)).write.mode("append").json(path)


def write_json_arrays(df: DataFrame, path: str, exists_ok: bool = False) -> None:
    """S9 in the original's form: every file holds one JSON array, a record a line."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(_array_lines, "value string")
    lines.write.mode("overwrite" if exists_ok else "errorifexists").text(path)


def _array_lines(batches):
    """The lines of one task's records as a JSON array."""
    before = "["
    for batch in batches:
        lines = []
        for record in batch.column("value").to_pylist():
            lines.append(before + record)
            before = ","
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"])], names=["value"])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                header: bool = True) -> None:
    """Merged, concatenated, submission, comment and share tables."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", header)
    w.format(fmt).save(path)


def write_entity_frequencies(freq: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Entity frequencies as one long table partitioned by entity type (the three
    sheets PROBLEMS / TREATMENTS / TESTS become three partitions)."""
    freq.write.mode(mode).partitionBy("type").parquet(path)


def stage_output(df: DataFrame, path: str) -> DataFrame:
    """S14 (batch form): write a stage's output and read it back, cutting the lineage so a
    lost executor recomputes nothing before this point."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)



class RowSnapshots:
    """A job over many rows that leaves a snapshot after every ``rows`` of them, and goes
    on after the last one when it is started again.

    The input is numbered once over a stable order and stored under ``path``, a folder for
    each chunk; chunk i holds rows i * rows to (i + 1) * rows, and reading it opens its own
    files only.  Each chunk's result is a folder of its own, committed when it is whole; a
    chunk without a commit is made again and replaces what is there, so a job that dies
    between or within chunks repeats and loses nothing.

    ``at_once`` chunks are worked on in one Spark job; they are then committed one by one, in
    order.  A job that dies repeats that many chunks at most.
    """

    def __init__(self, spark: SparkSession, path: str, rows: int = 10_000, at_once: int = 64):
        if rows < 1:
            raise ValueError("rows is 1 or more")
        if at_once < 1:
            raise ValueError("at_once is 1 or more")
        self.spark, self.path, self.rows, self.at_once = spark, path.rstrip("/"), rows, at_once

    def done(self) -> list[int]:
        """The chunks that are committed."""
        return list_committed(self.spark, f"{self.path}/chunks", "chunk")

    def _stored(self, df: DataFrame, order: list[Column]) -> str:
        """The folder of the numbered input, written by the first start."""
        place = f"{self.path}/input"
        if 1 not in list_committed(self.spark, place, "version"):
            rows = numbered(df, order, "__n")
            (rows.withColumn("__chunk", F.floor(F.col("__n") / self.rows)).drop("__n")
             .write.mode("overwrite").partitionBy("__chunk").parquet(f"{place}/version=1"))
        return f"{place}/version=1"

    def run(self, df: DataFrame, order: list[Column], process: Callable[[DataFrame], DataFrame] | list[Column],
            after: Callable[[int], None] | None = None) -> DataFrame:
        """The results of ``process`` on all chunks of ``df``; ``after(i)`` is called behind chunk i.

        ``process`` is called with the rows of each chunk.  Where it is a list of columns, each
        of them computed from its row alone, chunks worked on together are one select, so
        that many small chunks cost the driver little.

        A restarted job takes the input that the first start stored, not ``df``.  ``order``
        should be unique, so that a start that died while storing numbers alike.
        """
        spark, place = self.spark, self._stored(df, order)
        chunks = len(list_parts(spark, place, "__chunk"))
        given = spark.read.parquet(f"{place}/__chunk=0").schema if chunks else df.schema
        none = spark.createDataFrame([], given)
        schema = (process(none) if callable(process) else none.select(*process)).schema
        if not chunks:
            return spark.createDataFrame([], schema)
        done = set(self.done())
        todo = [i for i in range(chunks) if i not in done]
        rows = spark.read.schema(StructType([*given, StructField("__chunk", IntegerType())])).parquet(place) if todo else None
        for first in range(0, len(todo), self.at_once):
            wave = todo[first:first + self.at_once]
            if callable(process):
                made = [process(spark.read.schema(given).parquet(f"{place}/__chunk={i}")).withColumn("__chunk", F.lit(i))
                        for i in wave]
                while len(made) > 1:                          # a shallow tree of unions
                    made = [functools.reduce(DataFrame.unionAll, made[i:i + 2]) for i in range(0, len(made), 2)]
                made = made[0]
            else:
                made = rows.filter(F.col("__chunk").isin(wave)).select(*process, "__chunk")
            made.write.mode("overwrite").partitionBy("__chunk").parquet(f"{self.path}/begun")
            self._commit(wave, after)
        return spark.read.schema(schema).option("basePath", f"{self.path}/chunks").parquet(f"{self.path}/chunks") \
            .select(*[f"`{f.name}`" for f in schema])

    def _commit(self, wave: list[int], after: Callable[[int], None] | None) -> None:
        def commit(i):
            commit_folder(self.spark, f"{self.path}/begun/__chunk={i}", f"{self.path}/chunks/chunk={i}")
        if after is None:
            with ThreadPoolExecutor(8) as pool:
                list(pool.map(commit, wave))
            return
        for i in wave:
            commit(i)
            after(i)
