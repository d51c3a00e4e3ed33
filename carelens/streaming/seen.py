"""De-duplication over micro-batches with flat executor state (ST3, F8).

What has been seen lives in a store on shared storage, not in stream state: 128-bit key
hashes in parquet, dealt into buckets, with one Bloom filter per bucket.  A micro-batch is
reduced to its distinct keys; each bucket's keys are probed against the bucket's filter.
A key that the filter does not know is new without any look at the store; the others are
compared with the stored hashes, of which only their buckets are read.

Every batch reads what batches of smaller ids committed and writes folders named by its own
id, so a batch that is run again after a failure finds the same store, replaces its own
output and adds nothing.  An executor holds one bucket's keys of one batch and one filter
at a time, however long the stream runs; ``buckets`` sets that size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, list_committed, scratch_path

_HASHES = 7
PROBED = "bucket int, h1 long, h2 long, maybe boolean, filter binary"
_PROBED = pa.schema([("bucket", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()),
                     ("maybe", pa.bool_()), ("filter", pa.binary())])
KEYS = "h1 long, h2 long"


class BloomFilter:
    """A Bloom filter over pairs of 64-bit hashes; ``bits`` is a multiple of 8."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.bytes = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8).copy()

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        step = h2.view(np.uint64) | np.uint64(1)
        places = h1.view(np.uint64)[:, None] + np.arange(_HASHES, dtype=np.uint64) * step[:, None]
        return ((places >> np.uint64(7)) % np.uint64(self.bits)).astype(np.int64)

    def may_hold(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        at = self._places(h1, h2)
        return (self.bytes[at >> 3] >> (at & 7) & 1).all(axis=1)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        at = self._places(h1, h2).ravel()
        np.bitwise_or.at(self.bytes, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _probe(bits: int):
    def run(key, keys: pa.Table, filters: pa.Table) -> pa.Table:
        stored = filters.column("filter").to_pylist()
        seen = BloomFilter(bits, stored[0] if stored else None)
        h1, h2 = (keys.column(c).combine_chunks().to_numpy() for c in ("h1", "h2"))
        maybe = seen.may_hold(h1, h2)
        seen.add(h1, h2)
        bucket, n = key[0].as_py(), len(h1)
        return pa.Table.from_arrays([
            pa.array([bucket] * (n + 1), pa.int32()), pa.array([*h1.tolist(), None], pa.int64()),
            pa.array([*h2.tolist(), None], pa.int64()), pa.array([*maybe.tolist(), None], pa.bool_()),
            pa.array([None] * n + [seen.bytes.tobytes()], pa.binary())], schema=_PROBED)
    return run


def key_hashes(keys: list[str]) -> tuple[Column, Column]:
    """Two 64-bit hashes of the key columns; a null differs from every value and place."""
    parts = [x for k in keys for x in (F.col(k), F.col(k).isNull())]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


class SeenStore:
    """The hashes that committed batches of a stream have brought, under ``path``.

    ``bucket_keys`` is the number of keys per bucket that filters are sized for (ten bits a
    key: about one in a hundred new keys is looked up in vain); more keys cost more look-ups,
    not wrong rows.  After ``compact_every`` batches their key files are rewritten as one folder.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, bucket_keys: int = 100_000,
                 compact_every: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.bits, self.compact_every = max(64, bucket_keys * 10 // 8 * 8), compact_every

    def _parts(self, epoch: int) -> list[str]:
        """The folders that hold the keys of all batches before ``epoch``."""
        merged = [m for m in list_committed(self.spark, f"{self.path}/merged", "upto") if m < epoch]
        upto = merged[-1] if merged else -1
        single = [b for b in list_committed(self.spark, f"{self.path}/keys", "batch") if upto < b < epoch]
        return ([f"{self.path}/merged/upto={upto}"] if merged else []) + [f"{self.path}/keys/batch={b}" for b in single]

    def keys(self, epoch: int = 1 << 62) -> DataFrame | None:
        """(bucket, h1, h2) of all batches before ``epoch``, None if there was none."""
        found = None
        for part in self._parts(epoch):
            one = self.spark.read.schema(f"{KEYS}, bucket int").option("basePath", part).parquet(part)
            found = one if found is None else found.unionByName(one)
        return found

    def _write_keys(self, rows: DataFrame, path: str) -> None:
        (rows.select("h1", "h2", "bucket").repartition(F.col("bucket")).write.mode("overwrite")
         .partitionBy("bucket").parquet(path))

    def admit(self, keys: DataFrame, epoch: int) -> DataFrame:
        """The rows (h1, h2) of ``keys``, which are distinct, that no batch before ``epoch`` had."""
        spark = self.spark
        probes = f"{self.path}/probe"
        before = [b for b in list_committed(spark, probes, "batch") if b < epoch]
        probed = spark.read.schema(PROBED)
        filters = (probed.parquet(f"{probes}/batch={before[-1]}").filter("filter IS NOT NULL") if before
                   else spark.createDataFrame([], PROBED)).select("bucket", "filter")
        dealt = keys.withColumn("bucket", F.pmod("h1", F.lit(self.buckets)).cast("int")).select("bucket", "h1", "h2")
        (dealt.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_probe(self.bits), PROBED)
         .write.mode("overwrite").parquet(f"{probes}/batch={epoch}"))
        here = probed.parquet(f"{probes}/batch={epoch}").filter("h1 IS NOT NULL").drop("filter")
        new, maybe, store = here.filter("NOT maybe"), here.filter("maybe"), self.keys(epoch)
        if store is not None and not maybe.isEmpty():
            # a semi join from the store, so that only the buckets asked for are read
            known = store.join(maybe, ["bucket", "h1", "h2"], "left_semi")
            new = new.unionByName(maybe.join(known, ["bucket", "h1", "h2"], "left_anti"))
        elif store is None:
            new = here
        place = f"{self.path}/keys/batch={epoch}"
        self._write_keys(new, place)
        for old in before[:-1]:                   # the last one is what a repeated batch reads
            drop_path(spark, f"{probes}/batch={old}")
        self._compact(epoch)
        return spark.read.schema(f"{KEYS}, bucket int").option("basePath", place).parquet(place).select("h1", "h2")

    def _compact(self, epoch: int) -> None:
        parts = self._parts(epoch)
        if len(parts) <= self.compact_every:
            return
        last = int(parts[-1].rpartition("=")[2])
        self._write_keys(self.keys(epoch), f"{self.path}/merged/upto={last}")
        for part in parts:                        # committed above: these are not read again
            drop_path(self.spark, part)


def unique_to_parquet(df: DataFrame, keys: list[str], name: str, sink: str | None = None,
                      checkpoint: str | None = None, store: SeenStore | None = None,
                      order: tuple[str, ...] = (), progress: list | None = None) -> DataFrame:
    """Run a stream and keep one row of each key over all its batches; returns the sink.

    Of several rows with a key in one batch the least by ``order``, then by all columns, is
    kept; a key of an earlier batch drops the row.  Null keys count as values.  Pass the same
    ``sink``, ``checkpoint`` and ``store`` to resume; the rows of batch n are in ``batch=n``.
    ``progress`` receives the progress events.
    """
    spark = df.sparkSession
    base = scratch_path(spark, name)
    sink, store = sink or f"{base}/rows", store or SeenStore(spark, f"{base}/seen")
    others = [c for c in df.columns if c not in order]
    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{sink}/batch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        h1, h2 = key_hashes(keys)
        first = (batch.select(h1.alias("h1"), h2.alias("h2"), F.struct(*order, *others).alias("row"))
                 .groupBy("h1", "h2").agg(F.min("row").alias("row")))
        new = store.admit(first.select("h1", "h2"), epoch)
        (first.join(new, ["h1", "h2"], "left_semi").select(*(F.col(f"row.{c}").alias(c) for c in batch.columns))
         .write.mode("overwrite").parquet(f"{sink}/batch={epoch}"))

    query = (df.writeStream.option("checkpointLocation", checkpoint or f"{base}/checkpoint")
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(df.schema).option("basePath", sink).parquet(sink).select(*df.columns)
