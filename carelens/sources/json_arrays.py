"""JSON array files in byte ranges.

A collector writes one JSON array to a file, and a file of one array is one task for a
reader that must see it whole.  Here a file is cut into ranges of equal length, and each
range is a task, in two passes:

1. each range counts its quotes and brackets twice over: as if it began outside a string,
   and as if it began inside one.  Of the two, a running sum over the (few) ranges of a file
   then picks the right one, which gives every range the state it begins in: in a string or
   not, and how deep.
2. each range emits the records that begin in it; the last one is read on beyond its end.

Both passes look at bytes in arrays and hold one range (or one longer record) at a time.  The
records go through ``from_json`` with the given schema.  Files are opened by pyarrow, which
knows local paths, HDFS and the object stores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..session import list_files

_QUOTE, _ESCAPE = ord('"'), ord("\\")
#: White space, and the bytes of a byte-order mark.
_SPACES = b" \t\r\n\xef\xbb\xbf"
#: +1 for an opening bracket, -1 for a closing one.
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]], _STEP[[ord("}"), ord("]")]] = 1, -1

_SCANNED = pa.schema([("range", pa.int64()), ("turns", pa.bool_()), ("outside", pa.int64()),
                      ("inside", pa.int64()), ("first", pa.int32())])
SCANNED = "range long, turns boolean, outside long, inside long, first int"


def unescaped_quotes(data: np.ndarray, before: int = 0) -> np.ndarray:
    """Marks the quotes that an even number of backslashes precedes; ``before`` counts those
    right before ``data``."""
    quote = data == _QUOTE
    at = np.flatnonzero(quote)
    if len(at):
        other = np.flatnonzero(data != _ESCAPE)
        # the last byte before each quote that is no backslash
        left = np.searchsorted(other, at) - 1
        run = at - 1 - np.where(left >= 0, other[np.maximum(left, 0)], -1 - before)
        quote[at[run % 2 == 1]] = False
    return quote


class RangeFile:
    """Byte ranges of one file."""

    def __init__(self, path: str):
        if "://" not in path and path.partition(":")[0] in ("file", "hdfs"):
            scheme, _, rest = path.partition(":")
            path = f"{scheme}://{rest}"
        fs, where = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(where)
        self.size = self.file.size()

    def read(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, min(end, self.size) - start))

    def escapes_before(self, start: int) -> int:
        """The number of backslashes right before a position."""
        count, step = 0, 64
        while start > count:
            lo = max(0, start - count - step)
            part = self.read(lo, start - count)
            tail = len(part) - len(part.rstrip(b"\\"))
            count += tail
            if tail < len(part):
                break
            step *= 2
        return count


def scan(file: RangeFile, start: int, end: int) -> tuple[bool, int, int, int]:
    """(the quotes are odd, depth gained if it begins outside a string, inside one, first byte
    that is no white space or -1)."""
    raw = file.read(start, end)
    data = np.frombuffer(raw, np.uint8)
    inside = np.cumsum(unescaped_quotes(data, file.escapes_before(start)), dtype=np.int32) & 1 == 1
    step = _STEP[data]
    kept = raw.lstrip(_SPACES)
    return (bool(len(inside) and inside[-1]), int(step[~inside].sum(dtype=np.int64)),
            int(step[inside].sum(dtype=np.int64)), kept[0] if kept else -1)


def records(file: RangeFile, start: int, end: int, inside: bool, depth: int, base: int, ahead: int = 1 << 16):
    """The JSON objects at depth ``base`` that begin in [start, end), which begins at ``depth``
    and, if ``inside``, in a string; as bytes."""
    begun, at, stop = b"", start, end                # an open record's bytes so far
    escapes = file.escapes_before(start)
    while at < stop:
        raw = file.read(at, stop)
        if not raw:
            break
        data = np.frombuffer(raw, np.uint8)
        quotes = np.cumsum(unescaped_quotes(data, escapes), dtype=np.int32)
        string = (quotes + inside) & 1 == 1
        step = np.where(string, np.int8(0), _STEP[data])
        level = depth + np.cumsum(step, dtype=np.int32)
        opens = np.flatnonzero((step == 1) & (level == base + 1) & (data == ord("{")))
        closes = np.flatnonzero((step == -1) & (level == base) & (data == ord("}")))
        if begun and len(closes):
            yield begun + raw[:closes[0] + 1]
            begun, closes = b"", closes[1:]
        elif begun:
            begun += raw
        if at < end and len(opens):
            # a close before the first opening is that of a record of an earlier range
            closes = closes[closes > opens[0]]
            for a, b in zip(opens, closes):
                yield raw[a:b + 1]
            if len(opens) > len(closes):
                begun = raw[opens[-1]:]
        inside, depth = bool(string[-1]), int(level[-1])
        tail = len(raw) - len(raw.rstrip(b"\\"))
        escapes = escapes + tail if tail == len(raw) else tail
        at += len(raw)
        # an open record is read on, in growing steps, to its end or that of the file
        stop = min(file.size, at + ahead) if begun else at
        ahead *= 2


def _scan_task(ranges):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.column("id").to_pylist():
                path, start, end = ranges.value[r]
                out.append((r, *scan(RangeFile(path), start, end)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCANNED)],
                                                 schema=_SCANNED)
    return run


def _record_task(ranges, states):
    def run(batches):
        for batch in batches:
            for r in batch.column("id").to_pylist():
                path, start, end = ranges.value[r]
                held, size = [], 0
                for record in records(RangeFile(path), start, end, *states.value[r]):
                    held.append(record.decode("utf-8"))
                    size += len(record)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["record"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["record"])
    return run


def array_records(spark: SparkSession, path: str, range_bytes: int = 8 << 20) -> DataFrame:
    """(record): the text of each object in the JSON array files at or below ``path``.

    A file holds one array of objects, or objects one after another.  Elements that are no
    objects are left out; empty files and arrays give no rows.  UTF-8, with or without a
    byte-order mark.  The ranges of all files are listed in the driver, three numbers each.
    """
    ranges, files = [], []
    for name, length, _ in list_files(spark, path):
        for start in range(0, length, range_bytes):
            files.append(len(ranges) if start == 0 else files[-1])
            ranges.append((name, start, min(length, start + range_bytes)))
    if not ranges:
        return spark.createDataFrame([], "record string")
    shared = spark.sparkContext.broadcast(ranges)
    tasks = spark.range(0, len(ranges), 1, len(ranges))
    scanned = {r.range: r for r in tasks.mapInArrow(_scan_task(shared), SCANNED).collect()}   # five numbers a range
    states, inside, depth, base = [], False, 0, None
    for r in range(len(ranges)):
        if files[r] == r:
            inside, depth, base = False, 0, None
        if base is None and scanned[r].first >= 0:
            base = 1 if scanned[r].first == ord("[") else 0
        states.append((inside, depth, base or 0))
        depth += scanned[r].inside if inside else scanned[r].outside
        inside ^= scanned[r].turns
    return tasks.mapInArrow(_record_task(shared, spark.sparkContext.broadcast(states)), "record string")


def read_array_posts(spark: SparkSession, path: str, schema: StructType = schemas.POST,
                     range_bytes: int = 8 << 20) -> DataFrame:
    """Posts from JSON array files, a task for each ``range_bytes``."""
    return array_records(spark, path, range_bytes).select(F.from_json("record", schema).alias("r")).select("r.*")
