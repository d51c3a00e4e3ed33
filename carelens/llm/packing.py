"""Best-fit packing under conflicts.

Documents go into bins of ``capacity`` tokens.  No bin holds two documents of one source
or of one duplicate cluster: each open bin carries a bitmap of the sources and clusters in
it.  Open bins are kept in the order of their residual capacity; a document goes to the
first bin from its own length upwards (the successor search) whose bitmap shares no bit
with its own, and a new bin opens if none does.  Documents come in descending length.

Spark deals the documents evenly into pools of about ``pool_items`` rows and every pool is
packed by itself, so a task holds one pool, whatever the corpus or its largest source is.
A pool of thousands of documents is varied enough that its bins fill as a global packing's
would; a source with a third of all rows has a third of every pool.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

PACKED = "doc_id long, piece int, bin long, start int, n_tokens int"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("bin", pa.int64()),
                     ("start", pa.int32()), ("n_tokens", pa.int32())])


def pack_pool(items: list[tuple], capacity: int):
    """Yield (key, piece, bin, start, size) for ``items`` = [(key, size, source, cluster)].

    Pieces of ``capacity`` tokens fill bins of their own; what is left of a document is
    packed.  A size of 0 gets no bin (None).  A None source or cluster conflicts with nothing.
    """
    seen: dict = {}
    twice = set()
    for _, _, source, cluster in items:
        for tag in (("s", source), ("c", cluster)):
            if tag[1] is not None:
                if tag in seen:
                    twice.add(tag)
                seen.setdefault(tag, None)
    bit = {tag: 1 << i for i, tag in enumerate(t for t in seen if t in twice)}   # others meet nothing

    n_bins, rest = 0, []
    for key, size, source, cluster in items:
        full, left = divmod(size or 0, capacity)
        for piece in range(full):
            yield key, piece, n_bins, 0, capacity
            n_bins += 1
        if left:
            rest.append((left, key, full, bit.get(("s", source), 0) | bit.get(("c", cluster), 0)))
        elif not full:
            yield key, 0, None, 0, 0
    rest.sort(key=lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2], r[3]))

    order: list[tuple[int, int]] = []        # (residual, bin), ascending
    tags: dict[int, int] = {}
    for size, key, piece, tag in rest:
        at = bisect.bisect_left(order, (size, -1))
        if tag:
            while at < len(order) and tags[order[at][1]] & tag:
                at += 1
        if at < len(order):
            residual, home = order.pop(at)
        else:
            residual, home = capacity, n_bins
            tags[home] = 0
            n_bins += 1
        yield key, piece, home, capacity - residual, size
        tags[home] |= tag
        if residual > size:
            bisect.insort(order, (residual - size, home))


def _task(capacity: int, pool_items: int):
    def rows(items, pool):
        part = TaskContext.get().partitionId()
        for key, piece, home, start, size in pack_pool(items, capacity):
            yield key, piece, None if home is None else (part << 40) + (pool << 30) + home, start, size

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)],
                                          schema=_SCHEMA)

    def run(batches):
        held, pool = [], 0

        def flush():
            out = []
            for row in rows(held, pool):
                out.append(row)
                if len(out) == 50_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)
        for b in batches:
            held += zip(*(b.column(c).to_pylist() for c in ("key", "size", "source", "cluster")))
            if len(held) >= 2 * pool_items:
                yield from flush()
                held, pool = [], pool + 1
        if held:
            yield from flush()
    return run


def best_fit_pack(items: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens",
                  source_col: str = "source", cluster_col: str = "cluster",
                  pool_items: int = 16_384) -> DataFrame:
    """(doc_id, piece, bin, start, n_tokens): where every piece of every row goes.

    A row longer than ``capacity`` is cut into full pieces, each a bin of its own, and a
    last piece that is packed.  A null or zero size has one row without a bin.  Rows with a
    null source or cluster conflict with no row through it.  Repeated rows are packed as
    often as they come (a shared source keeps them in different bins).  Further columns are
    ignored; an empty table gives no rows.
    """
    rows = items.select(F.col(id_col).cast("long").alias("key"), F.col(size_col).cast("long").alias("size"),
                        F.col(source_col).cast("string").alias("source"),
                        F.col(cluster_col).cast("string").alias("cluster"))
    # dealt round robin: Spark sorts the rows first, so a repeated task sees the same pool
    pools = max(1, -(-items.count() // pool_items))
    return rows.repartition(pools).mapInArrow(_task(capacity, pool_items), PACKED)


def document_items(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words of the text, 0 for a null one) and cluster (equal texts share one)."""
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[ \x09-\x0D]+"), lambda w: w != "")
    return docs.withColumns({"n_tokens": F.size(words), "cluster": F.xxhash64(F.col(text_col))})
