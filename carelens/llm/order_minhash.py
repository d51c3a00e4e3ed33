"""Near duplicates by Order MinHash, verified by banded alignment.

A text's k-mers (k consecutive words) are labelled with their occurrence number, so that a
repeated k-mer counts as often as it occurs.  Each of ``sketches`` hash functions takes
the ``order`` labelled k-mers with the least hashes and lists them *in text order*; the
hash of that list is one bucket.  Two texts share a bucket if the same k-mers are least in
both and stand in the same order, which falls with every edit, moves included.

Texts that share a bucket are compared by a banded alignment of their k-mer sequences:
similarity is aligned / (n + m - aligned) k-mers, the order-aware Jaccard index, and pairs
of ``similarity`` or more are linked.  Classes are the connected components of the links.

Groups are not expanded into pairs:

- equal texts are one text (an aggregate over their digest) before anything else;
- in a bucket every text is compared with the *centre*, its least id: one comparison per
  text, and most near copies are classed by it;
- texts that do not match a centre are compared with the others of its buckets in blocks:
  a block of such texts meets a block of the centre's texts in one task, counts common
  k-mers through an inverted index of the block, and aligns a pair only if it has enough
  of them and is not yet in one class there.  A task returns only links that join two
  classes.  Every pair that shares a bucket shares that bucket's centre, so none is lost.

Every step reads and writes tables in the shared folder.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .components import components
from .slots import parted, slot_words
from .words import Rolling, join_names, mix, signed, steps

_SKETCH = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n", pa.int32()),
                     ("buckets", pa.list_(pa.int64()))])
_SHINGLES = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("shingles", pa.binary())])
_VERDICT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similar", pa.bool_())])


def _kmers(words, k: int):
    """(names, first): the k-mer names of every text, text after text."""
    roll = Rolling(words.name)
    at = np.arange(len(words.name))
    at = at[at + k <= np.repeat(words.first[1:], words.counts())]
    n = np.maximum(words.counts() - k + 1, 0)
    return roll.of(at, at + k), np.concatenate([[0], np.cumsum(n)])


def _labelled(names: np.ndarray) -> np.ndarray:
    """Names joined with their occurrence number in the text."""
    order = np.argsort(names, kind="stable")
    s = names[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    if fresh.all():
        return join_names(names, np.zeros(len(names), np.uint64))
    begin = np.flatnonzero(fresh)
    count = np.empty(len(s), np.uint64)
    count[order] = np.arange(len(s)) - np.repeat(begin, np.diff(np.append(begin, len(s))))
    return join_names(names, count)


def sketch(names: np.ndarray, sketches: int, order: int) -> np.ndarray:
    """One bucket per hash function; texts with fewer k-mers than ``order`` use them all."""
    x = _labelled(names)
    order = min(order, len(x))
    salts = mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = []
    step = max(1, (1 << 20) // len(x))                   # hash functions at a time
    for i in range(0, sketches, step):
        v = salts[i:i + step]
        h = x * v[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        pick = np.argpartition(h, order - 1, axis=1)[:, :order]
        pick.sort(axis=1)                                # text order
        for j in range(order):
            v = mix(v + x[pick[:, j]])
        out.append(v)
    return np.concatenate(out)


def _sketch_task(k, sketches, order):
    def run(batches):
        with np.errstate(over="ignore"):
            for batch, words in steps(batches):
                names, first = _kmers(words, k)
                buckets = [signed(sketch(names[a:b], sketches, order)) if b > a else None
                           for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("digest"),
                     pa.array(np.diff(first), pa.int32()), pa.array(buckets, _SKETCH.field(3).type)],
                    schema=_SKETCH)
    return run


def _shingle_task(k):
    def run(batches):
        for batch, words in steps(batches):
            names, first = _kmers(words, k)
            short = (names >> np.uint64(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"),
                 pa.array([short[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                schema=_SHINGLES)
    return run


def _increasing(at: np.ndarray) -> int:
    """Length of the longest strictly increasing subsequence."""
    if len(at) < 2 or (np.diff(at) > 0).all():
        return len(at)
    tails: list[int] = []
    for x in at.tolist():
        i = bisect.bisect_left(tails, x)
        tails[i:i + 1] = [x]
    return len(tails)


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether a and b have a common subsequence of ``least`` elements or more.

    Two bounds decide most pairs: the common elements with multiplicity (no more can be
    aligned) and the aligned ones among those that occur once in a and in b.  The rest is
    filled in by banded alignment.
    """
    if min(len(a), len(b)) < least:
        return False
    (ua, ia, na), (ub, ib, nb) = (np.unique(x, return_index=True, return_counts=True) for x in (a, b))
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if int(np.minimum(na[x], nb[y]).sum()) < least:
        return False
    once = (na[x] == 1) & (nb[y] == 1)
    left, right = ia[x[once]], ib[y[once]]
    if len(left) >= least and _increasing(right[np.argsort(left)]) >= least:
        return True
    return banded(a, b, least) >= least


def banded(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence, exact if it is ``least`` or more.

    With ``least`` common elements at most len(a) - least of a and len(b) - least of b are
    skipped, so only the diagonals in that range are filled.
    """
    n, m = len(a), len(b)
    skip_a, skip_b = n - least, m - least
    if skip_a < 0 or skip_b < 0:
        return 0
    # row[d]: the best for a[:i] and b[:i + d - skip_a]
    offset = np.arange(skip_a + skip_b + 1) - skip_a
    row = np.zeros(len(offset), np.int32)
    padded = np.concatenate([np.zeros(skip_a, b.dtype), b, np.zeros(skip_b + n + 1, b.dtype)])
    real = np.concatenate([np.zeros(skip_a, bool), np.ones(m, bool), np.zeros(skip_b + n + 1, bool)])
    for i in range(n):
        here = slice(i, i + len(offset))
        hit = (padded[here] == a[i]) & real[here]
        up = np.append(row[1:], 0)                      # a[i] skipped: from the next diagonal
        row = np.maximum.accumulate(np.maximum(up, row + hit))
    return int(row.max())


def _verify_task(similarity):
    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                a, b = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                # aligned / (n + m - aligned) >= s, so aligned >= s (n + m) / (1 + s)
                least = int(np.ceil(similarity * (len(a) + len(b)) / (1 + similarity) - 1e-9))
                out.append(aligned(a, b, least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], schema=_VERDICT)
    return run


def _find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def block_links(lone: list, others: list, matched: list[bool], similarity: float):
    """Yield (i, j): lone[i] links to others[j], where these are not joined by earlier links.

    ``lone`` and ``others`` are lists of (id, k-mer names); others marked ``matched`` are of
    one class (the centre's) from the start.
    """
    sets = [np.sort(_labelled(x.astype(np.uint64))) for _, x in others]
    size = np.array([len(x) for x in sets])
    names = np.concatenate(sets)
    order = np.argsort(names, kind="stable")
    names, owner = names[order], np.repeat(np.arange(len(sets)), size)[order]
    at = {key: j for j, (key, _) in enumerate(others)}
    parent = list(range(len(others) + len(lone)))
    for j, same in enumerate(matched):
        if same:
            parent[j] = matched.index(True)
    share = similarity / (1 + similarity)
    for i, (key, x) in enumerate(lone):
        u = _labelled(x.astype(np.uint64))
        lo = np.searchsorted(names, u, side="left")
        n = np.searchsorted(names, u, side="right") - lo
        hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        common = np.bincount(owner[hit], minlength=len(sets))
        least = np.ceil(share * (len(x) + size) - 1e-9).astype(np.int64)
        me = at.get(key, len(others) + i)
        for j in np.flatnonzero(common >= least).tolist():
            if j != me and _find(parent, j) != _find(parent, me) and aligned(x, others[j][1], int(least[j])):
                parent[_find(parent, j)] = _find(parent, me)
                yield i, j


def _block_task(similarity: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id", kind="stable")
        sides = []
        for rows in (part[part["lone"]], part[~part["lone"]]):
            sides.append([(d, np.frombuffer(x, "<u4")) for d, x in zip(rows["doc_id"], rows["shingles"])])
        out = []
        if sides[0] and sides[1]:
            matched = part.loc[~part["lone"], "similar"].tolist()
            out = [(sides[0][i][0], sides[1][j][0]) for i, j in block_links(*sides, matched, similarity)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    return run


def _shingled(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the rows (doc_id, digest, node) that are wanted of (doc_id, digest, text).

    Whole texts stay where they are: the rows that may be wanted are known by a bitmap, and
    their shingles are joined.
    """
    key = F.xxhash64("doc_id", "digest")
    maybe = parted(texts, key, slot_words(wanted, key))[1]
    shingles = (maybe.mapInArrow(_shingle_task(k), "doc_id long, digest string, shingles binary")
                .groupBy("doc_id", "digest").agg(F.any_value("shingles").alias("shingles")))
    return shingles.join(wanted, ["doc_id", "digest"]).select("node", "shingles")


def near_links(texts: DataFrame, buckets: DataFrame, k: int, similarity: float,
               block: int = 4096) -> DataFrame:
    """(a, b): links whose components are the near-duplicate classes.

    ``buckets`` has (bucket, doc_id), ``texts`` (doc_id, text), ids being unique.  ``block``
    is the number of texts that one side of a block holds, about.
    """
    keyed = texts.select("doc_id", F.md5("text").alias("digest"), "text")

    def shingles(ids):
        wanted = keyed.select("doc_id", "digest", F.col("doc_id").alias("node")).join(ids, "doc_id", "left_semi")
        return _shingled(keyed, wanted, k).withColumnRenamed("node", "doc_id")
    return _links(buckets, shingles, similarity, block)


def _links(buckets: DataFrame, shingled, similarity: float, block: int) -> DataFrame:
    """``near_links``; ``shingled`` gives (doc_id, shingles) of some (doc_id)."""
    spark = buckets.sparkSession

    def stored(df, name):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    centres = stored(buckets.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last"))
                     .filter("centre <> last").select("bucket", "centre"), "centres")
    pairs = stored(buckets.join(centres, "bucket").filter("doc_id <> centre")
                   .select("doc_id", "centre").distinct(), "pairs")
    ids = stored(pairs.select("doc_id").unionByName(pairs.select(F.col("centre").alias("doc_id"))).distinct(), "ids")
    shingles = stored(shingled(ids), "shingles")
    verdicts = stored(
        pairs.join(shingles.select("doc_id", F.col("shingles").alias("sa")), "doc_id")
        .join(shingles.select(F.col("doc_id").alias("centre"), F.col("shingles").alias("sb")), "centre")
        .select(F.col("doc_id").alias("a"), F.col("centre").alias("b"), "sa", "sb")
        .mapInArrow(_verify_task(similarity), "a long, b long, similar boolean"), "verdicts")

    mates = verdicts.select(F.col("a").alias("doc_id"), F.col("b").alias("centre"), "similar")
    sizes = stored(mates.groupBy("centre").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"),
        F.ceil(F.count_if(~F.col("similar")) / block).cast("int").alias("lone_blocks"))
        .filter("lone_blocks > 0"), "blocks")
    mates = mates.join(sizes, "centre").join(shingles, "doc_id")
    mine = F.xxhash64("doc_id")
    dealt = mates.select(
        "doc_id", "centre", "similar", "shingles", F.lit(False).alias("lone"),
        F.pmod(mine, "blocks").cast("int").alias("x"),
        F.explode(F.sequence(F.lit(0), F.col("lone_blocks") - 1)).alias("u")).unionByName(
        mates.filter("NOT similar").select(
            "doc_id", "centre", "similar", "shingles", F.lit(True).alias("lone"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"),
            F.pmod(mine, "lone_blocks").cast("int").alias("u")))
    rest = dealt.groupBy("centre", "x", "u").applyInPandas(_block_task(similarity), "a long, b long")
    return verdicts.filter("similar").select("a", "b").unionByName(rest)


def text_classes(texts: DataFrame, k: int = 5, similarity: float = 0.8, sketches: int = 24, order: int = 4,
                 block: int = 4096) -> DataFrame:
    """(digest, first_id, class_id): a row for each different text of ``texts`` (doc_id, digest,
    text); ``first_id`` is the least id that has the text, ``class_id`` that of its class."""
    spark = texts.sparkSession
    path = scratch_path(spark, "order-minhash")
    (texts.mapInArrow(_sketch_task(k, sketches, order),
                      "doc_id long, digest string, n int, buckets array<long>")
     .groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("buckets").alias("buckets"))
     # texts are named by a number of their own, as several may share an id
     .withColumn("node", F.monotonically_increasing_id()).write.parquet(path))
    one = spark.read.parquet(path)
    buckets = one.select(F.col("node").alias("doc_id"), F.explode("buckets").alias("bucket"))

    def shingles(ids):
        wanted = one.select("doc_id", "digest", "node").join(ids.withColumnRenamed("doc_id", "node"), "node", "left_semi")
        return _shingled(texts, wanted, k).withColumnRenamed("node", "doc_id")
    links_path = scratch_path(spark, "near-links")
    _links(buckets, shingles, similarity, block).write.parquet(links_path)
    roots = one.select("digest", "doc_id", "node").join(components(spark.read.parquet(links_path)), "node", "left")
    roots = roots.withColumn("root", F.coalesce("root", "node"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("id"), F.min("digest").alias("least"))
    # where classes share their least id, one is named by it and the others by a number of their own
    owner = least.groupBy("id").agg(F.min("least").alias("owner"))
    least = least.join(owner, "id").select("root", F.when(F.col("least") == F.col("owner"), F.col("id"))
                                           .otherwise(-1 - F.col("root")).alias("class_id"))
    classes_path = scratch_path(spark, "classes")
    (roots.join(least, "root").select("digest", F.col("doc_id").alias("first_id"), "class_id")
     .write.parquet(classes_path))
    return spark.read.parquet(classes_path)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    similarity: float = 0.8, sketches: int = 24, order: int = 4) -> DataFrame:
    """(doc_id, class_id): one row per row of ``docs``; class_id is the least id of the class.

    Copies (equal whole texts, empty ones too) are of one class.  A text of fewer than ``k``
    words is linked to its copies only; a null text, or a row without an id, is alone in its
    class (class_id = doc_id).  Rows repeated under one id with different texts have the
    classes of their texts each; of classes that share their least id all but one are named
    by negative numbers.  Further columns are ignored; an empty table gives no rows.  Texts
    are read whole, about a megabyte (or one longer text) at a time.

    At similarity 0.8 a pair shares a bucket of one sketch with probability about 0.8 **
    order, so it escapes all 24 sketches of order 4 with probability 3e-6.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = texts.filter("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("digest", F.md5("text"))
    classes = text_classes(keyed, k, similarity, sketches, order)
    named = keyed.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id")
    rest = texts.filter("doc_id IS NULL OR text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return named.unionByName(rest)
