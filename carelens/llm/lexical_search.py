"""Ranked lexical search: the best documents of each query item, by document FP-trees.

A document is restricted to the terms that some item asks for and written as a path, its
terms by falling document frequency; documents share the beginnings of their paths, so a
chunk of documents is one FP-tree.  Paths without a fork are one edge, and small sibling
subtrees are kept together as one leaf.  Every node knows, for all documents below it, the
largest tf of each term and the smallest m.  A term's part of the score rises with tf and
falls with m, so the score of that pair bounds the subtree.  Each item walks the trees depth
first, the child of the highest bound first, and leaves out every subtree whose bound is
under its k-th best score so far; documents of the leaves it reaches are scored exactly.

The documents are the large side.  One scan turns them into restricted vectors, which are
written; the statistics are aggregates over these, and the search reads them once.  A task
builds trees of at most ``_TREE_DOCS`` documents, one at a time, and carries the best k of
each item from tree to tree; k rows per item and task are shuffled.  Items are taken in
blocks of about ``block_terms`` terms, whose dictionary is broadcast: more items make more
blocks (further scans), not a larger broadcast.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import scratch_path
from .words import STEP_BYTES, Words, text_buffers

_TREE_DOCS = 8192
_TREE_ENTRIES = 1 << 21
_LEAF_DOCS = 32
_SLOTS = 1 << 22
_NO_ID = np.iinfo(np.int64).max

#: Bytes of terms as they are compared (A-Z as a-z), all others as a space.
_TERM_BYTES = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM_BYTES[_lo:_hi] = np.arange(_lo, _hi)
_TERM_BYTES[0x41:0x5B] += 0x20

VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
_VECTORS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                      ("tfs", pa.list_(pa.int32()))])
FOUND = "item int, item_id long, doc_id long, score long"
_FOUND = pa.schema([("item", pa.int32())] + [(c, pa.int64()) for c in ("item_id", "doc_id", "score")])


def terms_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The terms of some texts: runs of letters, digits and anything beyond ASCII."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    return Words(_TERM_BYTES[data[lo:hi]], offsets - lo)


class Dictionary:
    """The distinct terms of a block of items, and each item's terms with their numbers."""

    def __init__(self, items: Words):
        self.names, term = np.unique(items.name, return_inverse=True)
        self.slot = np.zeros(_SLOTS, bool)
        self.slot[(self.names >> np.uint64(42)).astype(np.int64)] = True
        self.items = [np.unique(term[a:b], return_counts=True) for a, b in zip(items.first[:-1], items.first[1:])]

    def vectors(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, tf) of the terms that the dictionary has, by text and term."""
        at = np.flatnonzero(self.slot[(words.name >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.names):
            return (np.zeros(0, np.int64),) * 3
        term = np.minimum(np.searchsorted(self.names, words.name[at]), len(self.names) - 1)
        same = self.names[term] == words.name[at]
        text = np.searchsorted(words.first, at[same], side="right") - 1
        key, tf = np.unique(text * len(self.names) + term[same], return_counts=True)
        return key // len(self.names), key % len(self.names), tf


def _vector_task(shared):
    def run(batches):
        dictionary = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            row = 0
            while row < batch.num_rows:
                end = int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, side="right")) - 1
                end = min(max(end, row + 1), batch.num_rows)
                words = terms_of(data, offsets[row:end + 1])
                text, term, tf = dictionary.vectors(words)
                n = words.counts()
                live = np.flatnonzero(n)
                first = np.searchsorted(text, np.append(live, end - row)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (term, tf)]
                ids = batch.column("doc_id").slice(row, end - row).take(pa.array(live))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n[live].astype(np.int64)), *lists], schema=_VECTORS)
                row = end
    return run


def _rows(ptr: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


class Entries:
    """Rows of (term, tf) with an m each: documents, or nodes as bounds of their documents."""

    def __init__(self, ptr, term, tf, m):
        self.ptr, self.term, self.tf, self.m, self.row = ptr, term, tf, m, _rows(ptr)

    def scores(self, weight: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Sum over the terms of rows lo to hi of weight * ((10^9 tf) div (1000 tf + 8 m))."""
        part = slice(self.ptr[lo], self.ptr[hi])
        w = weight[self.term[part]]
        hit = np.flatnonzero(w)
        at = hit + part.start
        row, tf = self.row[at], self.tf[at].astype(np.int64)
        out = np.zeros(hi - lo, np.int64)
        np.add.at(out, row - lo, w[hit] * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[row])))
        return out


class FPTree:
    """The FP-tree of a chunk of restricted vectors; terms are named by their frequency rank."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, ptr: np.ndarray, rank: np.ndarray, tf: np.ndarray):
        order = np.lexsort((rank, _rows(ptr)))
        rank, tf = rank[order], tf[order]
        path = rank.astype(">u4").tobytes()
        ends = (4 * ptr).tolist()
        place = sorted(range(len(ids)), key=lambda i: path[ends[i]:ends[i + 1]])
        size = np.diff(ptr)[place]
        new = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(new[-1]) - np.repeat(new[:-1], size) + np.repeat(ptr[:-1][place], size)
        self.ids = ids[place]
        self.docs = Entries(new, rank[take], tf[take], m[place])
        self._fork()
        self._summarise()

    def _shared(self) -> np.ndarray:
        """[i]: the number of terms that the paths of documents i - 1 and i share."""
        ptr, term = self.docs.ptr, self.docs.term
        out = np.zeros(len(self.ids) + 1, np.int64)
        for i in range(1, len(self.ids)):
            a, b = term[ptr[i - 1]:ptr[i]], term[ptr[i]:ptr[i + 1]]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            first = int(differ.argmax()) if n else 0
            out[i] = first if n and differ[first] else n
        return out

    def _fork(self):
        """Nodes by level: the document range, parent and child range of each."""
        shared, size = self._shared(), np.diff(self.docs.ptr)
        lo, hi, parent, level, child = [0], [len(self.ids)], [0], [0], []
        for node in range(1 << 62):
            if node == len(lo):
                break
            a, b = lo[node], hi[node]
            fork = shared[a + 1:b]
            depth = int(fork.min()) if len(fork) else 0
            child.append((len(lo), len(lo)))
            if b - a <= _LEAF_DOCS or depth == size[a] == size[b - 1] and fork.max() == depth:
                continue                                     # few documents, or all on one path
            cuts = [a, *(np.flatnonzero(fork == depth) + a + 1).tolist(), b]
            start = a
            for x, y in zip(cuts[:-1], cuts[1:]):
                # small subtrees side by side make one leaf
                if y - start > _LEAF_DOCS and start < x:
                    lo.append(start)
                    hi.append(x)
                    start = x
                if y - start > _LEAF_DOCS or y == b:
                    lo.append(start)
                    hi.append(y)
                    start = y
            parent += [node] * (len(lo) - len(parent))
            level += [level[node] + 1] * (len(lo) - len(level))
            child[node] = (child[node][0], len(lo))
        self.lo, self.hi, self.parent, self.level, self.child = lo, hi, np.array(parent), np.array(level), child

    def _summarise(self):
        """The largest tf of every term and the smallest m below each node, leaves first."""
        width = int(self.docs.term.max()) + 1 if len(self.docs.term) else 1
        leaf = np.array([a == b for a, b in self.child])
        which = np.flatnonzero(leaf)[np.argsort(np.array(self.lo)[leaf], kind="stable")]
        of = np.repeat(which, np.array(self.hi)[which] - np.array(self.lo)[which])     # of each document
        m = np.full(len(self.lo), np.iinfo(np.int64).max)
        np.minimum.at(m, of, self.docs.m)
        key, tf = of[self.docs.row] * width + self.docs.term, self.docs.tf
        order = np.argsort(self.level[of[self.docs.row]], kind="stable")
        key, tf = key[order], tf[order]
        cut = np.searchsorted(self.level[key // width], np.arange(int(self.level.max()) + 2))
        parts, up = [], (key[:0], tf[:0])
        for depth in range(int(self.level.max()), -1, -1):
            own = slice(cut[depth], cut[depth + 1])
            here = _largest(np.append(up[0], key[own]), np.append(up[1], tf[own]))
            parts.append(here)
            if depth:
                nodes = np.flatnonzero(self.level == depth)
                np.minimum.at(m, self.parent[nodes], m[nodes])
                up = self.parent[here[0] // width] * width + here[0] % width, here[1]
        key, tf = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
        ptr = np.searchsorted(key, np.arange(len(self.lo) + 1) * width)
        self.nodes = Entries(ptr, key % width, tf, m)

    def search(self, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int):
        """The best k of ``best`` (scores, ids; best first) and this tree's documents."""
        scores, ids = best
        stack = [(_NO_ID, 0)]
        while stack:
            bound, node = stack.pop()
            least = int(scores[-1]) if len(scores) == k else 1
            if bound < least:
                continue
            first, end = self.child[node]
            if first == end:
                lo, hi = self.lo[node], self.hi[node]
                found = self.docs.scores(weight, lo, hi)
                hit = np.flatnonzero(found >= least)
                if len(hit):
                    scores, ids = np.append(scores, found[hit]), np.append(ids, self.ids[lo + hit])
                    order = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[order], ids[order]
            else:
                bounds = self.nodes.scores(weight, first, end)
                go = np.flatnonzero(bounds >= least)
                go = go[np.argsort(bounds[go], kind="stable")]
                stack += zip(bounds[go].tolist(), (first + go).tolist())
        return scores, ids


def _largest(key: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry for each key, with its largest tf."""
    if not len(key):
        return key, tf
    order = np.argsort(key, kind="stable")
    key, tf = key[order], tf[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start], np.maximum.reduceat(tf, start)


def _chunks(batches, rank: np.ndarray):
    """(ids, n, ptr, rank, tf) of bounded chunks of vectors; documents without a term are left out."""
    held, docs, entries = [], 0, 0

    def joined():
        ids, n, size, term, tf = (np.concatenate(x) for x in zip(*held))
        return ids, n, np.concatenate([[0], np.cumsum(size)]), term, tf

    for batch in batches:
        size = np.diff(batch.column("terms").offsets.to_numpy()).astype(np.int64)
        term, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
        ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
        n = batch.column("n").to_numpy()
        live = size > 0
        ids, n, size, at, row = ids[live], n[live], size[live], 0, 0
        ends = np.cumsum(size)
        while row < len(size):
            end = int(np.searchsorted(ends, at + _TREE_ENTRIES - entries, side="right"))
            end = min(max(end, row + 1), row + _TREE_DOCS - docs, len(size))
            stop = int(ends[end - 1])
            held.append((ids[row:end], n[row:end], size[row:end], rank[term[at:stop]], tf[at:stop]))
            docs, entries, row, at = docs + end - row, entries + stop - at, end, stop
            if docs >= _TREE_DOCS or entries >= _TREE_ENTRIES:
                yield joined()
                held, docs, entries = [], 0, 0
    if held:
        yield joined()


def _search_task(shared, k: int):
    def run(batches):
        items, item_ids, rank, docs, length = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        for ids, n, ptr, term, tf in _chunks(batches, rank):
            tree = FPTree(ids, 25 + 75 * n * docs // length, ptr, term, tf)
            weight = np.zeros(len(rank) + 1, np.int64)
            for i, (terms, w) in enumerate(items):
                weight[rank[terms]] = w
                best[i] = tree.search(weight, best[i], k)
                weight[rank[terms]] = 0
        rows = [len(s) for s, _ in best]
        if sum(rows):
            scores, found = (np.concatenate(x) for x in zip(*best))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(items), dtype=np.int32), rows)),
                 pa.array([item_ids[i] for i, r in enumerate(rows) for _ in range(r)], pa.int64()),
                 pa.array(found, mask=found == _NO_ID), pa.array(scores)], schema=_FOUND)
    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", block_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, best first.

    Terms are runs of letters, digits and code points beyond ASCII, A-Z as a-z.  Over all
    documents, N have a term and hold L terms together.  A term of document frequency df
    weighs floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has m = 25 + 75 n N div
    L; its score sums weight * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats
    included.  Only scores above 0 count; equal scores rank by id, rows without an id last.

    Every row of either table is a document or an item of its own, repeated ones too.  Null
    and empty texts have no term; empty tables give no rows; further columns are ignored.
    Texts are read whole, about a megabyte (or one longer text) at a time.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    total = asked.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "[^0-9A-Za-z\x80-\U0010ffff]+")))) \
        .collect()[0][0] or 0
    blocks = max(1, -(-total // block_terms))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = []
    for b in range(blocks):
        rows = asked.filter(block == b).toArrow().combine_chunks()
        ids = rows.column("item_id").to_pylist()
        text = pa.chunked_array(rows.column("text").chunks, pa.string()).combine_chunks()
        dictionary = Dictionary(terms_of(*text_buffers(text)))
        shared = spark.sparkContext.broadcast(dictionary)
        path = scratch_path(spark, "term-vectors")
        texts.mapInArrow(_vector_task(shared), VECTORS).write.parquet(path)
        vectors = spark.read.parquet(path)
        n_docs, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).collect()[0]
        df = np.zeros(len(dictionary.names), np.int64)
        # a row for each term of the block at most
        for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        rank = np.empty(len(df), np.int64)
        rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
        query = [(terms, weight[terms] * times) for terms, times in dictionary.items]
        shared = spark.sparkContext.broadcast((query, ids, rank, n_docs, length or 1))
        found = vectors.mapInArrow(_search_task(shared, k), FOUND)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        parts.append(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                     .select("item_id", "rank", "doc_id", "score"))
    return functools.reduce(DataFrame.unionByName, parts)
