"""Substring deduplication by recompression.

Recompression rewrites every text, as a sequence of word names, in rounds.  A round names
each maximal run of one symbol, then each adjacent pair whose left symbol falls in the
"left" half of the alphabet and whose right symbol in the "right" half (a bit of the
symbol's name decides, salted by the round).  A name is a fixed 64-bit function of what
it stands for, so all tasks give equal runs and pairs equal names and a round needs no
shuffle.  Whether a symbol arises depends on few neighbours; the words it depends on are
its *support*.  Two equal substrings therefore hold the same symbols wherever the support
lies inside the substring, whatever stands around them.

Each window of ``width`` words picks, among the symbols whose support it holds, one of the
highest level (the least name on ties): its *anchor*.  Equal windows pick equal anchors, so repeats are found
among equal anchors only, and consecutive windows with one anchor make one row (a
*stretch*) in place of ``width`` rows:

1. anchors named in two or more documents survive (aggregate, then a join);
2. equal stretches settle all their windows at once: every document but the smallest one
   with that stretch loses it;
3. only where an anchor has several different stretches are single windows compared, and
   only those of the first document of each stretch.

Windows and stretches are compared by two independent 64-bit names (anchor and content).
Every task first settles the equal rows it holds itself and sends on only those of its
smallest document (``gone`` marks the others), so a passage that a third of all documents
share is shuffled once per task, not once per document.  An anchor that stands in many
different surroundings stays frequent; its join reads two written tables, which adaptive
execution can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .words import Rolling, join_names, mix, signed, steps

_FAR = np.int64(1) << np.int64(40)
ROWS = "anchor long, content long, doc_id long, who long, at int, n int, gone boolean"
#: Rows that a task holds to settle equal ones among them.
SETTLED_ROWS = 1_000_000
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


class _Level:
    """Symbols of one level over several texts; texts are parted by a wall symbol."""

    def __init__(self, name, lo, hi, wall):
        self.name, self.lo, self.hi, self.wall = name, lo, hi, wall

    @classmethod
    def of_words(cls, names: np.ndarray, first: np.ndarray) -> "_Level":
        n, docs = len(names), len(first) - 1
        place = np.arange(n) + np.repeat(np.arange(docs), np.diff(first)) + 1
        size = n + docs + 1
        name, wall = np.zeros(size, np.uint64), np.ones(size, bool)
        lo, hi = np.full(size, -_FAR), np.full(size, _FAR)
        name[place], wall[place] = names, False
        lo[place], hi[place] = np.arange(n), np.arange(n) + 1
        return cls(name, lo, hi, wall)

    def runs(self) -> "_Level":
        """Name maximal runs; a symbol's end shows only in its neighbours' support."""
        begin = np.ones(len(self.name), bool)
        begin[1:] = (self.name[1:] != self.name[:-1]) | self.wall[1:] | self.wall[:-1]
        at = np.flatnonzero(begin)
        size = np.diff(np.append(at, len(begin)))
        name = self.name[at].copy()
        many = size > 1
        name[many] = join_names(name[many], size[many].astype(np.uint64))
        left, right = np.maximum(at - 1, 0), np.minimum(at + size, len(begin) - 1)
        wall = self.wall[at]
        lo = np.where(wall, -_FAR, self.lo[left])
        hi = np.where(wall, _FAR, self.hi[right])
        return _Level(name, lo, hi, wall)

    def pairs(self, round_no: int) -> "_Level":
        """Name adjacent (left half, right half) pairs; others stay."""
        right_half = (mix(self.name ^ np.uint64(0x51ED2701 + round_no)) >> np.uint64(63)).astype(bool)
        n = len(self.name)
        head = np.zeros(n, bool)
        head[:-1] = (~right_half[:-1] & right_half[1:] & ~self.wall[:-1] & ~self.wall[1:])
        tail = np.zeros(n, bool)
        tail[1:] = head[:-1]
        nxt, prev = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
        # a single symbol stays because its right (left half) or left (right half)
        # neighbour did not match; a pair depends on its own two symbols only
        lo = np.where(head, self.lo, np.where(right_half, self.lo[prev], self.lo))
        hi = np.where(head | ~right_half, self.hi[nxt], self.hi)
        name = self.name.copy()
        at = np.flatnonzero(head)
        name[at] = join_names(self.name[at], self.name[at + 1])
        lo[self.wall], hi[self.wall] = -_FAR, _FAR
        keep = ~tail
        return _Level(name[keep], lo[keep], hi[keep], self.wall[keep])


def _least(name: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Index of the least name in each slice [start, end), the first one on ties."""
    best = np.zeros(len(start), np.int64)
    table, step = np.arange(len(name)), 1
    size = end - start
    while True:
        here = (size >= step) & (size < 2 * step)
        a, b = table[start[here]], table[end[here] - step]
        best[here] = np.where(name[b] < name[a], b, a)
        if not (size >= 2 * step).any():
            return best
        a, b = table[:-step], table[step:]
        table, step = np.where(name[b] < name[a], b, a), 2 * step


def _anchors(names: np.ndarray, first: np.ndarray, width: int):
    """(level, symbol, support start, support end) of every window start, else level -1.

    Symbols whose support exceeds a third of the window are left out: they would fit only
    few windows each.  A narrow symbol of a high level is rare, so many windows share it.
    """
    n = len(names)
    start = np.arange(n)
    open_ = start[start + width <= np.repeat(first[1:], np.diff(first))]
    level = np.full(n, -1, np.int32)
    symbol = np.zeros(n, np.uint64)
    lo, hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack = []
    now = _Level.of_words(names, first)
    r = 0
    while True:
        fit = (now.hi - now.lo <= max(1, width // 3)) & ~now.wall
        if not fit.any():
            break
        stack.append((now.name[fit], now.lo[fit], now.hi[fit]))
        r += 1
        now = now.runs().pairs(r)
    for r in range(len(stack) - 1, -1, -1):
        if not len(open_):
            break
        name, left, right = stack[r]
        i = np.searchsorted(left, open_)
        j = np.searchsorted(right, open_ + width, side="right")
        ok = j > i
        got, i, j = open_[ok], i[ok], j[ok]
        if len(got):
            i = _least(mix(name), i, j)
            level[got], symbol[got], lo[got], hi[got] = r, name[i], left[i], right[i]
        open_ = open_[~ok]
    return level, symbol, lo, hi


def _window_names(words, width: int):
    """(roll, starts, anchor name per start, index of each stretch's first start)."""
    roll = Rolling(words.name)
    level, symbol, lo, hi = _anchors(words.name, words.first, width)
    starts = np.flatnonzero(level >= 0)
    anchor = join_names(symbol[starts], roll.of(lo[starts], hi[starts]))
    anchor = mix(anchor + level[starts].astype(np.uint64))
    fresh = np.ones(len(starts), bool)
    if len(starts):
        fresh[1:] = ((np.diff(starts) != 1) | (anchor[1:] != anchor[:-1])
                     | (lo[starts][1:] != lo[starts][:-1]))
    return roll, starts, anchor, np.flatnonzero(fresh)


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)


_ROW_SCHEMA = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()),
                         ("who", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("gone", pa.bool_())])
_RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                            ("kept_text", pa.string())])


def _settle(parts: list) -> pa.RecordBatch:
    """Rows (anchor, content, doc_id, who, at, n) with ``gone``: a smaller document here has it."""
    anchor, content, doc, who, at, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((doc, content, anchor))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(anchor[order]) != 0) | (np.diff(content[order]) != 0)
    begin = np.flatnonzero(fresh)
    least = np.repeat(doc[order][begin], np.diff(np.append(begin, len(order))))
    gone = np.empty(len(order), bool)
    gone[order] = doc[order] > least
    return _rows(_ROW_SCHEMA, anchor, content, doc, who, at.astype(np.int32), n.astype(np.int32), gone)


def _settled(parts):
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= SETTLED_ROWS:
            yield _settle(held)
            held, size = [], 0
    if size:
        yield _settle(held)


def _anchor_task(width: int):
    """Stretches of windows with one anchor: ``at`` is the first window, ``n`` how many."""
    def rows(batches):
        for batch, words in steps(batches):
            roll, starts, anchor, fresh = _window_names(words, width)
            if not len(fresh):
                continue
            n = np.diff(np.append(fresh, len(starts)))
            at = starts[fresh]
            doc = np.searchsorted(words.first, at, side="right") - 1
            yield (signed(anchor[fresh]), signed(roll.of(at, at + n + (width - 1))),
                   batch.column("doc_id").to_numpy()[doc], batch.column("who").to_numpy()[doc],
                   at - words.first[doc], n)
    return lambda batches: _settled(rows(batches))


def _window_task(width: int):
    """Single windows of the listed stretches: rows carry ``spans`` = [(at, n)]."""
    def rows(batches):
        for batch, words in steps(b.filter(b.column("spans").is_valid()) for b in batches):
            roll, starts, anchor, _ = _window_names(words, width)
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                base = words.first[row]
                at = np.unique(np.concatenate([np.arange(s["at"], s["at"] + s["n"]) for s in spans])) + base
                i = np.searchsorted(starts, at)
                yield (signed(anchor[i]), signed(roll.of(at, at + width)),
                       np.full(len(at), batch.column("doc_id")[row].as_py(), np.int64),
                       np.full(len(at), batch.column("who")[row].as_py(), np.int64),
                       at - base, np.full(len(at), width))
    return lambda batches: _settled(rows(batches))


def _cut_task(batches):
    for batch in batches:
        ids, texts, cuts = (batch.column(c) for c in ("doc_id", "text", "spans"))
        out = [], [], []
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or "").encode().split()
            n = len(words)
            if cuts[i].is_valid:
                edge = np.zeros(n + 1, np.int64)
                for s in cuts[i].as_py():
                    edge[min(s["at"], n)] += 1
                    edge[min(s["at"] + s["n"], n)] -= 1
                words = [words[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            for column, value in zip(out, (n, n - len(words), b" ".join(words).decode())):
                column.append(value)
        if batch.num_rows:
            yield _rows(_RESULT_SCHEMA, ids, *out)


def _per_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "who").agg(F.collect_list(F.struct("at", "n")).alias("spans"))


def substring_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Remove each word covered by a ``width``-word window that a smaller document holds.

    Returns (doc_id, n_words, n_removed, kept_text), one row per input row; kept words are
    joined by one space.
    Windows are judged on the input.  A null or empty text has no words; a text shorter
    than ``width`` loses nothing; a row without an id takes no part and keeps all words;
    rows that share an id count as one document, whose windows do not remove one another, each
    row being cut by its own text.  Repeats inside one document stay.  Further columns are
    ignored; an empty table gives no rows.  Long texts are read whole, in time linear in
    their length.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .withColumn("who", F.xxhash64("text"))
    stretches = stored(texts.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
                       .mapInArrow(_anchor_task(width), ROWS), "stretches")
    last = F.lit(width - 1)
    cut_early = stretches.filter("gone").select("doc_id", "who", "at", (F.col("n") + last).alias("n"))

    open_ = stretches.filter("NOT gone").drop("gone")
    shared = stored(open_.groupBy("anchor").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"),
        (F.min("content") != F.max("content")).alias("several")).filter("a <> b").drop("a", "b"), "anchors")
    live = stored(open_.join(shared, "anchor"), "shared-stretches")
    first = live.groupBy("anchor", "content").agg(F.min("doc_id").alias("first_doc"))
    judged = live.join(first, ["anchor", "content"])
    cut_whole = judged.filter("first_doc < doc_id").select("doc_id", "who", "at", (F.col("n") + last).alias("n"))
    single = judged.filter("first_doc = doc_id AND several").select("doc_id", "who", "at", "n")

    # rows already settled need no partner: each gets a key of its own, found nowhere
    windows = texts.join(_per_document(single), ["doc_id", "who"], "left").mapInArrow(_window_task(width), ROWS)
    earliest = (windows.filter("NOT gone").groupBy("anchor", "content")
                .agg(F.min("doc_id").alias("first_doc")))
    spread = windows.withColumn("anchor", F.when(F.col("gone"), F.xxhash64("doc_id", "who", "at"))
                                .otherwise(F.col("anchor")))
    cut_single = (spread.join(earliest, ["anchor", "content"], "left")
                  .filter("gone OR first_doc < doc_id").select("doc_id", "who", "at", "n"))
    cuts = _per_document(cut_early.unionByName(cut_whole).unionByName(cut_single))
    return texts.join(cuts, ["doc_id", "who"], "left").mapInArrow(_cut_task, RESULT)
