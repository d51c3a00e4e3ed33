"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words: it hashes the words under its ones and
ignores those under its zeros, so a substituted word under a zero does not hide a hit.
Test items and documents are hashed with the same masks and joined on the seed hash; every
hit names an alignment (document, item, diagonal), which is verified by comparing words
along the diagonal around the hit, mismatches allowed.

A mask can miss a short item with several substitutions, so items of up to ``SHORT`` words
have further seeds: with at most m words unmatched, one of m + 1 parts side by side is whole.
Each part is a seed at its fixed place in the item, so no allowed placement is missed.

Words are compared without case and without punctuation or symbols at their ends; inside a
word any such sign counts as any other.  Positions are those of the words as written.

The documents are the large side: they are scanned once for each block of test items and
nothing of them is shuffled.  A block holds about ``block_words`` words of test items,
whose seed table is broadcast; more items make more blocks (further scans), not a larger
broadcast.  So a passage in a third of all documents costs its own verification only.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .slots import parted, slot_words
from .words import Words, mix, steps, text_buffers

#: Fixed masks: 6 compared and 3 ignored positions each.
MASKS = ("110100111", "111001011", "101110101", "110011011")
SPAN = 9
#: Items of up to this many words are seeded by parts too.
SHORT = 16
#: Items shorter than SPAN are compared whole; items of fewer words than this are never matched.
LEAST_WORDS = 5
_MISMATCH = 4          # a mismatch needs this many matches beside it: at least 80 % identity
_SLOTS = 1 << 22
_DOT = ord(".")

OVERLAPS = ("doc_id long, item_id long, doc_start int, doc_end int, item_start int, "
            "n_overlap int, n_matched int")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())]
                    + [(c, pa.int32()) for c in ("doc_start", "doc_end", "item_start", "n_overlap", "n_matched")])


def folded(batches):
    """The batches with lower-case texts and ``.`` for every run of punctuation or symbols.

    No white space comes or goes, so every word keeps its position.
    """
    for batch in batches:
        text = pc.replace_substring_regex(pc.utf8_lower(batch.column("text")), r"[\p{P}\p{S}]+", ".")
        yield batch.set_column(batch.schema.get_field_index("text"), "text", text)


def bare(words: Words) -> Words:
    """The words of folded texts without the ``.`` at their ends (a word of signs is empty)."""
    if len(words.start):
        words.start = words.start + (words.data[words.start] == _DOT)
        words.end = words.end - ((words.end > words.start) & (words.data[words.end - 1] == _DOT))
    return words


def _seeds(name: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at every position with ``len(mask)`` words to its right."""
    n = len(name) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, len(mask) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = (h + name[k:k + n]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


class SeedTable:
    """Seeds of one block of items: sorted hashes with the item and position of each."""

    def __init__(self, words: Words, ids: list):
        self.name, self.first, self.ids = words.name, words.first, ids
        count = words.counts()
        self.masks = list(MASKS)
        found = []
        for mask in MASKS:
            h = _seeds(self.name, mask)
            at = np.arange(len(h))
            item = np.searchsorted(self.first, at, side="right") - 1
            ok = at + SPAN <= self.first[item + 1]
            found.append((h[ok], item[ok], at[ok] - self.first[item[ok]]))
        for n in np.unique(count[(count >= LEAST_WORDS) & (count < SPAN)]):
            mask = "1" * int(n)
            self.masks.append(mask)
            item = np.flatnonzero(count == n)
            h = _seeds(self.name, mask)
            found.append((h[self.first[item]], item, np.zeros(len(item), np.int64)))
        parts: dict[int, list] = {}
        for n in np.unique(count[(count >= SPAN) & (count <= SHORT)]).tolist():
            item, parted = np.flatnonzero(count == n), n - -(-n * 4 // 5) + 1
            for i in range(parted):
                start, end = i * n // parted, (i + 1) * n // parted
                parts.setdefault(end - start, []).append((item, np.full(len(item), start)))
        for size, places in sorted(parts.items()):
            mask = "1" * size
            if mask not in self.masks:
                self.masks.append(mask)
            item, at = (np.concatenate(x) for x in zip(*places))
            found.append((_seeds(self.name, mask)[self.first[item] + at], item, at))
        h, self.item, self.at = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], self.item[order], self.at[order]
        self.slot = np.zeros(_SLOTS, bool)
        self.slot[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, words: Words) -> np.ndarray:
        """Distinct (document, item, diagonal) rows; diagonal = document - item position."""
        found = []
        ends = np.repeat(words.first[1:], words.counts())
        for mask in self.masks:
            h = _seeds(words.name, mask)
            at = np.flatnonzero(self.slot[(h >> np.uint64(42)).astype(np.int64)])
            at = at[at + len(mask) <= ends[at]]
            lo = np.searchsorted(self.hash, h[at], side="left")
            n = np.searchsorted(self.hash, h[at], side="right") - lo
            at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
            if not len(at):
                continue
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            at = np.repeat(at, n)
            doc = np.searchsorted(words.first, at, side="right") - 1
            found.append(np.stack([doc, self.item[k], at - words.first[doc] - self.at[k],
                                   self.at[k]], axis=1))
        if not found:
            return np.zeros((0, 4), np.int64)
        rows = np.concatenate(found)
        return rows[np.unique(rows[:, :3], axis=0, return_index=True)[1]]

    def overlap(self, words: Words, doc: int, item: int, diagonal: int, any_stretch: bool = True):
        """(document start, item start, overlap, matched) of the best stretch, word by word.

        ``any_stretch``: the stretch of the diagonal with the most matches at 80 % identity
        or more, that is with a score of 0 or more, a match counting 1 and a mismatch
        ``-_MISMATCH``; else the stretch with the highest score.  It begins and ends with a
        match.
        """
        a, b = self.name[self.first[item]:self.first[item + 1]], words.name[words.first[doc]:words.first[doc + 1]]
        lo, hi = max(0, -diagonal), min(len(a), len(b) - diagonal)
        same = a[lo:hi] == b[lo + diagonal:hi + diagonal]
        total = np.concatenate([[0], np.cumsum(np.where(same, 1, -_MISMATCH))])
        low = np.minimum.accumulate(total)
        if any_stretch:
            # a stretch can only gain by starting at a new low; it ends at the last total no lower
            matches = np.concatenate([[0], np.cumsum(same)])
            starts = np.flatnonzero(np.concatenate([[True], low[1:] < low[:-1]]))
            high = np.maximum.accumulate(total[::-1])[::-1]
            ends = np.searchsorted(-high, -total[starts], side="right") - 1
            best = int(np.argmax(matches[ends] - matches[starts]))
            inside = np.flatnonzero(same[starts[best]:ends[best]]) + starts[best]
            start, end = (int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0)
        else:
            end = int(np.argmax(total - low))
            start = int(np.flatnonzero(total[:end + 1] == low[end])[-1])
        return lo + start + diagonal, lo + start, end - start, int(same[start:end].sum())


def _task(table, min_words: int, any_stretch: bool):
    def run(batches):
        seeds = table.value
        for batch, words in steps(folded(batches)):
            words = bare(words)
            out = []
            ids = batch.column("doc_id")
            for doc, item, diagonal, _ in seeds.hits(words).tolist():
                at, item_at, size, matched = seeds.overlap(words, doc, item, diagonal, any_stretch)
                n = int(seeds.first[item + 1] - seeds.first[item])
                if matched >= min(min_words, -(-n * 4 // 5)):
                    out.append((ids[doc].as_py(), seeds.ids[item], at, at + size, item_at, size, matched))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
    return run


def benchmark_overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", min_words: int = 13,
                       block_words: int = 1_000_000, any_stretch: bool = True) -> DataFrame:
    """Verified overlaps: (doc_id, item_id, doc_start, doc_end, item_start, n_overlap, n_matched).

    Positions count words.  An overlap is reported if at least ``min_words`` words match on
    one diagonal, or four fifths of a shorter item, at 80 % identity or more; one row per
    (document, item, diagonal).  Any stretch of the diagonal will do; without
    ``any_stretch`` only the one with the highest score (a match 1, a mismatch -4) is
    looked at.  Of items of up to 16 words every such overlap is found; one of a longer item
    is missed if no seed survives its substitutions.  Items of fewer than 9 words must match
    whole, items of fewer than 5 never match.

    Null or empty texts and items match nothing; null ids are carried; repeated rows are
    reported as often as they come; empty tables give no rows; further columns are ignored.
    Texts are read whole, about a megabyte (or one longer text) at a time.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    bench = bench.filter(F.col("text").isNotNull())
    size = F.size(F.split("text", r"[ \x09-\x0D]+"))
    total = bench.agg(F.sum(size)).collect()[0][0] or 0
    blocks = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    parts = []
    for k in range(blocks):
        rows = next(folded(bench.filter(block == k).toArrow().combine_chunks().to_batches()), None)
        words = bare(Words(*text_buffers(rows.column("text") if rows else pa.array([], pa.string()))))
        table = spark.sparkContext.broadcast(SeedTable(words, rows.column("item_id").to_pylist() if rows else []))
        parts.append(texts.mapInArrow(_task(table, min_words, any_stretch), OVERLAPS))
    return functools.reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **options) -> DataFrame:
    """The documents without a reported overlap, all columns.  Rows without an id stay; rows
    that share an id are judged each by its own text.

    Texts that are surely not among the reported ones are not moved.
    """
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    key = F.when(id_.isNotNull() & text.isNotNull(), F.xxhash64(id_, text))
    keyed = docs.select(key.alias("key"), text.alias("text"))
    path = scratch_path(docs.sparkSession, "leaks")
    (benchmark_overlaps(keyed, items, "key", **options).select(F.col("doc_id").alias("__leak"))
     .filter("__leak IS NOT NULL").distinct().write.parquet(path))
    leaks = docs.sparkSession.read.parquet(path)
    clean, some = parted(docs, key, slot_words(leaks, F.col("__leak")))
    return clean.unionByName(some.join(leaks.hint("merge"), key == leaks["__leak"], "left_anti"))
