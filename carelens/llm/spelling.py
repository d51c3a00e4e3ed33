"""Grouping of spelling variants by a bit-sliced position index.

The vocabulary is indexed by letter and position: bitset (p, c) marks the words whose
letter at position p is c.  A query word walks its letters once.  A zero-error set and three
one-error sets (a letter replaced, one more in the word, one fewer) advance together by
AND and OR over whole bitsets; behind an inserted or deleted letter the index is read one
position to the right or to the left.  The walk runs for all words of a block at once, 64
index words to the machine word.

The index is cut into groups by what one error leaves alone.  A word of s letters has
pieces of ``_PIECE`` letters, the last one shorter; one error touches one piece, so two near
words agree before and behind it.  A group holds all words of s or s + 1 letters that agree
outside piece j, named by 128 bits of hash, and its index covers the few letters of the
piece.  Each near pair meets in one group: that of the piece where the words first
differ.  A group is bounded by the alphabet (that to the ``_PIECE + 1``), not by the
vocabulary, so a frequent word, prefix or ending makes no hot group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .words import Rolling, join_names, mix, signed

#: Maximal runs of letters; only A-Z change case.
LETTERS = r"A-Za-zÀ-ÿ"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of a piece.
_PIECE = 3
#: Letters in a slice: a piece, the inserted letter, two ends.
_WIDE = _PIECE + 3
#: Queries of a block, index words of a block.
_QUERIES, _INDEXED = 512, 4096
#: Letters of words that one step of a task expands.
_STEP_LETTERS = 1 << 18

ROWS = "k1 long, k2 long, id long, n long, a long, b long, longer boolean, last boolean"
_ROWS = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "id", "n", "a", "b")]
                  + [("longer", pa.bool_()), ("last", pa.bool_())])
NEAR = "id long, n_near long, best_n long, best_id long"
_NEAR = pa.schema([(c, pa.int64()) for c in ("id", "n_near", "best_n", "best_id")])


# ---------------------------------------------------------------- vocabulary
def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7,
               least_count: int = 2, misspell: int | None = None) -> DataFrame:
    """(word, n): the words of at least ``least_letters`` letters and their occurrences.

    Words are maximal runs of Latin letters (to U+00FF), A-Z in lower case.  ``misspell``
    deletes a letter of about one occurrence in that many, fixed by crc32 of ``id:word``: test
    errors with a known answer.  Null or empty texts have no word; a null id counts as an
    empty string there; repeated rows and ids count as often as they come; further columns
    are ignored; an empty table gives no rows.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike(r"[À-Þ]"), F.translate("run", _UPPER, _UPPER.lower())) \
        .otherwise(F.lower("run"))
    words = runs.select("id", lower.alias("word"))
    if misspell:
        at = (F.col("h") % F.length("word")).cast("int")
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word"))).select(
            F.when(F.col("h") % misspell == 0,
                   F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word"))))
            .otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


# ---------------------------------------------------------------- groups
def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins and the last ends."""
    text = words.to_pylist()
    first = np.concatenate([[0], np.cumsum([len(w) for w in text], dtype=np.int64)])
    return np.frombuffer("".join(text).encode("utf-32-le", "surrogatepass"), "<u4"), first


def _expanded(ids, ns, code: np.ndarray, first: np.ndarray, least: int) -> pa.RecordBatch:
    """A row for each (word, s, piece); s is the word's length or one less."""
    size = np.diff(first)
    word = np.concatenate([np.arange(len(size)), np.flatnonzero(size > least)])
    longer = np.arange(len(word)) >= len(size)
    s = size[word] - longer
    pieces = -(-s // _PIECE)
    row = np.repeat(np.arange(len(word)), pieces)
    j = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    word, longer, s = word[row], longer[row], s[row]
    begin, end = j * _PIECE, np.minimum((j + 1) * _PIECE, s)
    lo = first[word]
    tail = first[word + 1] - (s - end)                       # where the part behind the piece begins
    keys = []
    for seed in (1, 2):
        names = Rolling(mix(code.astype(np.uint64) + np.uint64(seed << 32)))
        outside = join_names(names.of(lo, lo + begin), names.of(tail, first[word + 1]))
        keys.append(signed(join_names(outside, (s * (1 << 32) + j).astype(np.uint64))))
    hole = np.zeros((len(row), 4), "<u4")
    for p in range(_PIECE + 1):
        at = lo + begin + p
        inside = at < tail
        hole[inside, p] = code[at[inside]]
    a, b = np.ascontiguousarray(hole).view("<i8").T
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(x)) for x in (*keys, ids[word], ns[word], a, b, longer, end == s)],
        schema=_ROWS)


def _group_task(least: int):
    def run(batches):
        for batch in batches:
            code, first = _letters(batch.column("word"))
            ids, ns = (batch.column(c).to_numpy() for c in ("id", "n"))
            row = 0
            while row < batch.num_rows:
                end = int(np.searchsorted(first, first[row] + _STEP_LETTERS, side="right")) - 1
                end = min(max(end, row + 1), batch.num_rows)
                part = slice(row, end)
                yield _expanded(ids[part], ns[part], code[first[row]:first[end]], first[row:end + 1] - first[row],
                                least)
                row = end
    return run


# ---------------------------------------------------------------- the index
class SlicedIndex:
    """Bitsets (position, letter) over some words, the first bit being the preferred word.

    ``code`` has one row of ``_WIDE`` letters for each word, 0 behind its end.
    """

    def __init__(self, code: np.ndarray, group: np.ndarray, longer: np.ndarray, n_letters: int):
        self.group, size = group, len(code)
        self.size, width = size, -(-size // 64) * 64
        bits = np.zeros((_WIDE, n_letters, width), bool)
        for p in range(_WIDE):
            bits[p, code[:, p], np.arange(size)] = True
        self.bits = self._packed(bits)
        self.longer = self._packed(np.append(longer, np.zeros(width - size, bool)))
        self.shorter = self._packed(np.append(~longer, np.zeros(width - size, bool)))

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view("<u8")

    def near(self, code, group, longer, last) -> np.ndarray:
        """Bitsets of the words of its group that are one error from each query."""
        same = np.zeros((len(code), self.shorter.size * 64), bool)
        same[:, :self.size] = group[:, None] == self.group
        zero = self._packed(same)
        replaced = np.zeros_like(zero)
        inserted, deleted = replaced.copy(), replaced.copy()
        length = (code > 0).sum(axis=1) - longer             # letters of the piece in the shorter word
        for p in range(_PIECE + 2):
            q = code[:, p]
            here, after = self.bits[p][q], self.bits[p + 1][q]
            # an error behind the piece belongs to the next group
            new = zero & ~here & -((p < length) | last).astype("<u8")[:, None]
            replaced = replaced & here | new
            inserted = (inserted | new) & after
            deleted = (deleted & self.bits[p - 1][q] if p else deleted) | new
            zero &= here
        return np.where(longer[:, None], deleted & self.shorter, replaced & self.shorter | inserted & self.longer)


def near_words(rows: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of some whole groups: its near words' number, and the best one's row or -1."""
    size = len(rows["id"])
    code = np.zeros((size, _WIDE), "<u4")
    code[:, :4] = np.stack([rows["a"], rows["b"]], axis=1).view("<u4")
    alphabet, code = np.unique(code, return_inverse=True)    # 0, the end, is the first
    code = code.reshape(size, _WIDE)
    start = np.concatenate([[True], (rows["k1"][1:] != rows["k1"][:-1]) | (rows["k2"][1:] != rows["k2"][:-1])])
    group = np.cumsum(start)
    count, best = np.zeros(size, np.int64), np.full(size, -1)
    order = np.lexsort((rows["id"], -rows["n"]))
    for x in range(0, size, _INDEXED):
        cols = order[x:x + _INDEXED]
        index = SlicedIndex(code[cols], group[cols], rows["longer"][cols], len(alphabet))
        for y in range(0, size, _QUERIES):
            part = slice(y, y + _QUERIES)
            found = index.near(code[part], group[part], rows["longer"][part], rows["last"][part])
            n = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            count[part] += n
            hit_best = np.argmax(np.unpackbits(found[hit].view(np.uint8), axis=1, bitorder="little"), axis=1)
            open_ = best[y + hit] < 0                        # earlier columns are preferred
            best[y + hit[open_]] = cols[hit_best[open_]]
    return count, best


def _blocks(batches):
    """Rows of whole groups, about ``_QUERIES`` at a time, groups of one row left out.

    The input is sorted by group.
    """
    held: list[dict] = []

    def cut(rows):
        change = (rows["k1"][1:] != rows["k1"][:-1]) | (rows["k2"][1:] != rows["k2"][:-1])
        alone = np.concatenate([[True], change]) & np.concatenate([change, [True]])
        rows = {c: v[~alone] for c, v in rows.items()}
        size = len(rows["id"])
        if not size:
            return
        starts = np.concatenate([[True], (rows["k1"][1:] != rows["k1"][:-1]) | (rows["k2"][1:] != rows["k2"][:-1])])
        starts = np.append(np.flatnonzero(starts), size)
        at = 0
        while at < size:
            end = starts[np.searchsorted(starts, at, side="right")]       # one group at least
            more = starts[np.searchsorted(starts, at + _QUERIES, side="right") - 1]
            end = max(int(end), int(more))
            yield {c: v[at:end] for c, v in rows.items()}
            at = end

    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _ROWS.names}
        differ = np.flatnonzero((new["k1"] != new["k1"][-1]) | (new["k2"] != new["k2"][-1]))
        last = int(differ[-1]) + 1 if len(differ) else 0
        if held and (last or held[0]["k1"][-1] != new["k1"][0] or held[0]["k2"][-1] != new["k2"][0]):
            held.append({c: v[:last] for c, v in new.items()})
            yield from cut({c: np.concatenate([h[c] for h in held]) for c in _ROWS.names})
            held = []
        elif last:
            yield from cut({c: v[:last] for c, v in new.items()})
        held.append({c: v[last:] for c, v in new.items()})
    if held:
        yield from cut({c: np.concatenate([h[c] for h in held]) for c in _ROWS.names})


def _near_task(batches):
    for rows in _blocks(batches):
        count, best = near_words(rows)
        hit = np.flatnonzero(count)
        if len(hit):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (rows["id"][hit], count[hit], rows["n"][best[hit]], rows["id"][best[hit]])],
                schema=_NEAR)


# ---------------------------------------------------------------- the operator
def spelling_variants(words: DataFrame, ratio: int = 10, word_col: str = "word", n_col: str = "n") -> DataFrame:
    """(word, n, form, root, n_near, form_n) for each row of a vocabulary (word, n).

    Two words are near if one inserted, deleted or replaced code point makes one the other.
    ``form`` is the near word of largest n (ties: the smallest in code-point order) if that n
    is at least ``ratio`` times the word's, else null; ``root`` is the last word that forms
    lead to from the word.  Words are distinct, rows without a word or of an empty word are
    left out; words of any length count.  An empty table gives no rows; further columns are
    ignored.
    """
    if ratio < 2:
        raise ValueError("ratio is 2 or more, so that forms end")
    spark = words.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    given = stored(words.select(F.col(word_col).alias("word"), F.col(n_col).cast("long").alias("n"))
                   .filter("word IS NOT NULL AND word <> ''"), "words")
    # ids in code-point order, so that the least id settles ties
    listed = stored(given.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"),
                    "vocabulary")
    top, least = listed.agg(F.max("n"), F.min(F.length("word"))).collect()[0]
    grouped = listed.mapInArrow(_group_task(least or 1), ROWS)
    near = (grouped.repartition("k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(_near_task, NEAR)
            .groupBy("id").agg(F.sum("n_near").alias("n_near"),
                               F.max(F.struct("best_n", (-F.col("best_id")).alias("back"))).alias("best")))
    near = stored(near.select("id", "n_near", "best.best_n", (-F.col("best.back")).alias("best_id")), "near")
    found = listed.join(near, "id", "left")
    formed = F.col("best_n") >= F.col("n") * ratio
    to = stored(found.filter(formed).select("id", F.col("best_id").alias("form_id"),
                                            F.col("best_id").alias("root_id")), "forms")
    # n grows by the ratio at each step, which bounds the steps; a round doubles them
    steps, n = 1, int(top or 0)
    while n >= ratio ** (steps + 1):
        steps += 1
    for _ in range((steps - 1).bit_length()):
        ahead = to.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        to = stored(to.join(ahead, "root_id", "left")
                    .select("id", "form_id", F.coalesce("further", "root_id").alias("root_id")), "roots")
    names = listed.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = listed.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    linked = to.join(names, "form_id").join(roots, "root_id").select("id", "form", "root", "form_n")
    return found.join(linked, "id", "left").select(
        "word", "n", "form", F.coalesce("root", "word").alias("root"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
