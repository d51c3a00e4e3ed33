"""Token ids in length-delimited binary records, with a separate offset index.

Record file, one record per document:

    uint64 length | uint32 masked CRC-32C of these 8 bytes | payload | uint32 masked CRC-32C
    of the payload

The payload is the document id (int64), the bytes of one token id (uint8: 2 where the
vocabulary has no more than 65,536 ids, else 4) and the token ids; all numbers are
little-endian.  A mask rotates the checksum right by 15 bits and adds a constant, so that a
checksum of data that holds checksums stays useful (this framing is TFRecord's).

Index file: for each record (int64 id, uint64 offset, uint64 length), so a reader may fetch
records in any order.  Ids are in ascending order over all files (Spark sorts by range);
every task writes its own pair of files, named by a fresh uuid, straight into the shared
folder and returns one manifest row.  The manifest is a Parquet table that Spark commits
when all tasks are done, so files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import copy
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .words import Words, mix, steps

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8")])
NO_ID = -(1 << 63)            # stands for a null id
_MASK_DELTA = 0xA282EAD8
_POLY = 0x82F63B78            # CRC-32C, reflected
_BLOCK = 4096
_HEADER, _FRAME = 12, 16      # bytes before the payload, and around it
MANIFEST = "part int, file string, n_docs long, n_tokens long"
_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()),
                       ("n_tokens", pa.int64())])


_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1)
    return t


_TABLE = _byte_table()
_BYTES = _TABLE.tolist()
_PLACED: list[np.ndarray] = []


def _placed() -> list[np.ndarray]:
    """What a byte adds to the checksum, by the bytes that follow it in its block and by its
    value, as one array; and where the entries of each place begin."""
    if not _PLACED:
        rows = np.empty((_BLOCK, 256), np.uint32)
        rows[0] = _TABLE
        for j in range(1, _BLOCK):
            rows[j] = _TABLE[rows[j - 1] & 0xFF] ^ (rows[j - 1] >> 8)
        # from the last place to the first, so that a block of n bytes uses the last n rows
        _PLACED.append(np.ascontiguousarray(rows[::-1]).reshape(-1))
        _PLACED.append(np.arange(_BLOCK) << 8)
    return _PLACED


def crc32c(data: bytes) -> int:
    """CRC-32C (Castagnoli).  Long data goes block by block: the state is folded into a
    block's first four bytes, then every byte's share is looked up and all are XOR-ed."""
    state = 0xFFFFFFFF
    if len(data) < 64:
        for x in data:
            state = _BYTES[(state ^ x) & 0xFF] ^ (state >> 8)
        return state ^ 0xFFFFFFFF
    (placed, row), view = _placed(), np.frombuffer(data, np.uint8)
    for i in range(0, len(view), _BLOCK):
        block = view[i:i + _BLOCK]
        n = len(block)
        if n < 4:
            for x in block.tolist():
                state = _BYTES[(state ^ x) & 0xFF] ^ (state >> 8)
            continue
        block = block.copy()
        block[:4] ^= np.frombuffer(state.to_bytes(4, "little"), np.uint8)
        state = int(np.bitwise_xor.reduce(placed.take(row[_BLOCK - n:] + block)))
    return state ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = len(payload).to_bytes(8, "little")
    return b"".join((size, masked(crc32c(size)).to_bytes(4, "little"), payload,
                     masked(crc32c(payload)).to_bytes(4, "little")))


def unframe(record: bytes) -> bytes:
    """The payload of one framed record; ValueError if a length or checksum disagrees."""
    size, payload = record[:8], record[_HEADER:-4]
    if (int.from_bytes(size, "little") != len(payload)
            or int.from_bytes(record[8:_HEADER], "little") != masked(crc32c(size))
            or int.from_bytes(record[-4:], "little") != masked(crc32c(payload))):
        raise ValueError("damaged record")
    return payload


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a Spark folder name (file:, hdfs:, s3a:, gs: ...)."""
    uri = re.sub(r"^file:/(?!//)/*", "file:///", uri)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class Encoder:
    """Token ids of texts as little-endian unsigned integers of ``width`` bytes.

    A byte-level BPE starts anew at a single space or line break between two other signs, and
    between a letter and a following point or mark.  So the ids of a word, with its space
    or without, and of the marks at its end are the same wherever they stand, and are kept
    in a table by two 64-bit hashes.  Words not kept yet are encoded by the library in one
    call and told apart by the bytes their tokens stand for.  Texts with
    other white space, white space in a row or at an end are encoded whole.
    """

    KEPT = 4_000_000                     # words; a fuller table is emptied
    _SLOTS = 23                          # bits

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)])
        self.line_break = np.array(self._ids(["\n"])[0], self.kind)
        self.odd = np.zeros(256, bool)   # bytes that begin other white space, in some texts
        self.odd[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
        self.mark = np.zeros(256, bool)
        self.mark[list(b".,;:!?%$&*#")] = True
        self.letter = np.zeros(256, bool)
        self.letter[65:91] = self.letter[97:123] = True
        self._empty()

    def _pieces(self, words: Words) -> Words:
        """``words`` with the marks at the end of a word, after a letter, as a word of their own."""
        data, start, end = words.data, words.start, words.end
        stem = end.copy()
        live = np.flatnonzero(self.mark[data[end - 1]]) if len(end) else np.zeros(0, np.int64)
        while len(live):
            stem[live] -= 1
            live = live[stem[live] > start[live]]
            live = live[self.mark[data[stem[live] - 1]]]
        last = data[np.maximum(stem - 1, start)]
        lead = data[np.maximum(stem - 2, start)]
        accented = (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
        cut = (stem < end) & (stem > start) & (self.letter[last] | accented)
        out = copy.copy(words)
        out.__dict__.pop("name", None)
        at = np.flatnonzero(cut)
        out.start = np.insert(start, at + 1, stem[at])
        out.end = np.insert(np.where(cut, stem, end), at + 1, end[at])
        out.first = words.first + np.concatenate([[0], np.cumsum(cut)])[words.first]
        out.tail = np.insert(np.zeros(len(start), bool), at + 1, True)
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _empty(self) -> None:
        self.slot_key = np.zeros(1 << self._SLOTS, np.uint64)
        self.slot_entry = np.zeros(1 << self._SLOTS, np.int32)
        self.n, self.n_ids = 0, 0         # entries and ids in use of these arrays
        self.check = np.zeros(1 << 16, np.uint64)
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, self.kind)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Entry of each key, or -1."""
        at = (key >> np.uint64(64 - self._SLOTS)).astype(np.int64)
        there = self.slot_key[at]
        hit = there == key
        entry = np.where(hit, self.slot_entry[at], np.int32(-1))
        live = np.flatnonzero(~hit & (there != 0))
        at = (at[live] + 1) & ((1 << self._SLOTS) - 1)
        while len(live):
            there = self.slot_key[at]
            hit = there == key[live]
            entry[live[hit]] = self.slot_entry[at[hit]]
            on = ~hit & (there != 0)
            live, at = live[on], (at[on] + 1) & ((1 << self._SLOTS) - 1)
        return entry

    def _add(self, key, check, ids, size) -> None:
        n, n_ids = self.n + len(key), self.n_ids + len(ids)
        while n > len(self.check):
            self.check, self.begin, self.size = (np.append(x, np.zeros_like(x)) for x in
                                                 (self.check, self.begin, self.size))
        while n_ids > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        entry = np.arange(self.n, n, dtype=np.int32)
        self.begin[entry], self.size[entry], self.check[entry] = self.n_ids + np.cumsum(size) - size, size, check
        self.pool[self.n_ids:n_ids] = ids
        self.n, self.n_ids = n, n_ids
        at = (key >> np.uint64(64 - self._SLOTS)).astype(np.int64)
        live = np.arange(len(key))
        while len(live):                  # one key a slot; the others try the next slot
            free = np.flatnonzero(self.slot_key[at[live]] == 0)
            _, one = np.unique(at[live[free]], return_index=True)
            put = live[free[one]]
            self.slot_key[at[put]], self.slot_entry[at[put]] = key[put], entry[put]
            rest = np.ones(len(live), bool)
            rest[free[one]] = False
            live = live[rest]
            at[live] = (at[live] + 1) & ((1 << self._SLOTS) - 1)

    def _learn(self, words: Words, new: np.ndarray, spaced: np.ndarray, key, check) -> None:
        for lead, between, chosen in ((" ", "", new[spaced[new]]), ("", "\n", new[~spaced[new]])):
            if not len(chosen):
                continue
            pieces = [lead + words.data[a:b].tobytes().decode() for a, b in
                      zip(words.start[chosen].tolist(), words.end[chosen].tolist())]
            ids = np.array(self._ids([between.join(pieces)])[0], self.kind)
            ends = np.cumsum(self.sizes[ids])
            bytes_ = words.end[chosen] - words.start[chosen] + len(lead)
            last = np.cumsum(bytes_ + len(between)) - len(between)
            end = np.searchsorted(ends, last)
            if not np.array_equal(ends[end], last):
                raise ValueError("a token spans two words: not a byte-level BPE that splits at spaces")
            begin = np.concatenate([[0], end[:-1] + 1 + len(between)])
            keep = np.ones(len(ids), bool)
            if between:
                keep[begin[1:] - 1] = False
            self._add(key[chosen], check[chosen], ids[keep], end + 1 - begin)

    def __call__(self, words: Words) -> list[bytes]:
        """Ids of every text of ``words``."""
        if self.n > self.KEPT:
            self._empty()
        words = self._pieces(words)
        data, start, end, first, tail = words.data, words.start, words.end, words.first, words.tail
        edges = np.append(words.text_start, words.text_end)
        n, texts = words.counts(), len(first) - 1
        doc = np.repeat(np.arange(texts), n)
        opening = np.zeros(len(start), bool)
        opening[first[:-1][n > 0]] = True
        before = data[start - 1] if len(start) else data[:0]       # of an opening word: unused
        gap = np.ones(len(start), np.int64)
        gap[1:] = start[1:] - end[:-1]
        plain = opening | tail | ((gap == 1) & ((before == 32) | (before == 10)))
        whole = np.bincount(doc[~plain], minlength=texts) > 0
        has = n > 0
        whole |= ~has & (np.diff(edges) > 0)
        whole[has] |= ((start[first[:-1][has]] != edges[:-1][has])
                       | (end[first[1:][has] - 1] != edges[1:][has]))
        odd = np.concatenate([[0], np.cumsum(self.odd[data[edges[0]:edges[-1]]])])
        for i in np.flatnonzero(odd[edges[1:] - edges[0]] > odd[edges[:-1] - edges[0]]).tolist():
            whole[i] |= bool(_OTHER_SPACE.search(data[edges[i]:edges[i + 1]].tobytes().decode()))

        spaced = ~opening & ~tail & (before == 32)
        key = mix(words.name ^ np.where(spaced, np.uint64(0x5ACE), np.uint64(0))) | np.uint64(1)
        check = words.hashes(1)
        entry = self._find(key)
        missing = np.flatnonzero((entry < 0) & ~whole[doc])
        if len(missing):
            _, one = np.unique(key[missing], return_index=True)
            self._learn(words, missing[one], spaced, key, check)
            entry[missing] = self._find(key[missing])
        kept = entry >= 0
        wrong = kept.copy()
        wrong[kept] = self.check[entry[kept]] != check[kept]        # another word of this key
        whole |= np.bincount(doc[wrong], minlength=texts) > 0

        use = ~whole[doc]
        entry, broken = entry[use], (~opening & ~tail & (before == 10))[use]
        size = self.size[entry] + broken
        offset = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.begin[entry] - offset[:-1] - broken, size) + np.arange(offset[-1])
        breaks = offset[:-1][broken]
        source[breaks] = 0
        ids = self.pool[source] if len(source) else self.pool[:0]
        ids[breaks] = self.line_break[0]
        bounds = offset[np.concatenate([[0], np.cumsum(np.where(whole, 0, n))])].tolist()
        raw, w = ids.tobytes(), self.width
        late = [data[edges[i]:edges[i + 1]].tobytes().decode() for i in np.flatnonzero(whole)]
        late = iter(np.array(x, self.kind).tobytes() for x in self._ids(late)) if late else iter(())
        return [next(late) if whole[i] else raw[w * bounds[i]:w * bounds[i + 1]] for i in range(texts)]


_ENCODERS: dict[str, Encoder] = {}


def _write_task(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        encode = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, Encoder(tokenizer))
        end, width = np.array([end_id], encode.kind).tobytes(), encode.width.to_bytes(1, "little")
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        fs, base = open_folder(folder)
        data = index = None
        at = n_docs = n_tokens = 0
        try:
            for batch, words in steps(batches):
                ids = batch.column("doc_id").to_pylist()
                if data is None:
                    data = fs.open_output_stream(f"{base}/{name}.rec")
                    index = fs.open_output_stream(f"{base}/{name}.idx")
                rows = np.empty(len(ids), INDEX)
                out = []
                for k, (i, tokens) in enumerate(zip(ids, encode(words))):
                    key = NO_ID if i is None else i
                    out.append(frame(key.to_bytes(8, "little", signed=True) + width + tokens + end))
                    rows[k] = key, at, len(out[-1])
                    at += len(out[-1])
                    n_tokens += len(tokens) // encode.width + 1
                n_docs += len(ids)
                data.write(b"".join(out))
                index.write(rows.tobytes())
        finally:
            for stream in (data, index):
                if stream is not None:
                    stream.close()
        if n_docs:
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": name, "n_docs": n_docs, "n_tokens": n_tokens}], schema=_MANIFEST)
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of every whole text, then ``end_id``, in ascending id order.

    ``tokenizer`` names a byte-level BPE file of the tokenizers library, readable on every
    worker.  A null text counts as empty: its record holds the end id only.  Null ids come
    first; rows that share an id are written in the order of their texts.  Further columns
    are ignored; an empty table gives an empty manifest.
    """
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    (texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_write_task(folder, tokenizer, end_id), MANIFEST)
     .write.parquet(f"{folder}/manifest"))


def _read_task(folder: str, make, schema: pa.Schema, limit: int = 8 << 20):
    def run(batches):
        fs, base = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{base}/{row['file']}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                start, out, held = row["start"], [], 0
                with fs.open_input_stream(f"{base}/{row['file']}.rec") as f:
                    for key, _, length in index.tolist():
                        payload = unframe(f.read(length))
                        if int.from_bytes(payload[:8], "little", signed=True) != key:
                            raise ValueError("index and record disagree")
                        ids = np.frombuffer(payload, f"<u{payload[8]}", offset=9)
                        out.append((None if key == NO_ID else key, start, len(ids), *make(ids)))
                        start += len(ids)
                        held += length
                        if held >= limit:
                            yield _batch(out, schema)
                            out, held = [], 0
                if out:
                    yield _batch(out, schema)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_tokens(spark: SparkSession, folder: str, make=lambda ids: (ids,),
                fields: tuple = (("ids", "array<int>", pa.list_(pa.int32())),)) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, *fields), one row per record.

    ``start`` counts the ids of all records before this one.  ``make`` turns the ids of a
    record (a numpy array) into the values of ``fields``, each given as (name, Spark type,
    Arrow type); by default the ids themselves.  Lengths and checksums are verified.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn(
        "start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))      # one row per file
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        *((name, kind) for name, _, kind in fields)])
    text = ", ".join(["doc_id long", "start long", "n_tokens long", *(f"{n} {t}" for n, t, _ in fields)])
    files = files.repartition(max(1, files.count()), "file")
    return files.mapInArrow(_read_task(folder, make, schema), text)


def ids_crc32(ids: np.ndarray) -> tuple[int]:
    """CRC-32 of the ids as little-endian uint32."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)
