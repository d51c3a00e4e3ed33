import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from carelens.llm import token_records as R
from carelens.llm.words import Words, text_buffers

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"
ODD = ["", "a b", " a", "a  b", "x\n\ny", "it's don't 3rd 10% a,b;c\nQ", "é,ñ. ½,x ²;z", "\t", "a\tb c", "a b c, d",
       "<|endoftext|> a", "日本、語. x", "a\n b", "_a_ b_1", "a \n", "don't! (x) [y] \x00z", "a b c", "x'll 'll"]


def plain(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_checksum_of_the_standard():
    assert R.crc32c(b"123456789") == 0xE3069283
    assert R.crc32c(b"") == 0 and R.crc32c(bytes(32)) == 0x8A9136AA

    def slow(data):
        state = 0xFFFFFFFF
        for x in data:
            state ^= x
            for _ in range(8):
                state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
        return state ^ 0xFFFFFFFF
    for n in (1, 63, 64, 65, 4096, 4097, 4099, 4100, 9001):
        data = os.urandom(n)
        assert R.crc32c(data) == slow(data)


def test_kept_pieces_give_the_library_s_ids():
    encode = R.Encoder(PATH)
    encode.KEPT = 5
    texts = ODD + ["x\u00a0\n\u00a0y a", "a\u3000 b", "a \u2019quoted\u2019 b", "w" * 2000 + " x"]
    for part in (texts, texts[::-1], texts[3:], [""], []):
        words = Words(*text_buffers(pa.array(part, pa.string())))
        got = [np.frombuffer(x, encode.kind).tolist() for x in encode(words)]
        assert got == [plain(t) for t in part]


def test_round_trip(spark, folder):
    rows = [(i * 3 - 20, t) for i, t in enumerate(ODD)] + [(50, None), (None, "no id"), (7000, "w " * 30_000 + "end")]
    df = spark.createDataFrame(rows[::-1], SCHEMA).repartition(4)
    R.write_tokens(df, folder, PATH)
    got = sorted(R.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert [r.ids for r in got] == [plain(t) + [0] for _, t in want]
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids))
        start += r.n_tokens


def test_index_serves_any_order(spark, folder):
    R.write_tokens(spark.createDataFrame([(i, f"text {i}") for i in range(40)], SCHEMA), folder, PATH)
    fs, base = R.open_folder(folder)
    for row in spark.read.parquet(f"{folder}/manifest").collect():
        index = np.frombuffer(fs.open_input_file(f"{base}/{row.file}.idx").read(), R.INDEX)
        with fs.open_input_file(f"{base}/{row.file}.rec") as f:
            for key, at, size in index[::-1].tolist():
                payload = R.unframe(f.read_at(size, at))
                assert int.from_bytes(payload[:8], "little") == key
                assert np.frombuffer(payload, "<u2", offset=9).tolist() == plain(f"text {key}") + [0]


def test_damage_is_found():
    record = R.frame(b"some payload")
    for i in range(len(record)):
        with pytest.raises(ValueError):
            R.unframe(record[:i] + bytes([record[i] ^ 1]) + record[i + 1:])


def test_empty_table(spark, folder):
    R.write_tokens(spark.createDataFrame([], SCHEMA), folder, PATH)
    assert R.read_tokens(spark, folder).count() == 0
