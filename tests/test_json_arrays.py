import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelens import schemas
from carelens.sources import sinks
from carelens.sources.json_arrays import RangeFile, array_records, read_array_posts, records, scan, unescaped_quotes
from tests.conftest import SF001

PIECES = ['"', "\\", "{", "}", "[", "]", ",", ":", " ", "\n", "é", "😀", "a", '\\"', "\\\\", '{"id":"x"}', " "]


def sample(rng, n):
    text = lambda: "".join(rng.choices(PIECES, k=rng.randint(0, 12)))
    return [{"id": str(i), "text": text(), text() or "k": [text(), {"deep": {"er": text()}}, rng.choice([1, None, True])]}
            for i in range(n)]


def in_ranges(path, size):
    """The records of a file cut into ranges of ``size``, without Spark."""
    file = RangeFile(path)
    inside, depth, base, out = False, 0, None, []
    for start in range(0, file.size, size):
        end = min(file.size, start + size)
        turns, outside, within, first = scan(file, start, end)
        if base is None and first >= 0:
            base = 1 if first == ord("[") else 0
        out += [json.loads(r) for r in records(file, start, end, inside, depth, base or 0, ahead=3)]
        depth += within if inside else outside
        inside ^= turns
    return out


@pytest.mark.parametrize("seed", range(6))
def test_every_cut_gives_the_same_records(tmp_path, seed):
    rng = random.Random(seed)
    rows = sample(rng, rng.randint(0, 6))
    styles = [json.dumps(rows), json.dumps(rows, ensure_ascii=False, indent=1), "﻿ \n" + json.dumps(rows),
              "\n".join(json.dumps(r) for r in rows)]
    for i, text in enumerate(styles):
        path = f"{tmp_path}/{i}.json"
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        length = len(text.encode())
        for size in sorted({1, 2, 3, 5, 7, 16, 61, length // 2 or 1, length or 1}):
            assert in_ranges(path, size) == rows, (i, size)


def test_quotes_behind_backslashes():
    for n in range(6):
        raw = np.frombuffer(b"x" + b"\\" * n + b'"', np.uint8)
        for cut in range(len(raw) - 1):
            marks = unescaped_quotes(raw[cut:], before=min(cut - 1, n) if cut else 0)
            assert marks[-1] == (n % 2 == 0)


def test_equal_to_the_whole_file_reader(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    posts = docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit('say "\\'), "text").alias("text"),
                        F.struct(F.array(F.struct(F.lit("a]b").alias("tag"))).alias("hashtags")).alias("entities"))
    sinks.write_json_arrays(posts.repartition(3), f"{tmp_path}/out")
    whole = spark.read.schema(schemas.POST).option("multiLine", True).json(f"{tmp_path}/out")
    want = sorted(map(str, whole.collect()))
    assert len(want) == docs.count()
    for size in (1000, 65_537, 8 << 20):
        got = read_array_posts(spark, f"{tmp_path}/out", range_bytes=size)
        assert got.schema == whole.schema and sorted(map(str, got.collect())) == want
    # one file is many tasks
    assert array_records(spark, f"{tmp_path}/out", 10_000).rdd.getNumPartitions() > 20


def test_empty_files_and_elements_that_are_no_objects(spark, tmp_path):
    for name, text in (("a", ""), ("b", "[]"), ("c", " \n"), ("d", '[1, "{}", [{"id": "no"}], {"id": "x"}, null]')):
        with open(f"{tmp_path}/{name}.json", "w") as f:
            f.write(text)
    got = read_array_posts(spark, str(tmp_path), range_bytes=4).collect()
    assert [r.id for r in got] == ["x"]
    assert array_records(spark, f"{tmp_path}/nothing").count() == 0
    with pytest.raises(Exception):
        sinks.write_json_arrays(spark.range(1), str(tmp_path))
