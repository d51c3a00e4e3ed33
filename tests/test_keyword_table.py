import random
import time

import pytest
from pyspark.sql import functions as F

from carelens.operators.keyword_table import automaton, keyword_table_search, leftmost, longest_per_start
from carelens.operators.keywords import keyword_search

WORDS = ["the", "of the", "of", "and", "new york", "new", "york city", "example.com", "a_b", "a", "é", "été", "c++",
         "++", "tion", "the of"]


def texts(rng, n):
    bits = WORDS + ["The", "OF", "York", " ", " ", "-", ".", "_", "x", "3", "É", "\n", "  "]
    return ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(n)]


def spans(df, col="keywords_text"):
    return [(r.id, [tuple(s) for s in r[col]]) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("block_rows", [1000, 5, 1])
def test_equal_to_the_list_search(spark, block_rows):
    rng = random.Random(1)
    df = spark.createDataFrame([*enumerate(texts(rng, 300)), (300, None), (301, "")], "id long, text string")
    table = spark.createDataFrame([(w,) for w in [*WORDS, "", None, "the"]], "keyword string")
    got = keyword_table_search(df.repartition(3), "text", table, block_rows=block_rows)
    assert spans(got) == spans(keyword_search(df, "text", WORDS))
    assert got.columns == ["id", "text", "keywords_text"]


def test_spellings_and_other_columns(spark):
    df = spark.createDataFrame([(1, "took TAMIFLU, tamiflu", 7, [1, None])] * 2, "id long, text string, low int, `a.b` array<int>")
    table = spark.createDataFrame([("Tamiflu",), ("tamiFLU",), ("TAMIFLU",)], "term string")
    out = keyword_table_search(df, "text", table, "term")
    assert out.columns == ["id", "text", "low", "a.b", "keywords_text"] and out.count() == 2
    assert spans(out)[0][1] == [("tamiFLU", 5, 12), ("tamiFLU", 14, 21)]
    empty = keyword_table_search(df, "text", table.limit(0), "term")
    assert spans(empty)[0][1] == [] and keyword_table_search(df.limit(0), "text", table, "term").count() == 0


def test_a_hundred_thousand_keywords(spark):
    rng = random.Random(4)
    words = list({"".join(rng.choices("abcdefgh", k=rng.randint(6, 11))) for _ in range(110_000)})[:100_000]
    assert len(words) == 100_000
    table = spark.createDataFrame([(w,) for w in words], "keyword string")
    rows = [(i, " ".join(rng.choices(words, k=30)) + " qqq") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, text string")
    want = []
    for i, text in rows:
        at, found = 0, []
        for w in text.split(" ")[:-1]:
            found.append((w, at, at + len(w)))
            at += len(w) + 1
        want.append((i, found))
    start = time.time()
    assert spans(keyword_table_search(df, "text", table)) == want
    assert spans(keyword_table_search(df, "text", table, block_rows=30_000)) == want
    assert time.time() - start < 300


def test_linear_in_the_matches_of_a_text():
    machine = automaton([(w, w) for w in WORDS])
    found = leftmost(longest_per_start(machine, "of the " * 50_000))
    assert len(found) == 50_000 and found[-1] == {"keyword": "of the", "start": 349_993, "end": 349_999}
    assert automaton([]) is None


def test_a_long_table_is_reduced_to_what_can_match(spark, monkeypatch):
    from carelens.operators import keyword_table as K
    rng = random.Random(9)
    table = spark.createDataFrame([(w,) for w in [*WORDS, *(f"Customer#{i:09}" for i in range(3000))]], "keyword string")
    df = spark.createDataFrame([*enumerate(texts(rng, 200)), (200, "the customer#000000007 of"), (201, None)],
                               "id long, text string")
    want = spans(keyword_table_search(df, "text", table))
    monkeypatch.setattr(K, "LIVE_ROWS", 10)
    held, kept = [], K._live
    monkeypatch.setattr(K, "_live", lambda *a: held.append(kept(*a)) or held[-1])
    assert spans(keyword_table_search(df, "text", table)) == want
    assert spans(keyword_table_search(df, "text", table, block_rows=4)) == want
    assert held[0].count() <= 40 and held[0].filter("given = 'Customer#000000007'").count() == 1
