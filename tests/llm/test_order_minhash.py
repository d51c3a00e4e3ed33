import itertools
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from carelens.llm import order_minhash as O
from carelens.llm.components import components

SCHEMA = "doc_id long, text string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def expected(rows, k=5, similarity=0.8):
    """Classes by comparing all pairs."""
    words = {d: (t or "").split() for d, t in rows}
    texts = dict(rows)
    grams = {d: [tuple(w[i:i + k]) for i in range(len(w) - k + 1)] for d, w in words.items()}
    root = {d: d for d in words}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sorted(words), 2):
        if texts[a] is None or texts[b] is None:
            continue
        n = lcs(grams[a], grams[b])
        if texts[a] == texts[b] or (n and n >= similarity * (len(grams[a]) + len(grams[b]) - n)):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in words}


def edited(rng, words, edits, vocab):
    w = list(words)
    for _ in range(edits):
        i = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.5:
            w[i] = rng.choice(vocab)
        elif kind < 0.75 and len(w) > 6:
            del w[i]
        else:
            w.insert(i, rng.choice(vocab))
    return w


def test_matches_all_pairs(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 120))]
        for _ in range(25):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 1, 2, 4, 8]), vocab)))
    rows += ["", "", None, "one two", "one two", "a a a a a a a a", "a a a a a a a a a"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: r.class_id for r in O.near_duplicates(df).collect()}
    assert got == expected(rows)


def test_odd_rows(spark):
    long = " ".join(f"q{i}" for i in range(30_000))
    rows = [(1, None, 0), (None, "x y z", 0), (3, long, 0), (4, long + " end", 0), (5, "", 0), (6, "", 0), (6, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA + ", class_id int")
    got = sorted(((r.doc_id, r.class_id) for r in O.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (None, None), (3, 3), (4, 3), (5, 5), (6, 5), (6, 5)], key=str)
    assert O.near_duplicates(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=40), st.lists(st.integers(0, 6), max_size=40), st.integers(1, 40))
def test_alignment_is_exact(a, b, least):
    x, y = np.array(a, "<u4"), np.array(b, "<u4")
    n = lcs(a, b)
    assert O.aligned(x, y, least) == (n >= least)
    if n >= least:
        assert O.banded(x, y, least) == n


def test_order_matters():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 1 << 60, 200).astype(np.uint64)
    swapped = np.concatenate([a[100:], a[:100]])
    same = (O.sketch(a, 200, 4) == O.sketch(a.copy(), 200, 4)).mean()
    moved = (O.sketch(a, 200, 4) == O.sketch(swapped, 200, 4)).mean()
    assert same == 1 and moved < 0.35        # the sets are equal, the order is not


def test_blocks_join_what_the_centre_does_not(spark):
    # b and c match each other but not the centre a; blocks of one text each
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(900)]
    a = [rng.choice(vocab) for _ in range(150)]
    b = edited(rng, a, 5, vocab)
    rows = [(0, " ".join(a))] + [(i, " ".join(edited(rng, b, 1, vocab))) for i in range(1, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    buckets = spark.createDataFrame([(7, i) for i, _ in rows], "bucket long, doc_id long")
    want = expected(rows)
    for block in (3, 100):
        links = O.near_links(df, buckets, 5, 0.8, block)
        got = {r.node: r.root for r in components(links).collect()}
        assert {d: got.get(d, d) for d, _ in rows} == want


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for x, y in links:
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if any(x in l and l[0] != l[1] for l in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_that_share_an_id_keep_the_classes_of_their_texts(spark):
    rng = random.Random(9)

    def text():
        return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(90)]
    a, b = text(), text()
    near_a, near_b = a[:40] + ["x"] + a[41:], b[:50] + ["y"] + b[51:]
    rows = [(i, " ".join(t)) for i, t in ((5, a), (5, b), (7, near_a), (9, near_b), (7, near_a))]
    df = spark.createDataFrame(rows + [(5, None)], "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS node")
    got = sorted(((r.doc_id, r.class_id) for r in O.near_duplicates(df).collect()))
    of_7, of_9 = {c for d, c in got if d == 7}, {c for d, c in got if d == 9}
    assert len(of_7) == len(of_9) == 1 and of_7 != of_9
    assert 5 in of_7 | of_9 and min(of_7 | of_9) < 0
    assert sorted(c for d, c in got if d == 5) == sorted([5, *of_7, *of_9])
