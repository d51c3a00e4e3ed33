import random

from hypothesis import given, settings, strategies as st
import numpy as np
import pyarrow as pa

from carelens.llm import substring_dedup as S
from carelens.llm.words import Words, text_buffers

SCHEMA = "doc_id long, text string"


def expected(rows, width):
    """Word by word: what every document loses."""
    first = {}
    split = {d: (t or "").encode().split() for d, t in rows if d is not None}
    for d, w in split.items():
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in split.items():
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i:i + width])] < d
                for j in range(i, i + width)}
        out[d] = (len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())
    return out


def run(spark, rows, width):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text)
            for r in S.substring_dedup(df, width).collect()}


def corpus(rng, n, words=30, runs=True):
    vocab = [f"w{i}" for i in range(words)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(8, 40))] for _ in range(6)]
    if runs:
        passages += [["a"] * 25, ["a", "b"] * 12, ["x"] + ["a"] * 15 + ["y"]]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            lo = rng.randint(0, 3)
            text += p[lo:] if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 12))]
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed, width in ((1, 10), (2, 7), (3, 12)):
        rows = corpus(random.Random(seed), 60)
        assert run(spark, rows, width) == expected(rows, width)


def test_many_copies_settle_in_and_across_tasks(spark):
    rng = random.Random(5)
    base = [f"v{rng.randint(0, 400)}" for _ in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(80)] = f"e{rng.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.substring_dedup(df, 20).collect()}
    assert got == expected(rows, 20)


def test_odd_rows(spark):
    long = " ".join(f"q{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "x " + long), (None, long), (6, "a b c"), (7, "short")]
    df = spark.createDataFrame([(d, t, "n") for d, t in rows], SCHEMA + ", n_words string")
    out = S.substring_dedup(df, 10).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 8 and got[1].n_words == got[2].n_words == got[3].n_words == 0
    assert got[4].n_removed == 0 and got[5].kept_text == "x" and got[None].n_removed == 0
    assert got[6].n_words == 2 and got[7].kept_text == "short"
    assert S.substring_dedup(df.limit(0), 10).count() == 0


def test_repeated_ids_are_one_document(spark):
    text = " ".join(f"k{i}" for i in range(30))
    got = sorted((r.doc_id, r.n_removed) for r in S.substring_dedup(
        spark.createDataFrame([(1, text), (1, text), (2, text), (2, text)], SCHEMA), 10).collect())
    assert got == [(1, 0), (1, 0), (2, 30), (2, 30)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=0, max_size=60),
       st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9))
def test_a_window_has_the_same_anchor_everywhere(middle, left, right):
    width = 9

    def names(words):
        column = pa.array([" ".join(words), "z"])
        w = Words(*text_buffers(column))
        _, starts, anchor, _ = S._window_names(w, width)
        return {int(s): int(a) for s, a in zip(starts, anchor)}
    alone, inside = names(middle), names(left + middle + right)
    for s, a in alone.items():
        assert inside[s + len(left)] == a


def test_supports_are_ordered():
    rng = np.random.default_rng(0)
    name = rng.integers(0, 5, 500).astype(np.uint64) + np.uint64(7)
    level = S._Level.of_words(name, np.array([0, 200, 200, 500]))
    for r in range(1, 6):
        level = level.runs().pairs(r)
        ok = ~level.wall & (level.hi - level.lo < 60)
        assert (np.diff(level.lo[ok]) >= 0).all() and (np.diff(level.hi[ok]) >= 0).all()


def test_rows_that_share_an_id_are_cut_by_their_own_texts(spark):
    rng = random.Random(21)

    def text(n):
        return " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    shared, other = text(80), text(70)
    rows = [(1, shared), (1, "hello there"), (2, f"{shared} tail"), (2, other), (2, other), (3, f"head {other}"),
            (3, None), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS who", "2 AS at", "3 AS spans")
    got = sorted(((r.doc_id, r.kept_text) for r in S.substring_dedup(df).collect()), key=str)
    want = [(1, shared), (1, "hello there"), (2, "tail"), (2, other), (2, other), (3, "head"), (3, ""), (None, shared)]
    assert got == sorted(want, key=str)
