import random
import zlib

import pytest

from carelens.llm.spelling import spelling_variants, vocabulary


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(words, ratio=10):
    near = {w: [x for x in words if one_error(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, n, form[w], root(w), len(near[w]), words.get(form[w])) for w, n in words.items())


def rows(df):
    return sorted(map(tuple, df.select("word", "n", "form", "root", "n_near", "form_n").collect()))


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


@pytest.mark.parametrize("letters,longest", [("ab", 9), ("abcé", 8), ("xyzw", 7)])
def test_against_all_pairs(spark, letters, longest):
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randint(1, longest))):
             rng.choice([2, 2, 3, 20, 25, 200, 300, 2500, 30000]) for _ in range(500)}
    assert rows(spelling_variants(table(spark, words))) == plain(words)


def test_runs_of_one_letter_and_very_long_words(spark):
    words = {"a" * k: k for k in range(5, 15)}
    words |= {"a" * 5000: 3, "a" * 5001: 40, "a" * 2500 + "b" + "a" * 2499: 400}
    assert rows(spelling_variants(table(spark, words))) == plain(words)


def test_a_group_larger_than_a_block(spark):
    """4,913 words that agree outside one piece, all near to many others."""
    import string
    some = string.ascii_lowercase[:17]
    words = {f"common{a}{b}{c}ending": 2 + ord(a) % 7 for a in some for b in some for c in some}
    words["commonabending"] = 5000
    got = {r.word: r for r in spelling_variants(table(spark, words)).collect()}
    assert all(r.n_near == 48 + (w in {f"common{x}ending" for k in some for x in
                                       (f"{k}ab", f"a{k}b", f"ab{k}")})
               for w, r in got.items() if w != "commonabending")
    assert got["commonabending"].n_near == 17 * 3 - 2
    assert got["commonaabending"].form == "commonabending" and got["commonbbbending"].form is None


def test_ties_take_the_smallest_word_and_chains_end_at_the_root(spark):
    words = {"garden": 2, "gardenx": 20, "gardena": 20, "gardenab": 300, "gardenabc": 3000, "gardenabcd": 30001}
    got = {r.word: r for r in spelling_variants(table(spark, words)).collect()}
    assert (got["garden"].form, got["garden"].form_n, got["garden"].n_near) == ("gardena", 20, 2)
    assert got["garden"].root == "gardenabcd" and got["gardenabcd"].form is None
    assert rows(spelling_variants(table(spark, words))) == plain(words)


def test_letters_beyond_latin(spark):
    words = {"здравствуйте": 50, "здраствуйте": 3, "😀😀😀a": 90, "😀😀a": 2}
    assert rows(spelling_variants(table(spark, words))) == plain(words)


def test_vocabulary_counts_runs_and_drops_a_letter_by_crc(spark):
    import re
    texts = [(1, "Colour COLOUR ÉTUDIER étudier 12colourful34 Straße×÷"), (None, "colourful colourful"),
             (2, None), (3, ""), (4, "x" * 7 + " " + "y" * 6), (4, "x" * 7), (9, "colourful_Colourful")]
    texts += [(100 + i, "neighbourhood watchfulness") for i in range(120)]
    want = {}
    for doc, text in texts:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                want[w] = want.get(w, 0) + 1
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS id")
    got = {r.word: r.n for r in vocabulary(docs, misspell=31).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}
    assert any(len(w) == 12 and w != "watchfulness" for w in want)


def test_empty_and_odd_input(spark):
    empty = table(spark, {"a": 1}).limit(0)
    assert spelling_variants(empty).count() == 0
    odd = spark.createDataFrame([(None, 3, 1), ("", 4, 1), ("word", 5, 1)], "word string, n long, id long")
    assert rows(spelling_variants(odd)) == [("word", 5, None, "word", 0, None)]
    with pytest.raises(ValueError):
        spelling_variants(odd, ratio=1)
