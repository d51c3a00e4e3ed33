import random
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from carelens.llm.quality_rules import base_figures, quality_rules

SCHEMA = "doc_id long, text string, source string"


def figures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_base_figures(spark):
    texts = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 3, "x " * 40, "é# ñ*\n\né# ñ*\n \n",
             "a b c d e f g h i\na b c d e f g h j", "tab\tfeed\x0c vt\x0b cr\r nb\u00a0sp " * 9]
    df = base_figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect()}
    assert got == {i: figures(t) for i, t in enumerate(texts)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab \n", max_size=80), min_size=20, max_size=20))
def test_base_figures_of_random_texts(spark, texts):
    df = base_figures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in df.collect()}
    assert got == {i: figures(t) for i, t in enumerate(texts)}


def body(i):
    rng = random.Random(i)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + "." * (j % 4 == 3) for j in range(40))


FOOTER = "\n".join(f"{w} notice of this site, 19" for w in ("Legal", "Privacy", "Cookie", "Contact", "Sitemap"))


def corpus():
    rows = [(i, body(i) + "\n" + FOOTER + f"{i % 10}0", "h1") for i in range(40)]
    rows += [(100 + i, body(500 + i) + "\n" + FOOTER, "h2") for i in range(5)]
    # little but the footer: depleted
    rows += [(200, "tiny text\n" + FOOTER + "77", "h1")]
    # copies of one clean text
    rows += [(300 + i, body(900) + "\n" + body(901), "h1") for i in range(60)]
    return rows


def test_footers_go_and_copies_stay(spark):
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(corpus(), SCHEMA), line_docs=10).collect()}
    assert out[0].kept_text == corpus()[0][1]                  # the first holder keeps its lines
    for i in range(1, 40):
        # the number in the last line has three digits or four, all 0 to the hash
        assert out[i].kept and out[i].n_kept_words == 40 and out[i].kept_text == body(i)
    assert all(out[100 + i].n_kept_words == out[100 + i].n_words for i in range(5))
    assert not out[200].base_failed and not out[200].kept and out[200].n_kept_words < 20
    assert all(out[300 + i].kept and out[300 + i].n_kept_words == 80 for i in range(60))


def test_odd_rows(spark):
    rows = corpus() + [(400, None, "h1"), (401, "", None), (None, corpus()[1][1], "h1"),
                       (3, corpus()[3][1], "h1"), (402, "word " * 20_000, "h1"), (403, "#$%\n" * 30, "h1")]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA + ", kept string, n_words int")
    out = quality_rules(df, line_docs=10).collect()
    assert len(out) == len(rows) and [n for n in out[0].asDict()].count("kept") == 1
    by = {r.doc_id: r for r in out}
    assert by[400].base_failed and by[400].kept_text is None and not by[401].kept
    assert by[None].n_kept_words == by[None].n_words and by[402].n_repeat_words == 20_000
    assert [r.n_kept_words for r in out if r.doc_id == 3] == [40, 40]
    assert quality_rules(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = quality_rules(spark.createDataFrame(corpus(), SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert df.filter(F.col("kept")).count() > 0


def test_pages_that_share_more_than_they_own(spark):
    """100 different pages of one host with 2 own and 20 shared sentences: the shared lines go
    from all but the first, and copies of a page change nothing."""
    rng = random.Random(2)

    def sentence():
        return " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(8)) + "."
    shared = [sentence() for _ in range(20)]
    pages = ["\n".join([sentence(), *shared, sentence()]) for _ in range(100)]
    rows = list(enumerate(pages)) + [(1000 + i, pages[7]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source", "1 AS first")
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    assert got[0].kept and got[0].n_kept_words == got[0].n_words
    assert all(not got[d].kept and got[d].n_kept_words == 16 for d in got if d)
    few = spark.createDataFrame(rows[:15], "doc_id long, text string").selectExpr("*", "'s' AS source")
    assert all(r.kept and r.kept_text == pages[r.doc_id] for r in quality_rules(few).collect())
